"""What a worker holds after a task."""

import pyarrow as pa

from shapelake.llm import bpe


def test_a_worker_keeps_no_pieces_after_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some pieces of text")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, fn, schema: fn)
    batch = pa.record_batch([pa.array([1, 2], pa.int64()), pa.array(["some pieces of text", None])], ["doc_id", "text"])
    memo = bpe.load(bpe.vocabulary_path(), bpe.public_tokenizers.PATTERN).memo
    for task in (bpe.round_trip(docs), bpe.encode(docs)):
        assert sum(b.num_rows for b in task(iter([batch]))) == 2
        assert not memo.index and not memo.size
        assert not list(task(iter([])))
