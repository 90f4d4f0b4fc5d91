"""The whole pipeline against SQL, brute force and a library, stage by stage, without its operators."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from shapelake.llm import bpe, common, near_dedup
from shapelake.llm.exact_dedup import OP4_SQL
from shapelake.llm.mixing import OP2_SQL
from shapelake.llm.quality import OP1_SQL

DATA = "/root/testdata/sf0.01"


def near_kept(ids, texts, spark):
    """The least id of each class that links at 0.8 or more, and equal words, join."""
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    idf = near_dedup.inverse_frequencies(*near_dedup.document_frequencies(df))
    sim = near_dedup.dense_similarities(texts, idf)
    same = np.array([hash(" ".join(t.split())) for t in texts])
    linked = (sim >= 0.8) | (same[:, None] == same[None])
    kept, left = [], set(range(len(ids)))
    while left:
        group, todo = set(), [next(iter(left))]
        while todo:
            i = todo.pop()
            if i not in group:
                group.add(i)
                todo += np.flatnonzero(linked[i]).tolist()
        kept.append(min(ids[i] for i in group))
        left -= group
    return kept


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")
def test_pipeline_against_brute_force(spark):
    con = duckdb.connect()
    docs = con.sql(f"SELECT * FROM '{DATA}/documents.parquet'").df()

    def keep(ids):
        nonlocal docs
        docs = docs[docs.doc_id.isin(ids)].reset_index(drop=True)
        con.register("kept_docs", docs)
        con.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM kept_docs")

    keep(docs.doc_id)
    keep(con.sql(f"SELECT doc_id FROM ({OP1_SQL}) WHERE kept").df().doc_id)
    keep(con.sql(f"SELECT doc_id FROM ({OP4_SQL}) WHERE kept").df().doc_id)
    keep(near_kept(docs.doc_id.tolist(), docs.text.tolist(), spark))
    repeats = con.sql(f"SELECT doc_id, repeats FROM ({OP2_SQL})").df().set_index("doc_id").repeats
    b = bpe.load(bpe.vocabulary_path(), bpe.public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    want = []
    for i, text in zip(docs.doc_id, docs.text):
        ids = library.encode_ordinary(text)
        row = (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        want += [row] * int(repeats[i])
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()]
    assert len(want) > 300 and sorted(got) == sorted(want)
    assert common.clean(spark) > 5 and common.clean(spark) == 0
