"""Rows without an id, or that share one, are documents of their own."""

import hashlib
import random

import pyarrow as pa

import corpus_pipeline
from shapelake.llm import common, near_dedup, substring_dedup, wordhash


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_substrings_of_rows_that_share_an_id(spark, tmp_path):
    passage, long_, short = words(1, 40), words(2, 500), words(3, 30)
    texts = [(1, passage), (None, long_ + passage), (None, short), (None, short), (7, words(4, 50)), (7, words(5, 10) + passage), (7, words(5, 10) + passage)]
    spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op8_substring_dedup(spark, str(tmp_path)).collect())
    sha = lambda w: hashlib.sha256(" ".join(w).encode()).hexdigest()
    want = [(1, 40, 0, sha(passage)), (0, 540, 40, sha(long_)), (0, 30, 0, sha(short)), (0, 30, 30, sha([])), (7, 50, 0, sha(words(4, 50))), (7, 50, 40, sha(words(5, 10))), (7, 50, 50, sha([]))]
    assert got == sorted(want)


def test_rows_are_told_apart(spark):
    docs = lambda rows: common.told_apart(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.t for r in docs([(1, "a"), (2, "a"), (None, "b")]).collect()} == {0}
    assert len({(r.k, r.t) for r in docs([(None, "a"), (None, "b"), (1, "a"), (1, "c"), (1, "c")]).collect()}) == 4


def test_near_copies_of_rows_that_share_an_id(spark):
    base, other, third, lone = words(6, 100), words(7, 80), words(8, 90), words(9, 70)
    texts = [(5, base), (None, [*base[:-1], "x"]), (None, other), (None, other), (6, third), (7, [*third[:-1], "y"]), (7, lone)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    rows = near_dedup.near_duplicates(docs).collect()
    got = sorted((r.doc_id or 0, r.class_id or 0, r.class_size, r.kept) for r in rows)
    assert got == [(0, 0, 2, False), (0, 0, 2, True), (0, 5, 2, False), (5, 5, 2, True), (6, 6, 2, True), (7, 6, 2, False), (7, 7, 1, True)]
    stay = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in stay) == sorted([(5, " ".join(base)), (0, " ".join(other)), (6, " ".join(third)), (7, " ".join(lone))])


def test_long_texts_go_in_pieces(spark):
    """What a passage loses doesn't depend on where a long text is cut into pieces."""
    rng = random.Random(21)
    passage = words(22, 400)  # long enough for high-level symbols
    texts = [words(23, 400) + passage + words(24, 300), passage[5:380] + words(25, 900) + passage, ["a"] * 500, words(26, 15) + passage[:30], passage]
    texts += [[f"v{rng.randrange(3)}" for _ in range(120)] for _ in range(5)]
    docs = [(i, " ".join(w)) for i, w in enumerate(texts)]
    seen, want = set(), []
    for w in texts:
        gone = set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            gone |= set(range(i, i + 20)) if g in seen else set()
            seen.add(g)
        want.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    column = pa.array([t for _, t in docs])
    assert [p.words for b in wordhash.word_blocks(column) for p in b] == texts
    cut = [p for b in wordhash.word_blocks(column, 19, 150, 7) for p in b]
    assert len(cut) > 50 and [" ".join(x for p in cut if p.row == i for x in p.words[: p.own]) for i in range(len(docs))] == column.to_pylist()
    summary, changed = substring_dedup.repeats_by_row(spark.createDataFrame(docs, "doc_id long, text string"), 20, 150)
    kept = {r.u: (r.n_removed, r.kept) for r in changed.collect()}
    got = [(r.n_words, r.n_words, "") if r["copy"] and r.n_words >= 20 else (r.n_words, *kept.get(r.u, (0, column[r.k].as_py()))) for r in summary.orderBy("k").collect()]
    assert [(n, gone, hashlib.sha256(text.encode()).hexdigest()) for n, gone, text in got] == want
