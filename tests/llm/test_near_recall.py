"""How many of the pairs at 0.8 or more the near-duplicate search finds, against brute force, and its document frequencies."""

import os
import random

import numpy as np
import pytest

from shapelake.llm import near_dedup

DATA = "/root/testdata/sf0.01"


def classes_of(texts, idf):
    """Class of each text by comparing all pairs, and the pairs of different texts at 0.8 or more."""
    sim = np.triu(near_dedup.dense_similarities(texts, idf), 1)
    pairs = [(i, j) for i, j in zip(*np.nonzero(sim >= 0.8)) if texts[i].split() != texts[j].split()]
    return pairs


def found(spark, texts):
    rows = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: r.class_id for r in rows}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")
def test_recall_on_documents(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = near_dedup.inverse_frequencies(*near_dedup.document_frequencies(df))
    pairs, got = classes_of(texts, idf), found(spark, texts)
    assert pairs and np.mean([got[i] == got[j] for i, j in pairs]) >= 0.95


def test_recall_just_above_the_threshold(spark):
    rng = random.Random(31)
    texts = []
    for _ in range(250):  # pairs of which about 0.8 to 0.9 of the shingles are common
        words = [f"t{rng.randrange(10**6)}" for _ in range(rng.choice([80, 150, 300]))]
        n = len(words)
        edited = list(words)
        for k in range(max(1, round(n * rng.uniform(0.012, 0.02)))):
            edited[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
        texts += [" ".join(words), " ".join(edited)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = near_dedup.inverse_frequencies(*near_dedup.document_frequencies(df))
    sim = near_dedup.similarities(texts[::2], texts[1::2], idf)
    got = found(spark, texts)
    joined = np.array([got[2 * k] == got[2 * k + 1] for k in range(250)])
    assert (sim >= 0.8).sum() > 50 and ((sim >= 0.8) & (sim < 0.85)).sum() > 20
    assert joined[sim >= 0.8].mean() >= 0.98 and joined[(sim >= 0.8) & (sim < 0.85)].mean() >= 0.95
    assert not joined[sim < 0.8].any()


def test_document_frequencies_are_those_of_the_shingles(spark):
    """Shares from RAREST on are counted whatever the corpus puts on the cells; what is rarer counts as RAREST."""
    rng = random.Random(32)
    phrases = {k: [f"p{k}w{i}" for i in range(5)] for k in (3, 10, 50, 200, 900)}  # in about so many of 1000 documents
    texts, true = [], dict.fromkeys(phrases, 0)
    for _ in range(1000):
        words = [f"t{rng.randrange(10**7)}" for _ in range(400)]
        for k, p in phrases.items():
            if rng.random() < k / 1000:
                words += p
                true[k] += 1
        texts.append(" ".join(words))
    table, n = near_dedup.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    idf = near_dedup.inverse_frequencies(table, n)
    assert n == 1000
    for k, p in phrases.items():
        _, shingle, _ = near_dedup.shingles([" ".join(p)])
        want = 1 + np.log(n / max(true[k], 2)) / np.log(500)
        assert abs(near_dedup.weights(shingle, idf)[0] - want) < 0.06
    _, rare, _ = near_dedup.shingles(texts[:20])
    assert (near_dedup.weights(rare, idf) > 1.95).mean() > 0.95
    # a hundred times the documents: loads and counts grow alike, weights stay
    assert np.abs(near_dedup.inverse_frequencies(table * 100, n * 100) - idf).max() < 0.01
