"""Each operator against SQL, a library or brute force, on small tables."""

import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import tiktoken
from pyspark.sql import functions as F

from shapelake.llm import bpe, exact_dedup, language, mixing, near_dedup, pii, quality, substring_dedup, token_store
from shapelake.llm.components import components
from shapelake.llm.queries import ORACLE_SQL, QUERIES
from shapelake.llm.wordhash import rolling

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")


def frame(spark, texts, **more):
    rows = [(i, t, *(v[i] for v in more.values())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} string" for k in more))


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    tidy = lambda df: df[sorted(df.columns)].sort_values(sorted(df.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(QUERIES[name](spark, DATA).toPandas()), tidy(con.sql(ORACLE_SQL[name]).df()), check_dtype=False)


def random_words(rng, n, vocabulary=12):
    return " ".join(rng.choice([f"w{k}" for k in range(vocabulary)]) for _ in range(n))


def test_policies_and_ablations(spark):
    texts = ["a b " * 60, " ".join(f"word{k}" for k in range(80)), "x", " ".join(f"##{k}" for k in range(100))]
    led = quality.ledger(frame(spark, texts)).cache()
    assert [r.doc_id for r in led.filter(quality.passes("v1")).collect()] == [1]
    assert [r.doc_id for r in led.filter(quality.passes("base")).orderBy("doc_id").collect()] == [1, 3]
    ab = {r.rule: (r.n_failed, r.n_only) for r in quality.ablations(led).collect()}
    assert ab["few_words"] == ab["repeated_trigrams"] == (1, 0) and ab["short_words"] == (2, 0)  # these two texts have short words too
    assert ab["symbols"] == (1, 1)


def test_repeated_windows_against_brute_force(spark):
    rng = random.Random(4)
    texts = [random_words(rng, n, v) for n in (0, 1, 2, 3, 4, 10, 50, 200) for v in (1, 3, 12)]
    for r in quality.ledger(frame(spark, texts)).collect():
        w = texts[r.doc_id].split()
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert r.n_repeat_words == len({i + k for i, x in enumerate(g) if g.count(x) > 1 for k in range(3)})


def test_ledger_runs_no_python(spark):
    plan = quality.ledger(frame(spark, ["a"])).filter(quality.passes("v1"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def filled(sizes, weights, cap=3):
    """Rounds of clamping and proportional redistribution."""
    total, out, free = sum(sizes), {}, dict(enumerate(weights))
    while free:
        left = total - sum(out.values())
        over = [k for k, w in free.items() if left * w / sum(free.values()) > cap * sizes[k] + 1e-9]
        if not over:
            return [out.get(k, left * free[k] / sum(free.values()) if k in free else 0) for k in range(len(sizes))]
        for k in over:
            out[k] = cap * sizes[k]
            del free[k]
    return [out[k] for k in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [5, 1, 1000, 20], [0, 10, 3], [1, 1, 1, 1, 1, 995]])
def test_water_filling(spark, sizes):
    df = spark.createDataFrame([(chr(97 + k), s) for k, s in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.water_fill(df).orderBy("source").collect()]
    assert np.allclose(got, filled(sizes, [(k % 3) + 1 for k in range(len(sizes))]))


def test_mix_is_near_its_targets_and_repeats(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", "b", None]), rng.randint(0, 60)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df).cache()
    assert got.count() == 3000 and got.filter("taken > 3 * size").count() == 0
    sums = got.groupBy("target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) <= 60 for r in sums)
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect())) == sorted(map(tuple, got.collect()))


def test_pii_base_rules_against_regular_expressions():
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]

    rng = random.Random(6)
    parts = ["a", "b", "@", ".", "-", "+", "(", ")", " ", "1", "25", "255", "\n", "é", "4111111111111111", "10.0.0.1", "+1 (555) 123-4567", "x@y.z", "4111 1111 1111 1111", "300.1.1.1"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.choice([3, 8, 30])))
        want = sorted((m.start(), k, m.end()) for k, (n, p) in enumerate(rules.items()) for m in re.finditer(p, t) if good(n, m[0]))
        assert [(s.start, s.kind, s.end) for s in pii.candidates(t) if s.base] == want, t


BASE_RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]

    return sorted((m.start(), k, m.end()) for k, (n, p) in enumerate(BASE_RULES.items()) for m in re.finditer(p, text or "") if good(n, m[0]))


@needs_data
def test_pii_query_against_brute_force(spark):
    """Every column that the base rules fix, on whole documents; the method's spans come on top."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = pii.op3_pii(spark, LARGER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = base_spans(docs[r.doc_id])
        shown = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, x, _ in want) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(shown) <= set(spans) and len(spans) == r.n_spans == len(shown) + r.n_added
        added = [x.split(":") for x in set(spans) - set(shown)]
        assert all(kind == "secret" and docs[r.doc_id][int(a) - 9 : int(a)] == 'token = "' for kind, a, _ in added)
    assert sum(r.n_added for r in rows) == sum(len(re.findall(r'token = "[0-9a-f]{40}"', t or "")) for t in docs.values()) > 0


def test_pii_learns_to_accept_look_alikes(spark):
    """Look-alikes and secrets that several labelers are for are found, decoys of the same looks are not."""
    rng = random.Random(33)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    good = [f"please call {rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{digits(4)} now" for _ in range(40)]
    good += [f"write to joe{k} [at] mail.example.com" for k in range(40)] + [f'api_key = "{hexes(32)}"' for _ in range(40)] + [f"the password: {hexes(6)}Q{hexes(6)}!" for _ in range(40)]
    decoys = [f"part no {d}" for d in ("000-000-0000", "111-111-1111", "123-456-7890")] * 5 + [f"isbn {digits(3)}1{digits(10)}" for _ in range(30)]
    decoys += ["password = changeme123", "token: yourtokenhere", "secret = xxxxxxxxxxxx", "the token: understanding", "commit " + hexes(40), "md5 checksum " + hexes(32)] * 5
    decoys = [t for t in decoys if not base_spans(t)]
    base = [f"mail me at joe{k}@mail.example.com" for k in range(60)] + [f"phone +1 (555) 123-{k:04d}" for k in range(60)] + ["nothing here at all"] * 50
    texts = good + decoys + base
    rows = pii.digests(pii.find_spans(frame(spark, texts))).orderBy("doc_id").collect()
    found, wrong = [r.n_added for r in rows[: len(good)]], [r.n_added for r in rows[len(good) : len(good) + len(decoys)]]
    assert np.mean([n == 1 for n in found]) > 0.95 and np.mean([n > 0 for n in wrong]) < 0.05, (found, wrong)
    rest = rows[len(good) + len(decoys) :]
    assert sum(r.n_email for r in rest) == 60 and sum(r.n_phone for r in rest) == 60 and all(r.spans == "" for r in rest[-50:])
    q, theta = pii.expectation_maximisation(np.array([[1, 1, 1, 1, 1], [0, -1, 0, -1, -1]]), np.array([100.0, 50.0]))
    assert q[0] > 0.9 > 0.1 > q[1] and np.allclose(theta.sum(axis=2), 1)
    for code in (0, 5, 8000, 10_934):
        kind, votes, form = pii.read_pattern(code)
        assert ((kind * 3**5 + sum((v + 1) * 3 ** (4 - k) for k, v in enumerate(votes))) * pii.SHAPES + form) == code


def test_digest_index_takes_further_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = exact_dedup.deduplicate(frame(spark, ["a b", "ab", "c"]), index)
    assert {(r.doc_id, r.keep_id, r.kept) for r in first.collect()} == {(0, 0, True), (1, 0, False), (2, 2, True)}
    more = spark.createDataFrame([(10, "a  b"), (11, "d")], "doc_id long, text string")
    second = exact_dedup.deduplicate(more, index).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in second} == {(10, 0, False), (11, 11, True)}
    assert index.table().count() == 3
    plan = more.select(exact_dedup.text_digest(F.col("text")).alias("digest")).join(index.table().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_dac_round_trip():
    rng = np.random.default_rng(7)
    for ids in (np.zeros(0, int), np.arange(3000), rng.integers(0, 2**32, 5000), np.array([0, 255, 256, 65535, 65536, 2**32 - 1])):
        dac = token_store.Dac(token_store.Dac.pack(ids))
        assert (dac.all() == ids).all() and all(dac.get(i) == ids[i] for i in range(0, len(ids), 7))
    with pytest.raises(ValueError):
        token_store.Dac.pack(np.array([2**20]), (8, 8))
    with pytest.raises(IndexError):
        token_store.Dac(token_store.Dac.pack(np.arange(3))).get(3)


ALPHABET = "ab \"'széÉΣσ漢字🙂\n\t\x1c\x85\xa0é 0123 's 'll Straße.,!İ"


def strange_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 5, 50, 400]))) for _ in range(n)]


def test_tokens_as_the_library_gives_them():
    w = token_store.tokenizer(token_store.vocabulary_path())
    texts = strange_texts(8, 300) + ["<|endoftext|> x<|startoftext|>y", "<|ENDOFTEXT|>", "a" * 3000, "The the THE it's IT'S don't, end."]
    ids, lens = w.encode(texts)
    ends = np.concatenate([[0], np.cumsum(lens)])
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_token_store(spark):
    texts = strange_texts(9, 60)
    df = frame(spark, texts).repartition(5)
    got = token_store.read_tokens(token_store.write_tokens(df, partitions=4)).orderBy("doc_id").collect()
    t, start, flat = token_store.tokenizer(token_store.vocabulary_path()).tokenizer, 0, []
    for r in got:
        ids = [*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        flat += ids
    segments = token_store.write_tokens(df, partitions=4)
    assert [token_store.token(segments, i) for i in (0, 1, len(flat) // 2, len(flat) - 1)] == [flat[i] for i in (0, 1, len(flat) // 2, -1)]
    for i in (-1, len(flat)):
        with pytest.raises(IndexError):
            token_store.token(segments, i)


def test_other_vocabularies_are_encoded_whole():
    path = token_store.public_tokenizers.path("byte_bpe_50k.json")
    w, texts = token_store.WordTokenizer(path), strange_texts(17, 50)
    ids, lens = w.encode(texts)
    ends = np.concatenate([[0], np.cumsum(lens)])
    assert w.memo is None and token_store.tokenizer(token_store.vocabulary_path()).memo is not None
    assert all(ids[ends[k] : ends[k + 1]].tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts))


def test_touched_chunks_of_a_code():
    """An id is read from one chunk a level; the others' bytes can be anything."""
    ids = np.random.default_rng(18).integers(0, 2**17, 3000)
    dac = token_store.Dac(token_store.Dac.pack(ids))
    spoiled = []
    for k, (width, chunks, bits, directory) in enumerate(dac.levels):
        at, want = 1234, chunks.copy()
        for w, c, b, _ in dac.levels[:k]:
            at = int(np.unpackbits(b, bitorder="little")[:at].sum())
        want[np.arange(len(want)) != at] = 0
        spoiled.append((width, want, bits, directory))
    dac.levels = spoiled
    assert dac.get(1234) == ids[1234]


def test_byte_bpe_as_tiktoken_gives_it(spark):
    b = bpe.load(bpe.vocabulary_path(), bpe.public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    texts = strange_texts(10, 200) + ["a" * 3000, "ab" * 2000, "thethe" * 100, " " * 900, "1234567" * 60]
    rows = bpe.encode(frame(spark, texts)).orderBy("doc_id").collect()
    assert all(r.ids == other.encode_ordinary(texts[r.doc_id]) for r in rows)
    back = bpe.decode(bpe.encode(frame(spark, texts))).orderBy("doc_id").collect()
    assert all(bytes(r.bytes).decode() == texts[r.doc_id] for r in back)
    shown = bpe.round_trip(frame(spark, texts)).orderBy("doc_id").collect()
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, other.encode_ordinary(texts[r.doc_id]))).encode()).hexdigest() for r in shown)


def test_rolling_hashes_depend_on_words_only():
    v = np.random.default_rng(11).integers(0, 2**63, 60).astype(np.uint64)
    for width in (1, 2, 5, 20, 33):
        h = rolling(v, width, 12345)
        again = rolling(np.concatenate([v[7:], v[:7]]), width, 12345)
        assert len(h) == 60 - width + 1 and (h[7:] == again[: len(h) - 7]).all()
    assert len(rolling(v[:3], 5, 3)) == 0


def substring_brute(texts, width=20):
    seen, out = set(), []
    for t in texts:
        w = (t or "").split()
        gone = set()
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            if g in seen:
                gone |= set(range(i, i + width))
            seen.add(g)
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def test_substrings_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    passages = [random_words(rng, n, 40) for n in (20, 21, 30, 60)]
    texts = ["a " * 200, "a " * 35, "a b " * 60, None, ""]
    for k in range(80):
        texts.append(" ".join([random_words(rng, rng.choice([0, 5, 19, 40]), 40), rng.choice(passages), random_words(rng, rng.choice([0, 3, 25]), 2 if k % 9 == 0 else 40), rng.choice(passages)]))
    texts += texts[10:20]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = substring_dedup.op8_substring_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == substring_brute(texts)


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 6), (20, 20)] + [(100, 100 + k) for k in range(1, 40)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got[3] == 1 and got[10] == 6 and got[139] == 100 and 20 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_brute(texts, spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string")
    idf = near_dedup.inverse_frequencies(*near_dedup.document_frequencies(df))
    n, root = len(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        sim = near_dedup.similarities([texts[i]] * (n - i - 1), texts[i + 1 :], idf)
        for j in range(i + 1, n):
            if sim[j - i - 1] >= 0.8 or (texts[i] or "").split() == (texts[j] or "").split():
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(12):
        base = [f"t{rng.randrange(5000)}" for _ in range(rng.choice([8, 60, 120]))]
        for _ in range(rng.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
            texts.append(" ".join(w))
    texts += ["", None, "one two", "one  two"]
    got = [r.class_id for r in near_dedup.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()]
    want = near_brute(texts, spark)
    assert sum(a != b for a, b in zip(got, want)) <= 1  # bands miss a pair at 0.8 with a chance of 0.2 %


def test_large_group_is_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "GROUP", 8)
    rng = random.Random(14)
    base = [f"t{k}" for k in range(150)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 3, 6])):
            w[rng.randrange(150)] = f"e{rng.randrange(9999)}"
        texts.append(" ".join(w))
    got = [r.class_id for r in near_dedup.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()]
    assert sum(a != b for a, b in zip(got, near_brute(texts, spark))) <= 2


def test_dense_similarities_agree(monkeypatch):
    rng = random.Random(15)
    texts = [random_words(rng, n, 4) for n in (3, 8, 20, 30, 40)] + ["", "w1 w2 w3 w1 w2 w3 w1 w2 w3 w1 w2 w3"]
    idf = np.random.default_rng(0).random((near_dedup.ROWS, 1 << near_dedup.CELL_BITS)).astype(np.float32) + 1
    monkeypatch.setattr(near_dedup, "COLUMNS", 5)
    dense = near_dedup.dense_similarities(texts, idf)
    for i in range(len(texts)):
        others = np.arange(len(texts)) != i
        assert np.allclose(dense[i][others], near_dedup.similarities([texts[i]] * len(texts), texts, idf)[others], atol=1e-5)


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(16)
    a = np.sort(rng.integers(0, 2**50, 400).astype(np.uint64))
    b = np.sort(np.concatenate([a[:300], rng.integers(0, 2**50, 100).astype(np.uint64)]))
    weight = lambda s: 1 + (s % np.uint64(7)).astype(np.float32)
    sampler = near_dedup.Sampler(2000)
    x, y = (sampler.sample(np.zeros(len(s), int), s, weight(s), 1)[0] for s in (a, b))
    common = np.intersect1d(a, b)
    jaccard = weight(common).sum() / (weight(a).sum() + weight(b).sum() - weight(common).sum())
    assert abs((x == y).mean() - jaccard) < 0.04


def bundled(text):
    """Sum over the n-grams of a text, one by one, of the product of its letters' vectors, each rotated by its place."""
    out, low = np.zeros(language.DIMENSIONS), [ord(c.lower()[0]) if c.isalpha() else 0 for c in text or ""]
    s = [c for i, c in enumerate(low) if c or i == 0 or low[i - 1]]
    v = {c: language.letter_vectors(np.array([c]))[0].astype(int) for c in {0, *s}}
    for g in zip(s, s[1:], s[2:]):
        if any(g):
            out += np.roll(v[g[0]], 2) * np.roll(v[g[1]], 1) * v[g[2]]
    return out


def test_languages_against_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(19)
    alphabets = {"en": "etaoin shrdlu", "ru": "оеаин тсрвл", "ja": "日本語テキス です", "ko": "한국어 텍스트"}
    rows = []
    for k in range(120):
        lang = rng.choice(sorted(alphabets))
        rows.append((k, "".join(rng.choice(alphabets[lang]) for _ in range(rng.choice([0, 2, 40, 300]))) if k % 17 else None, lang if k % 5 else None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    vectors, held = {k: bundled(t) for k, t, _ in rows}, {k: zlib.crc32(str(k).encode()) % 4 == 2 for k, _, _ in rows}
    sums = {}
    for k, t, lang in rows:
        if lang and not held[k]:
            sums[lang] = sums.get(lang, 0) + vectors[k]
    for r in language.op10_language_id(spark, str(tmp_path)).collect():
        text, v = rows[r.doc_id][1], vectors[r.doc_id]
        cosine = {lang: v @ s / max(np.linalg.norm(v), 1e-9) / np.linalg.norm(s) for lang, s in sums.items()}
        known = any(c.isalpha() for c in text or "")
        best = max(sorted(cosine), key=cosine.get)
        assert r.held_out == held[r.doc_id] and r.lang_pred == (best if known else "und")
        assert abs(r.score - (min(max(cosine[best], 0), 1) if known else 0)) < 1e-9
    text = "".join(rng.choice("日本語 テキスト abc한국어") for _ in range(500))
    monkeypatch.setattr(language, "BLOCK_CHARS", 37)
    monkeypatch.setattr(language, "GRAMS", 11)
    got, letters = language.Profiler().bundle(["ab", text, None])
    assert (got[1] == bundled(text)).all() and letters[1] == sum(c.isalpha() for c in text) and not got[2].any()


@needs_data
def test_held_out_accuracy(spark):
    got = language.op10_language_id(spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas().merge(got)
    assert (got.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in got.doc_id]).all()
    test = docs[docs.held_out]
    assert (test.lang == test.lang_pred).mean() > 0.95


@needs_data
def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = quality.ledger(docs).filter(quality.passes("v1")).select("doc_id")
    kept = docs.join(kept, "doc_id").select(docs.columns)
    kept = kept.join(exact_dedup.deduplicate(kept).filter("kept").select("doc_id"), "doc_id").select(docs.columns)
    kept = kept.join(near_dedup.near_duplicates(kept).filter("kept").select("doc_id"), "doc_id").select(docs.columns)
    want = mixing.mix(mixing.sized_documents(kept)).filter("repeats > 0").select("doc_id", "repeats").toPandas().set_index("doc_id").repeats.to_dict()
    assert out.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict() == want
    one = out.orderBy("doc_id").first()
    b = bpe.load(bpe.vocabulary_path(), bpe.public_tokenizers.PATTERN)
    ids, _ = b.encode([docs.filter(F.col("doc_id") == one.doc_id).first().text])
    assert one.n_tokens == len(ids)
