"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF word shingles, banded and verified.

A document is a set of shingles of five words (of all its words, if it has fewer) weighted by tf * idf. The idf of a
shingle depends on the share of the documents that have it, taken as RAREST where it is less: 1 for one that all have,
2 for RAREST and less, on a logarithmic scale, so it means the same at every corpus size. Shares from RAREST on are
counted over all documents in count-min rows of a fixed size, whatever the corpus: the load that rare shingles put on
a cell is in proportion to the number of documents and is taken off. Each of HASHES samples picks one shingle and
quantised weight such that two documents pick the same with a probability equal to their weighted Jaccard similarity.
Documents that agree in a whole band of samples are candidates; the similarity of candidates is computed exactly from
their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm.common import ragged, read, stored, text_blocks, told_apart
from shapelake.llm.components import components
from shapelake.llm.wordhash import BASE_1, BLOCK_CHARS, mix, rolling, text_hashes

SHINGLE = 5
SIMILARITY = 0.8
HASHES, BAND = 48, 4
#: In buckets of three and more, pairs whose samples agree less often than this aren't compared at once but with all others of the bucket, in groups.
LEAST_AGREEMENT = 0.6
#: Members of a bucket that are compared at once in one group, and distinct shingles of these.
GROUP, GROUP_SHINGLES = 128, 200_000
#: Share of the documents below which shingles count as equally rare.
RAREST = 0.002
CELL_BITS, ROWS, SLICES = 20, 2, 64
SHINGLE_BITS = 50
SEED = 11
LAST = 2**63 - 1
#: Columns of a dense matrix of texts and shingles.
COLUMNS = 8192


def shingles(texts: list[str | None], digests: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times) of the distinct shingles of each of at most 16,384 texts, by text, then shingle."""
    hashes, lens = text_hashes(texts, digests)
    many = np.where(lens >= SHINGLE, lens - SHINGLE + 1, np.minimum(lens, 1))
    text = np.repeat(np.arange(len(lens)), many)
    begin = np.cumsum(lens) - lens
    at = np.repeat(begin, many) + ragged(np.zeros(len(lens), np.int64), many)
    rolled = rolling(hashes, SHINGLE, BASE_1)
    whole = lens[text] >= SHINGLE
    value = np.zeros(len(text), np.uint64)
    value[whole] = rolled[at[whole]]
    for k in np.flatnonzero(~whole):
        own = hashes[at[k] : at[k] + lens[text[k]]]
        value[k] = rolling(own, len(own), BASE_1)[0]
    key = np.sort((text.astype(np.uint64) << np.uint64(SHINGLE_BITS)) | (value >> np.uint64(64 - SHINGLE_BITS)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key, times = key[first], np.diff(np.append(first, len(key)))
    return (key >> np.uint64(SHINGLE_BITS)).astype(np.int64), key & np.uint64((1 << SHINGLE_BITS) - 1), times


def cells(shingle: np.ndarray, row: int) -> np.ndarray:
    """Cell of each shingle in a row of the table; rows take other bits of the hash."""
    return (mix(shingle) >> np.uint64(64 - CELL_BITS * (row + 1))).astype(np.int64) & ((1 << CELL_BITS) - 1)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(in how many documents each cell's shingles occur: ROWS x cells, number of documents with shingles), over all rows.

    Every task counts in a table of its own and sends it in compressed slices; slices are added up by slice number.
    The driver gets ROWS * 2 ** CELL_BITS counts, whatever the corpus.
    """
    size = ROWS << CELL_BITS

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros((ROWS, 1 << CELL_BITS), np.int64), 0
        for batch in batches:
            for _, texts in text_blocks(batch.column(0)):
                text, shingle, _ = shingles(texts)
                for row in range(ROWS):
                    np.add.at(table[row], cells(shingle, row), 1)
                n += len(np.unique(text))
        packer = zstandard.ZstdCompressor(1)
        if n:
            rows = [packer.compress(part.tobytes()) for part in np.split(table.astype("<i8").ravel(), SLICES)]
            yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([n] + [0] * (SLICES - 1), pa.int64()), pa.array(rows, pa.binary())], ["slice", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        docs_of: dict[int, int] = {}
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for s, n, counts in zip(*(c.to_pylist() for c in batch.columns)):
                sums[s] = sums.get(s, 0) + np.frombuffer(unpacker.decompress(counts), "<i8")
                docs_of[s] = docs_of.get(s, 0) + n
        packer = zstandard.ZstdCompressor(1)
        for s, v in sums.items():
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([docs_of[s]], pa.int64()), pa.array([packer.compress(v.tobytes())], pa.binary())], ["slice", "n", "counts"])

    schema = "slice int, n long, counts binary"
    rows = docs.select("text").mapInArrow(local, schema).repartition(SLICES, "slice").mapInArrow(add, schema).collect()
    table, n = np.zeros(size, np.int64), 0
    for r in rows:
        table[r.slice * (size // SLICES) : (r.slice + 1) * (size // SLICES)] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.counts), "<i8")
        n += r.n
    return table.reshape(ROWS, -1), n


def inverse_frequencies(table: np.ndarray, n: int) -> np.ndarray:
    """idf by row and cell, of counts less the median cell's; that of a shingle is the largest of its rows.

    1 + ln(1 / s) / ln(1 / RAREST) for a share s of the documents from RAREST to 1; fewer than RAREST count as RAREST.
    The range is kept narrow so that edits, which make rare shingles, do not outweigh what large groups of copies share.
    """
    n = max(n, 1)
    load = np.median(table, axis=1, keepdims=True)
    share = np.clip((table - load) / n, max(RAREST, 1 / n), 1)
    return (1 + np.log(1 / share) / np.log(1 / RAREST)).astype(np.float32)


def weights(shingle: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """idf of each shingle."""
    return np.maximum.reduce([idf[row][cells(shingle, row)] for row in range(len(idf))])


class Sampler:
    """Improved consistent weighted sampling with draws from tables indexed by bits of a hash of shingle and sample."""

    def __init__(self, hashes: int = HASHES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, 1 << 16).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32)
        self.beta = rng.random(1 << 16).astype(np.float32)
        self.odd = rng.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sample(self, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int) -> np.ndarray:
        """Unsigned 32-bit samples, one row for each text that has shingles (the texts are ascending in `text`)."""
        starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
        lens = np.diff(np.append(starts, len(text)))
        out = np.zeros((len(starts), len(self.odd)), np.uint32)
        if not len(starts):
            return out
        log_w, low, first = np.log(weight).astype(np.float32), np.int64(0xFFFF), np.arange(len(starts))
        row = np.repeat(first, lens)
        pick = lambda table, at: table.take(at, mode="clip")  # noqa: E731  all places are within the table
        for k, odd in enumerate(self.odd):
            z = shingle * odd
            z ^= z >> np.uint64(29)
            z *= np.uint64(0xBF58476D1CE4E5B9)
            z >>= np.uint64(16)
            z = z.view(np.int64)
            r, beta = pick(self.r, z & low), pick(self.beta, (z >> 16) & low)
            t = log_w / r
            t += beta
            np.floor(t, out=t)
            beta = np.subtract(t, beta, out=beta)
            beta *= r
            log_a = pick(self.log_c, z >> 32)
            log_a -= beta
            log_a -= r
            hit = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, starts), lens))
            at = hit if len(hit) == len(starts) else hit[np.searchsorted(row[hit], first)]
            out[:, k] = (mix(shingle[at] ^ mix(t[at].astype(np.int64).view(np.uint64) + np.uint64(k))) >> np.uint64(32)).astype(np.uint32)
        return out


_sampler = Sampler()


def band_keys(samples: np.ndarray, band: int = BAND) -> np.ndarray:
    out = []
    for k in range(samples.shape[1] // band):
        h = mix(np.full(len(samples), k + 1, np.uint64))
        for j in range(band):
            h = mix(h ^ samples[:, k * band + j].astype(np.uint64))
        out.append(h)
    return np.stack(out, axis=1).view(np.int64)


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """k, t, digest of the words, bands array<long>, samples binary, size (distinct shingles) of every row of (k, t, text); no shingles: no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in text_blocks(batch.column(2)):
                digests: list[bytes] = []
                text, shingle, times = shingles(texts, digests)
                samples = _sampler.sample(text, shingle, times * weights(shingle, idf), len(texts))
                size = np.bincount(text, minlength=len(texts))
                keys, has = band_keys(samples), size > 0
                offsets = pa.array(np.concatenate([[0], np.cumsum(has)]) * keys.shape[1], pa.int32())
                own = iter(samples)
                yield pa.record_batch([
                    batch.column(0).slice(i, len(texts)), batch.column(1).slice(i, len(texts)), pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())), pa.array([next(own).tobytes() if h else None for h in has], pa.binary()), pa.array(size, pa.int64()),
                ], ["k", "t", "digest", "bands", "samples", "size"])

    return docs.mapInArrow(run, "k long, t long, digest binary, bands array<long>, samples binary, size long")


def similarities(a: list[str | None], b: list[str | None], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts; 0 if neither has a shingle."""
    out, start = np.zeros(len(a)), 0
    while start < len(a):
        stop, chars = start, 0
        while stop < len(a) and stop < start + 256 and chars < BLOCK_CHARS:
            chars += len(a[stop] or "") + len(b[stop] or "")
            stop += 1
        (p, s, m), (q, t, n) = shingles(a[start:stop]), shingles(b[start:stop])
        key_a, key_b = (p.astype(np.uint64) << np.uint64(SHINGLE_BITS)) | s, (q.astype(np.uint64) << np.uint64(SHINGLE_BITS)) | t
        common, x, y = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
        w = lambda text, shingle, times: np.bincount(text, times * weights(shingle, idf).astype(float), stop - start)
        least = w(p[x], s[x], np.minimum(m[x], n[y]))
        out[start:stop] = least / np.maximum(w(p, s, m) + w(q, t, n) - least, 1e-12)
        start = stop
    return out


def agreement(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Adds est, the share of equal samples of a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(len(c), -1) if len(c) else np.zeros((0, 1), np.uint32) for c in batch.columns[-2:])
            yield pa.record_batch([*batch.columns[:-2], pa.array((x == y).mean(axis=1))], [*batch.schema.names[:-2], "est"])

    x, y = samples.toDF("a", "x"), samples.toDF("b", "y")
    joined = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long, est double")


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """Adds sim, the exact similarity of the texts of a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = []
            for i, texts in text_blocks(batch.column(2)):
                sims.append(similarities(texts, batch.column(3).slice(i, len(texts)).to_pylist(), idf))
            yield pa.record_batch([*batch.columns[:2], pa.array(np.concatenate(sims) if sims else [], pa.float64())], ["a", "b", "sim"])

    joined = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long, sim double")


def dense_similarities(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs of a bounded list of texts, by products of matrices of at most COLUMNS columns.

    Only shingles that two texts share need a column. The least of two counts is the sum over t of whether both reach t.
    """
    text, shingle, times = shingles(texts)
    weight = weights(shingle, idf).astype(float)
    total = np.bincount(text, times * weight, len(texts))
    _, column, many = np.unique(shingle, return_inverse=True, return_counts=True)
    shared = many[column] > 1
    least = np.zeros((len(texts), len(texts)))
    t = 1
    while (at := np.flatnonzero(shared & (times >= t))).size:
        ids, column = np.unique(shingle[at], return_inverse=True)
        order = np.argsort(column, kind="stable")
        for first in range(0, len(ids), COLUMNS):
            some = order[slice(*np.searchsorted(column[order], (first, first + COLUMNS)))]
            x = np.zeros((len(texts), min(COLUMNS, len(ids) - first)), np.float32)
            x[text[at[some]], column[some] - first] = 1
            least += (x * weights(ids[first : first + COLUMNS], idf)) @ x.T
        t += 1
    return least / np.maximum(total[:, None] + total[None, :] - least, 1e-12)


def group_links(members: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """(u, v): links between classes within buckets, of (bucket, k, c, size), comparing every pair of different classes.

    The largest class of a bucket is its main one; pairs within it need no comparison. Members are dealt by hash into
    groups of about GROUP texts and GROUP_SHINGLES shingles at most, main ones and others apart; each pair of groups (others with others, others with main)
    goes to one task, which compares all texts of the two and returns a spanning forest of what links: fewer rows than
    members, whatever the number of pairs.
    """
    parts = F.greatest(F.count(F.lit(1)) / GROUP, F.sum("size") / GROUP_SHINGLES)
    by_class = members.groupBy("bucket", "c").agg(parts.alias("m"))
    sizes = by_class.groupBy("bucket").agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("classes"))
    sizes = sizes.filter("classes > 1").select("bucket", F.col("top.c").alias("main"), F.ceil("top.m").cast("int").alias("gm"), F.ceil(F.col("n") - F.col("top.m")).cast("int").alias("go"))
    sizes = stored(sizes, "sizes")
    mixed = members.join(sizes, "bucket").withColumn("other", F.col("c") != F.col("main"))
    own = F.pmod(F.xxhash64("k"), F.when(F.col("other"), F.col("go")).otherwise(F.col("gm"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    with_main = F.transform(upto(F.col("gm")), lambda g: F.struct(F.col("own").alias("i"), F.lit("m").alias("kind"), g.alias("j")))
    with_other = F.transform(upto(F.col("go")), lambda g: F.struct(F.least("own", g).alias("i"), F.lit("o").alias("kind"), F.greatest("own", g).alias("j")))
    as_main = F.transform(upto(F.col("go")), lambda g: F.struct(g.alias("i"), F.lit("m").alias("kind"), F.col("own").alias("j")))
    dealt = mixed.withColumn("own", own).select("bucket", "k", "c", "other", F.explode(F.when(F.col("other"), F.concat(with_main, with_other)).otherwise(as_main)).alias("g"))
    rows = dealt.join(texts, "k").select("bucket", "g.i", "g.kind", "g.j", "c", "text")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sim = dense_similarities(pdf.text.tolist(), idf)
        c = pdf.c.to_numpy()
        a, b = np.nonzero(np.triu(sim >= similarity, 1) & (c[:, None] != c[None, :]))
        pairs = np.unique(np.stack([np.minimum(c[a], c[b]), np.maximum(c[a], c[b])], axis=1), axis=0)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for u, v in pairs.tolist():
            x, y = find(u), find(v)
            if x != y:
                root[y] = x
                out.append((u, v))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return rows.groupBy("bucket", "i", "kind", "j").applyInPandas(run, "u long, v long")


def classes_by_row(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """k, t (see told_apart), class (the least k of its rows), class_size and kept of every row.

    Nodes are numbers of distinct word sequences (u of one of the rows that have it), never ids, so rows that share an id
    or have none are judged by their own texts.
    """
    texts = told_apart(docs)
    idf = inverse_frequencies(*document_frequencies(texts))
    seen = stored(signatures(texts, idf).withColumn("u", F.monotonically_increasing_id()), "signatures")
    leaders = stored(seen.groupBy("digest").agg(F.min("u").alias("rep")), "leaders")
    reps = stored(seen.select("u", "k", "t", "digest").join(leaders, "digest").select("u", "k", "t", "rep"), "copies")
    rows = stored(seen.join(leaders.select(F.col("rep").alias("u")), "u").select(F.col("u").alias("k"), F.explode("bands").alias("bucket")).distinct(), "bands")
    sizes = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("least")).filter("n > 1"), "sizes")
    members = stored(rows.join(sizes.hint("merge"), "bucket"), "members")
    nodes = stored(members.select("k").distinct(), "nodes")
    own = stored(seen.join(nodes.withColumnRenamed("k", "u").hint("merge"), "u").select("u", "k", "t", "samples", "size"), "samples")
    samples = own.select(F.col("u").alias("k"), "samples")
    # rows alike in (k, t) have one text
    pool = stored(texts.join(own.select("u", "k", "t").hint("merge"), ["k", "t"]).select(F.col("u").alias("k"), "text").dropDuplicates(["k"]), "texts", "zstd")

    pairs = members.filter("k > least").groupBy(F.col("least").alias("a"), F.col("k").alias("b")).agg(F.min("n").alias("n"))
    pairs = stored(pairs, "pairs")
    close = agreement(pairs.filter("n > 2").select("a", "b"), samples).filter(F.col("est") >= LEAST_AGREEMENT).select("a", "b")
    close = close.unionByName(pairs.filter("n = 2").select("a", "b"))
    links = stored(verified(close, pool, idf).filter(F.col("sim") >= similarity).select(F.col("a").alias("u"), F.col("b").alias("v")), "verified")
    first = components(links).withColumnRenamed("node", "k")
    classes = stored(nodes.join(first, "k", "left").select("k", F.coalesce("label", "k").alias("c")), "classes")

    sized = own.select(F.col("u").alias("k"), "size")
    left = members.filter("n > 2").join(classes, "k").join(sized, "k")  # in a bucket of two the pair has been compared
    open_ = stored(left.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("bucket"), "open")
    more = stored(group_links(stored(left.join(open_.hint("merge"), "bucket").select("bucket", "k", "c", "size"), "left"), pool, idf, similarity), "links")
    second = components(more).toDF("c", "label")
    classes = classes.join(second, "c", "left").select(F.col("k").alias("rep"), F.coalesce("label", "c").alias("c"))

    ids = stored(reps.join(classes, "rep", "left").select("u", "k", "t", F.coalesce("c", "rep").alias("c")), "ids")
    counts = stored(ids.groupBy("c").agg(F.count(F.lit(1)).alias("class_size"), F.min(F.struct("k", "t", "u")).alias("least")), "counts")
    joined = ids.join(counts, "c")
    return joined.select("k", "t", F.col("least.k").alias("class"), F.col("class_size").cast("long").alias("class_size"), (F.col("u") == F.col("least.u")).alias("kept"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size, kept of every row: class_id is the least doc_id of the documents that links join.

    Documents with the same words are copies and compared once. A link joins two different texts that share a band
    and have the similarity or more. First every member of a bucket is compared with the bucket's least member, which
    joins most copies in a few comparisons each. Where a bucket then still holds several classes, all pairs of
    members of different classes are compared in groups (see group_links), so no candidate pair is left that is neither
    compared nor within one class.

    Null and blank texts are copies of each other, null ids count as the largest, every row is a document of its own
    also where rows share an id or have none (one row of a class is kept), an empty table gives no rows, other columns
    are not read.
    """
    rows = classes_by_row(docs, similarity)
    shown = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return rows.select(shown("k").alias("doc_id"), shown("class").alias("class_id"), "class_size", "kept")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
