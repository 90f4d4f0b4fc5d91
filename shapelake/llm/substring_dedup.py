"""Substring dedup by recompression.

Rounds of recompression name runs of equal words and then pairs of neighbouring symbols. A name is a hash of what it
stands for, so a run or pair is named alike in all documents; whether two symbols pair depends on them alone (a bit of
each says left or right), so equal passages get equal symbols inside, up to the stretch at either end that the symbols'
context reaches over. Spark exchanges names twice, over the whole corpus:

* after ROUNDS rounds, those of anchors: for each window of words the symbol inside it with the least hash is its
  anchor, and an anchor that occurs once rules out all its windows;
* after LAST_ROUND rounds, those of the high-level symbols, which stand for LONG words and more: all occurrences but the
  first of one that occurs twice are repeats, so their windows are settled.

The windows that are left are compared one by one. High-level symbols and windows are equal if 128 bits of hash of
their words are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm.common import ragged, read, stored, told_apart
from shapelake.llm.wordhash import BASE_1, BASE_2, BLOCK_CHARS, Piece, forget, mix, rolling, word_blocks, word_hashes

WINDOW = 20
ROUNDS, LAST_ROUND = 4, 20
#: High-level symbols stand for so many words at least.
LONG = 80
LAST = 2**63 - 1


def runs(words: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, ...]:
    """(symbols, first, end, start, is a word's) of runs of equal words, in positions that count words with a stop before each text and after the last.

    start is the position a symbol begins at; [first, end) are those that determine it. A stop is a symbol of its own
    kind that never pairs; what depends on one has it in [first, end), which no window holds.
    """
    n, stops = len(words) + len(lens) + 1, np.concatenate([[0], np.cumsum(lens + 1)])
    sym = np.zeros(n, np.uint64)
    is_word = np.ones(n, bool)
    is_word[stops] = False
    sym[is_word] = words
    # runs depend on the words next to them
    start = np.concatenate([[True], (sym[1:] != sym[:-1]) | ~is_word[1:] | ~is_word[:-1]])
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, n))
    sym = np.where(size > 1, mix(sym[at] ^ mix(size.astype(np.uint64))), sym[at])
    return sym, np.maximum(at - 1, 0), np.minimum(at + size + 1, n), at, is_word[at]


def paired(sym: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(names, left, right, opens, closes) of round k: a symbol that opens a pair gets its name, the one that closes it goes."""
    left = ((mix(sym + np.uint64(k)) >> np.uint64(13)) & np.uint64(1)).astype(bool) & word
    right = ~left & word
    opens = np.append(left[:-1] & right[1:], False)
    closes = np.concatenate([[False], opens[:-1]])
    named = np.where(opens, mix(sym * np.uint64(3) + mix(np.append(sym[1:], np.uint64(0)))), sym)
    return named, left, right, opens, closes


def recompress(words: np.ndarray, lens: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(symbol, first, end, start, is a word's) after the rounds; see runs."""
    sym, first, end, start, word = runs(words, lens)
    for k in range(rounds):
        named, left, right, opens, closes = paired(sym, word, k)
        new_first = np.where(right & ~closes, np.concatenate([first[:1], first[:-1]]), first)
        new_end = np.where(left | opens, np.append(end[1:], end[-1:]), end)
        sym, first, end, start, word = named[~closes], new_first[~closes], new_end[~closes], start[~closes], word[~closes]
    return sym, first, end, start, word


def long_symbols(sym: np.ndarray, start: np.ndarray, word: np.ndarray, n: int, least: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) positions of all symbols of `least` words and more that the further rounds form, of what `recompress` gives on n positions."""
    begins, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(ROUNDS, LAST_ROUND):
        named, _, _, opens, closes = paired(sym, word, k)
        sym, start, word, formed = named[~closes], start[~closes], word[~closes], opens[~closes]
        end = np.append(start[1:], n)
        at = np.flatnonzero(formed & (end - start >= least))
        begins.append(start[at])
        ends.append(end[at])
    return np.concatenate(begins), np.concatenate(ends)


def anchors(words: np.ndarray, lens: np.ndarray, width: int = WINDOW) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """((text, name, from, to), (text, h, g, place, length)): anchors and high-level symbols.

    The windows of a text that start in [from, to) have the anchor of that name, which covers the words that determine
    it; a window without a symbol inside is its own anchor. A high-level symbol has the words from its place on.
    """
    sym, first, end, start, word = recompress(words, lens)
    high = long_symbols(sym, start, word, len(words) + len(lens) + 1, max(LONG, width))
    sym, first, end = sym[word], first[word], end[word]
    stops = np.concatenate([[0], np.cumsum(lens + 1)])
    flat = np.zeros(len(words) + len(lens) + 1, np.uint64)
    is_word = np.ones(len(flat), bool)
    is_word[stops] = False
    flat[is_word] = words
    many = np.maximum(lens - width + 1, 0)
    text = np.repeat(np.arange(len(lens)), many)
    place = ragged(np.zeros(len(lens), np.int64), many)
    p = stops[text] + 1 + place
    lo = before(first, len(flat) + 1)[p]
    hi = before(end, len(flat) + 2)[p + width + 1]
    arg = least_between(mix(sym ^ np.uint64(BASE_2)), lo, hi)
    # neighbouring windows with the same anchor are one row
    new = np.ones(len(p), bool)
    new[1:] = (arg[1:] != arg[:-1]) | (arg[1:] < 0) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    until = np.append(at[1:], len(p))
    a = arg[at]
    own = a < 0
    begin, stop = p[at], p[at] + width
    begin[~own], stop[~own] = first[a[~own]], end[a[~own]]
    name = ranges_hash(flat, begin, stop, BASE_1)
    h, g = (mix(ranges_hash(v, *high, base) + (high[1] - high[0]).astype(np.uint64)) for v, base in ((flat, BASE_1), (mix(flat), BASE_2)))
    inside = np.searchsorted(stops, high[0], side="right") - 1
    return (text[at], mix(name + (stop - begin).astype(np.uint64)), place[at], place[at] + until - at), (inside, h, g, high[0] - stops[inside] - 1, high[1] - high[0])


def before(points: np.ndarray, n: int) -> np.ndarray:
    """At i < n: how many of the points are below i."""
    return np.concatenate([[0], np.cumsum(np.bincount(points, minlength=n))])[:n]


def least_between(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place of the least key in each [lo, hi), the first of equal ones; -1 for empty ranges."""
    size = hi - lo
    tables = [np.arange(len(key))]
    while 2 << (len(tables) - 1) <= int(size.max(initial=0)):
        t, step = tables[-1], 1 << (len(tables) - 1)
        x, y = t, np.append(t[step:], t[len(t) - step :])
        tables.append(np.where(key[y] < key[x], y, x))
    out = np.full(len(lo), -1)
    some = np.flatnonzero(size > 0)
    level = np.log2(size[some]).astype(np.int64)
    table = np.stack(tables)
    x, y = table[level, lo[some]], table[level, hi[some] - (1 << level)]
    out[some] = np.where(key[y] < key[x], y, x)
    return out


def ranges_hash(values: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:stop] for each range, from one running sum."""
    n = len(values)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))
    inverse = np.multiply.accumulate(np.full(n, pow(base, -1, 2**64), np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * inverse)])
    return (sums[stop] - sums[start]) * powers[stop]


SCANNED = "k long, t long, n_words long, sha string, names array<long>, starts array<int>, ends array<int>, h array<long>, g array<long>, places array<int>, sizes array<int>"


def scan(docs: DataFrame, width: int = WINDOW, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of (k, t, text): k, t, n_words, sha (of its words), anchors (names, starts, ends), high-level symbols (h, g, places, sizes)."""
    names = [c.split()[0] for c in SCANNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n_words, shas = np.zeros(len(batch), np.int64), [hashlib.sha256() for _ in range(len(batch))]
            low: list[tuple[np.ndarray, ...]] = []
            high: list[tuple[np.ndarray, ...]] = []
            for block in word_blocks(batch.column(2), width - 1, most_chars):
                hashes, lens = word_hashes([x.words for x in block])
                (piece, name, a, b), (inside, h, g, place, size) = anchors(hashes, lens, width)
                row, first = np.array([x.row for x in block]), np.array([x.first for x in block])
                low.append((row[piece].astype(np.int32), name.view(np.int64), (a + first[piece]).astype(np.int32), (b + first[piece]).astype(np.int32)))
                order = np.argsort(inside, kind="stable")
                high.append((row[inside[order]].astype(np.int32), h[order].view(np.int64), g[order].view(np.int64), (place + first[inside])[order].astype(np.int32), size[order].astype(np.int32)))
                for x in block:
                    if x.own:
                        shas[x.row].update(((" " if n_words[x.row] else "") + " ".join(x.words[: x.own])).encode())
                        n_words[x.row] += x.own
            lists = []
            for found in (low, high):
                row, *columns = (np.concatenate(c) for c in zip(*found))
                offsets = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32())
                lists += [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]
            yield pa.record_batch([*batch.columns[:2], pa.array(n_words), pa.array([x.hexdigest() for x in shas], pa.string()), *lists], names)
        forget()

    return docs.mapInArrow(run, SCANNED)


def lists_of(column: pa.ListArray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of `rows`, place in the flattened column) of the members of these rows' lists; null counts as empty."""
    lens = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(rows)), lens[rows]), ragged((np.cumsum(lens) - lens)[rows], lens[rows])


def marked(ranges: pa.ListArray, block: list[Piece], begin: np.ndarray, room: np.ndarray, shift: int, n: int) -> np.ndarray:
    """Which of n places are windows in the ranges of their text: piece i has room[i] of them from begin[i] on, the first is window block[i].first - shift."""
    piece, at = lists_of(ranges, np.array([x.row for x in block]))
    origin, flat = np.array([x.first for x in block])[piece] - shift, ranges.flatten()
    edge = np.zeros(n + 1, np.int64)
    for field, sign in ((0, 1), (1, -1)):
        np.add.at(edge, begin[piece] + np.clip(flat.field(field).to_numpy()[at] - origin, 0, room[piece]), sign)
    return np.cumsum(edge[:-1]) > 0


def window_keys(found: DataFrame, width: int = WINDOW, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """(h, g, k, t, p): 128 bits of hash of each window in ranges, but not in settled, of (k, t, text, ranges, settled), and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in word_blocks(batch.column(2), width - 1, most_chars):
                hashes, lens = word_hashes([x.words for x in block])
                begin, own = np.cumsum(lens) - lens, np.array([x.own for x in block])
                open_, settled = (marked(batch.column(c), block, begin, own, 0, len(hashes)) for c in (3, 4))
                at = np.flatnonzero(open_ & ~settled)
                piece = np.searchsorted(begin, at, side="right") - 1
                row, first = np.array([x.row for x in block])[piece], np.array([x.first for x in block])[piece]
                h, g = rolling(hashes, width, BASE_1)[at], rolling(mix(hashes), width, BASE_2)[at]
                columns = [h.view(np.int64), g.view(np.int64), ks[row], ts[row], (at - begin[piece] + first).astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in columns], ["h", "g", "k", "t", "p"])
        forget()

    return found.mapInArrow(run, "h long, g long, k long, t long, p int")


def cut(found: DataFrame, width: int = WINDOW, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """(u, n_removed, kept): of (u, text, ranges, firsts), the words left when windows in ranges but not firsts go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = np.zeros(len(batch), np.int64), [[] for _ in range(len(batch))]
            firsts = batch.column(3)
            for block in word_blocks(batch.column(1), 0, most_chars):
                lens = np.fromiter((len(x.words) for x in block), np.int64, len(block))
                room = lens + width - 1  # windows that start in the piece or reach into it
                begin = np.cumsum(room) - room
                gone = marked(batch.column(2), block, begin, room, width - 1, int(room.sum()))
                piece, at = lists_of(firsts, np.array([x.row for x in block]))
                place = firsts.flatten().to_numpy()[at] - np.array([x.first for x in block])[piece] + width - 1
                here = (place >= 0) & (place < room[piece])
                gone[(begin[piece] + place)[here]] = False
                places = np.flatnonzero(gone)
                edge = np.zeros(len(gone) + width, np.int64)
                edge[places] += 1
                edge[places + width] -= 1
                stays = np.cumsum(edge) == 0
                for x, b, n in zip(block, (begin + width - 1).tolist(), lens.tolist()):
                    left = stays[b : b + n]
                    removed[x.row] += n - int(np.count_nonzero(left))
                    kept[x.row].append(" ".join(compress(x.words, left.tolist())))
            yield pa.record_batch([batch.column(0), pa.array(removed), pa.array([" ".join(filter(None, w)) for w in kept], pa.string())], ["u", "n_removed", "kept"])

    return found.mapInArrow(run, "u long, n_removed long, kept string")


def repeats_by_row(docs: DataFrame, width: int = WINDOW, most_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(summary, changed): summary has u (a number of its own), k (doc_id, null as the largest long), n_words, n_removed
    and sha of every row; changed has u, n_removed and the kept text of those that lose some words but aren't whole copies.

    A window of `width` words whose words also start earlier (smaller doc_id, then hash of the text, or earlier in the
    text) goes, with all words it covers; windows are judged on the input. Rows that are equal in their words to an
    earlier one are settled by their digest. Null texts have no words, texts under `width` words lose none, null ids come
    last. Every row is a document of its own, also where rows share an id or have none. An empty table gives no rows.
    Long texts are worked on in pieces of about most_chars that overlap, with the same result.
    """
    texts = told_apart(docs)
    seen = stored(scan(texts, width, most_chars).withColumn("u", F.monotonically_increasing_id()), "anchors", "zstd")
    leaders = stored(seen.groupBy("sha").agg(F.min(F.struct("k", "t", "u")).alias("first")).select("sha", F.col("first.u").alias("leader")), "leaders")
    marked = seen.select("u", "k", "t", "n_words", "sha").join(leaders, "sha").withColumn("copy", F.col("u") != F.col("leader"))
    summary = stored(marked, "documents")
    # of whole copies, equal names lie at equal places: they count as one occurrence
    twice = lambda place: (F.min(F.xxhash64("sha", place)) != F.max(F.xxhash64("sha", place))).alias("twice")
    named = seen.select("sha", F.explode(F.arrays_zip("names", "starts")).alias("x")).select("sha", F.col("x.names").alias("name"), F.col("x.starts").alias("a"))
    repeated = stored(named.groupBy("name").agg(twice("a")).filter("twice").select("name"), "repeated")
    # pairs of places go through shuffles as one number
    pair = lambda a, b: F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))
    pairs = lambda x: F.transform(F.collect_list(x), lambda v: F.struct(F.shiftright(v, 32).cast("int").alias("a"), v.bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("b")))
    rows = seen.select("u", F.explode(F.arrays_zip("names", "starts", "ends")).alias("x")).select("u", F.col("x.names").alias("name"), pair(F.col("x.starts"), F.col("x.ends")).alias("r"))
    ranges = rows.join(repeated.hint("merge"), "name", "left_semi").groupBy("u").agg(pairs("r").alias("ranges"))
    high = seen.select("u", "k", "t", "sha", F.explode(F.arrays_zip("h", "g", "places", "sizes")).alias("x")).select("u", "k", "t", "sha", "x.h", "x.g", F.col("x.places").alias("a"), F.col("x.sizes").alias("size"))
    # the first row of (k, t) is the leader of its copies, see above
    shared = high.groupBy("h", "g").agg(twice("a"), F.min(F.struct("k", "t", "a", "u")).alias("first")).filter("twice")
    shared = stored(shared.select("h", "g", F.col("first.u").alias("v"), F.col("first.a").alias("b")), "shared")
    later = high.select("h", "g", "u", "a", "size").join(shared.hint("merge"), ["h", "g"]).filter("u <> v OR a <> b")
    settled = later.groupBy("u").agg(pairs(pair(F.col("a"), F.col("a") + F.col("size") - (width - 1))).alias("settled"))
    # of rows alike in (k, t) at most one is no copy, so (k, t) finds its text
    ranges = stored(ranges.join(summary.filter("NOT copy").select("u", "k", "t"), "u").join(settled, "u", "left"), "ranges", "zstd")
    found = stored(texts.join(ranges.hint("merge"), ["k", "t"]).select("u", "k", "t", "text", "ranges", "settled"), "found", "zstd")
    groups = window_keys(found.select("k", "t", "text", "ranges", "settled"), width, most_chars).groupBy("h", "g").agg(F.min(F.struct("k", "t", "p")).alias("first"))
    firsts = groups.groupBy(F.col("first.k").alias("k"), F.col("first.t").alias("t")).agg(F.collect_list("first.p").alias("firsts"))
    changed = cut(found.join(firsts.hint("merge"), ["k", "t"], "left").select("u", "text", "ranges", "firsts"), width, most_chars)
    return summary, changed


def remove_repeats(docs: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """repeats_by_row with k for u and one row per id: of rows that share an id, one."""
    summary, changed = repeats_by_row(docs, width)
    ids = summary.dropDuplicates(["k"])
    return ids, changed.dropDuplicates(["u"]).join(ids.select("u", "k"), "u").select("k", "n_removed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary, changed = repeats_by_row(read(spark, sf_dir, "documents"))
    # rows alike in id and text read the same text several times
    some = changed.select("u", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["u"])
    whole = F.col("copy") & (F.col("n_words") >= WINDOW)
    return summary.join(some, "u", "left").select(
        F.when(F.col("k") != LAST, F.col("k")).alias("doc_id"), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS h FROM p),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM r WHERE k > 1),
l AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, d.w, unnest(range(1, len(d.w) + 1)) AS p FROM d JOIN l USING (doc_id)),
s AS (SELECT k.doc_id, coalesce(string_agg(CASE WHEN g.p IS NULL THEN k.w[k.p] END, ' ' ORDER BY k.p), '') AS kept, count(g.p) AS n
      FROM k LEFT JOIN g ON k.doc_id = g.doc_id AND k.p = g.p GROUP BY k.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(s.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(s.kept, array_to_string(d.w, ' '))) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""
