"""Byte-level BPE encoding and decoding in length-bucketed padded matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from shapelake.llm.common import PieceTable, map_batches, ragged, read, release, text_blocks

#: Widths of the matrices; longer pieces are merged on a heap, in the same order of merges.
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 128)
BLOCK_CHARS = 1_000_000
NO_RANK = np.int32(2**31 - 1)
HASH_BITS = 21
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Bpe:
    """Ranks of a byte-level vocabulary with a hash table from id pairs to the id they merge into."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self._hash(self._key(np.array(left), np.array(right)), np.array(merged, np.int32))
        self.pairs = dict(zip(zip(left, right), merged))
        n = max(ranks.values()) + 1
        self.token_lens = np.array([len(self.bytes_of.get(i, b"")) for i in range(n)], np.int64)
        self.token_starts = np.cumsum(self.token_lens) - self.token_lens
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(n)), np.uint8)
        self.decimal = [str(i) for i in range(n)]
        self.memo = PieceTable(self._joined)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * MULTIPLIER) >> np.uint64(64 - HASH_BITS)).astype(np.int64)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        size = 1 << HASH_BITS
        self.keys, self.values = np.full(size, 2**64 - 1, np.uint64), np.full(size, NO_RANK, np.int32)
        slots, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # linear probing: of the keys that want a free slot, the first gets it
            free = left[self.values[slots[left]] == NO_RANK]
            _, first = np.unique(slots[free], return_index=True)
            won = free[first]
            self.keys[slots[won]], self.values[slots[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slots[left] = (slots[left] + 1) & (size - 1)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of pairs, NO_RANK where a pair doesn't merge; negative ids are padding."""
        keys = self._key(left, right)
        slots = self._slot(keys)
        found, out = self.values[slots], np.full(keys.shape, NO_RANK, np.int32)
        hit = self.keys[slots] == keys
        out[hit] = found[hit]
        at = np.nonzero(~hit & (found != NO_RANK))
        while len(at[0]):
            slots[at] = (slots[at] + 1) & ((1 << HASH_BITS) - 1)
            found, hit = self.values[slots[at]], self.keys[slots[at]] == keys[at]
            out[tuple(x[hit] for x in at)] = found[hit]
            go = ~hit & (found != NO_RANK)
            at = tuple(x[go] for x in at)
        out[(left < 0) | (right < 0)] = NO_RANK
        return out

    def merge(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each piece: a piece in the vocabulary is one id, others are merged by rank."""
        out: list[np.ndarray | None] = [None] * len(texts)
        by_width: dict[int, list[tuple[int, bytes]]] = {}
        for k, t in enumerate(texts):
            b = t.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(b)) is not None:
                out[k] = np.array([rank], np.int32)
            elif len(b) > WIDTHS[-1]:
                out[k] = self._merge_long(b)
            else:
                by_width.setdefault(next(w for w in WIDTHS if w >= len(b)), []).append((k, b))
        for width, rows in by_width.items():
            block = max(1, 2_000_000 // width)
            for i in range(0, len(rows), block):
                part = rows[i : i + block]
                for (k, _), ids in zip(part, self._merge_matrix([b for _, b in part], width)):
                    out[k] = ids
        return out

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = self.merge(texts)
        return np.concatenate(coded), np.fromiter(map(len, coded), np.int64, len(coded))

    def _merge_matrix(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        """Each round merges the leftmost pair of least rank of every row; rows without a pair leave the matrix."""
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        m = np.full((len(rows), width), -1, np.int32)
        m[np.arange(width) < lens[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        r = self.lookup(m[:, :-1], m[:, 1:])
        out: list[np.ndarray | None] = [None] * len(rows)
        live, columns = np.arange(len(rows)), np.arange(width)
        while len(live):
            j = r.argmin(axis=1)
            best = r[np.arange(len(live)), j]
            done = best == NO_RANK
            if done.any():
                for k, row in zip(live[done], m[done]):
                    out[k] = row[row >= 0].copy()
                go = ~done
                live, m, r, j, best = live[go], m[go], r[go], j[go], best[go]
                if not len(live):
                    break
            n = np.arange(len(live))
            take = np.minimum(columns[None, :] + (columns[None, :] > j[:, None]), width - 1)
            last = m[:, -1].copy()
            m, r = np.take_along_axis(m, take, 1), np.take_along_axis(r, np.minimum(take[:, :-1], width - 2), 1)
            m[n, j] = best
            m[:, -1] = np.where(j == width - 1, last, -1)
            r[:, -1] = NO_RANK
            has = j < width - 1
            r[n[has], j[has]] = self.lookup(m[n[has], j[has]], m[n[has], j[has] + 1])
            has = j > 0
            r[n[has], j[has] - 1] = self.lookup(m[n[has], j[has] - 1], m[n[has], j[has]])
            used = int((m >= 0).sum(axis=1).max())
            if used < width - 1 and used >= 2:  # columns that only hold padding go
                m, r, width, columns = m[:, :used], r[:, : used - 1], used, columns[:used]
        return out

    def _merge_long(self, b: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(b, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self.pairs.get
        heap = [(p, k) for k in range(n - 1) if (p := pair((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            if ids[k] < 0 or after[k] >= n or pair((ids[k], ids[after[k]])) != rank:
                continue
            gone = after[k]
            ids[k], ids[gone], after[k] = rank, -1, after[gone]
            if after[k] < n:
                before[after[k]] = k
                if (p := pair((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (p, k))
            if before[k] >= 0 and (p := pair((ids[before[k]], ids[k]))) is not None:
                heapq.heappush(heap, (p, before[k]))
        return np.array([i for i in ids if i >= 0], np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has; null counts as empty."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        ids, lens = self.memo.ids(self.memo.lookup(chain.from_iterable(split)))
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> list[bytes]:
        """The bytes of each of the consecutive id sequences."""
        sizes = self.token_lens[ids]
        flat = self.token_bytes[ragged(self.token_starts[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lens)])].tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    """The vocabulary of a worker, read once from a tiktoken file of ranks."""
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


def forget(path: str, pattern: str) -> None:
    """Empties the memo of pieces, for the end of a task."""
    if load.cache_info().currsize:
        load(path, pattern).memo.clear()
    release()


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>), one row per row. Null and empty texts have no ids; null ids and repeated rows are kept."""
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, texts in text_blocks(batch.column(1), BLOCK_CHARS):
            ids, lens = load(path, pattern).encode(texts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32())
            yield pa.record_batch([batch.column(0).slice(i, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"doc_id {kind}, ids array<int>", lambda: forget(path, pattern))


def decode(coded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, bytes binary) of (doc_id, ids); null ids give no bytes."""
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(1)
        lens = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        out = load(path, pattern).decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lens)
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return map_batches(coded.select("doc_id", "ids"), run, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids, in one pass without a shuffle."""
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for i, texts in text_blocks(batch.column(1), BLOCK_CHARS):
            ids, lens = bpe.encode(texts)
            words = list(map(bpe.decimal.__getitem__, ids.tolist()))
            ends = np.concatenate([[0], np.cumsum(lens)]).tolist()
            shown = [sha(" ".join(words[a:b]).encode()) for a, b in zip(ends, ends[1:])]
            back = [sha(b) for b in bpe.decode(ids, lens)]
            yield pa.record_batch([batch.column(0).slice(i, len(texts)), pa.array(lens, pa.int64()), pa.array(shown, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: forget(path, pattern))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
