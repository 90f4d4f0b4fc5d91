"""Token-id output as directly addressable codes: chunk levels, continuation bitmaps and rank directories."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapelake.llm.common import WORD, PieceTable, ragged, read, stored, text_blocks

#: Bits of each chunk level, lowest first; 8, 16 or 32 each, 32 in all or more.
LEVELS = (8, 8, 16)
#: Bits of a bitmap between two entries of its rank directory.
RANK_BLOCK = 512
MAGIC = b"DAC1"
#: Segments hold documents of about so many characters.
SEGMENT_CHARS = 1_000_000


class Dac:
    """A sequence of unsigned 32-bit ids as directly addressable codes.

    Level l holds chunk l of every id that needs it. Bit i of a level's bitmap says that id i goes on in the next
    level, at the place that is the number of set bits before i; the rank directory has that number for every
    RANK_BLOCK-th bit. Byte layout (little endian): magic, number of levels, length; for each level its width, its
    length, the chunks, the bitmap and the directory.
    """

    def __init__(self, blob: bytes | memoryview):
        if bytes(blob[:4]) != MAGIC:
            raise ValueError("not a token segment")
        n_levels, self.length = struct.unpack_from("<IQ", blob, 4)
        at, self.levels = 16, []
        for _ in range(n_levels):
            width, n = struct.unpack_from("<IQ", blob, at)
            at += 12
            parts = []
            for kind, count in ((np.dtype(f"<u{width // 8}"), n), (np.dtype("u1"), -(-n // 8)), (np.dtype("<u4"), -(-n // RANK_BLOCK))):
                parts.append(np.frombuffer(blob, kind, count, at))
                at += kind.itemsize * count
            self.levels.append((width, *parts))

    @staticmethod
    def pack(ids: np.ndarray, widths: tuple[int, ...] = LEVELS) -> bytes:
        rest, out, used = ids.astype(np.uint64), [], 0
        n_ids = len(rest)
        for k, width in enumerate(widths):
            chunk = (rest & np.uint64((1 << width) - 1)).astype(f"<u{width // 8}")
            rest = rest >> np.uint64(width)
            more = rest > 0
            if k == len(widths) - 1 and more.any():
                raise ValueError("an id is wider than all levels")
            bits = np.packbits(more, bitorder="little")
            blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
            directory = (np.cumsum(blocks) - blocks).astype("<u4")
            out.append(struct.pack("<IQ", width, len(chunk)) + chunk.tobytes() + bits.tobytes() + directory.tobytes())
            used += 1
            rest = rest[more]
            if not len(rest):
                break
        return MAGIC + struct.pack("<IQ", used, n_ids) + b"".join(out)

    def get(self, i: int) -> int:
        """Id i, from one chunk a level; nothing else is decoded."""
        if not 0 <= i < self.length:
            raise IndexError(i)
        value = shift = 0
        for width, chunks, bits, directory in self.levels:
            value |= int(chunks[i]) << shift
            shift += width
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK_BLOCK * RANK_BLOCK
            within = np.unpackbits(bits[first >> 3 : (i >> 3) + 1], bitorder="little")[: i - first]
            i = int(directory[first // RANK_BLOCK]) + int(within.sum())
        return value

    def all(self) -> np.ndarray:
        """Every id, as unsigned 32-bit integers."""
        out, where, shift = np.zeros(self.length, np.uint32), slice(None), 0
        for width, chunks, bits, _ in self.levels:
            out[where] |= chunks.astype(np.uint32) << np.uint32(shift)
            shift += width
            more = np.flatnonzero(np.unpackbits(bits, bitorder="little", count=len(chunks)))
            where = more if isinstance(where, slice) else where[more]
        return out


#: Stretches that are encoded apart: Latin letters before a mark or white space, marks before white space, else all
#: up to white space.
#: U+0130 is not among the letters: in lower case it ends in a mark, which joins a full stop after it.
LETTERS = r"[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u012F\u0131-\u024F]+"
STRETCH = LETTERS + r"(?=[\x20\x09-\x0D.,!?;:)]|\Z)|[.,!?;:)]+(?=[\x20\x09-\x0D]|\Z)|" + WORD


#: The rules of the vocabularies whose texts can be encoded by stretches, as their files state them.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits(rules: dict) -> bool:
    """Whether a tokenizer's rules are such that no token and no normalisation reaches over the end of a stretch."""
    normal, parted = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
    first = (parted.get("pretokenizers") or [{}])[0]
    known = first.get("pattern") == {"Regex": SPLIT_PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
    return normal.get("normalizers") == NORMALIZERS and known and rules["model"]["type"] == "BPE"


class WordTokenizer:
    """The tokenizers library over texts, with a memo of stretches of text.

    No token and no rule of normalisation of the vocabularies that `splits` accepts reaches over ASCII white space, or
    from a letter to a full stop or like mark, so the ids of a text are those of its stretches in a row. Texts of other
    vocabularies are encoded whole, without a memo.
    """

    def __init__(self, path: str):
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.stretch = Tokenizer.from_file(path), re.compile(STRETCH)
        self.letters = re.compile(LETTERS).fullmatch
        rules = json.loads(self.tokenizer.to_str())
        mark = rules["model"].get("end_of_word_suffix")
        self.lowers = '"Lowercase"' in json.dumps(rules["normalizer"])
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if mark:
            self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(mark)]] = True
        self.memo = PieceTable(self._encode, 200_000_000) if splits(rules) else None

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each stretch. Stretches are encoded as lines of texts, which costs less than as many short texts.

        A stretch of letters is one word, so its ids end with the one that ends a word; where the count of these
        shows otherwise, and for all other stretches, the offsets say which stretch an id is from.
        """
        plain = np.fromiter((self.letters(p) is not None for p in parts), bool, len(parts)) & bool(self.ends_word.any())
        out: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        letters = [parts[i] for i in np.flatnonzero(plain)]
        lines = [letters[i : i + 50] for i in range(0, len(letters), 50)]
        for i in range(0, len(lines), 200):
            for words, coded in zip(lines[i : i + 200], self.tokenizer.encode_batch_fast([" ".join(w) for w in lines[i : i + 200]], add_special_tokens=False)):
                ids = np.array(coded.ids, np.int32)
                ends = np.flatnonzero(self.ends_word[ids])
                out.append((ids, np.diff(ends, prepend=-1)) if len(ends) == len(words) and ends[-1] == len(ids) - 1 else self._by_offsets(words))
        rest = [parts[i] for i in np.flatnonzero(~plain)]
        out += [self._by_offsets(rest[i : i + 2000]) for i in range(0, len(rest), 2000)]
        ids, lens = (np.concatenate(x) for x in zip(*out))
        starts, back = np.cumsum(lens) - lens, np.argsort(order)
        return ids[ragged(starts[back], lens[back])], lens[back]

    def _by_offsets(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = self.tokenizer.encode("\n".join(parts), add_special_tokens=False)
        starts = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        places = np.fromiter((a for a, _ in coded.offsets), np.int64, len(coded.ids))
        return np.array(coded.ids, np.int32), np.bincount(np.searchsorted(starts, places, side="right"), minlength=len(parts))

    def _split(self, text: str | None) -> list[str]:
        """Stretches. Latin-1 texts are put in lower case first, as the vocabulary's own rules do, to have fewer of them."""
        if not text:
            return []
        if self.lowers and "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return self.stretch.findall(text)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if self.memo is None:
            coded = [x.ids for x in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(coded), np.int32), np.fromiter(map(len, coded), np.int64, len(coded))
        split = [self._split(t) for t in texts]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])
        ids, lens = self.memo.ids(self.memo.lookup(chain.from_iterable(split)))
        return ids, np.diff(np.concatenate([[0], np.cumsum(lens)])[ends])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def vocabulary_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


SEGMENT_SCHEMA = "part int, place long, n_docs long, n_tokens long, before long, doc_ids binary, has_id binary, lens binary, codes binary"


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int | None = 1, levels: tuple[int, ...] = LEVELS, partitions: int | None = None) -> DataFrame:
    """Encode (doc_id, text) and write the ids in ascending doc_id order as segment files; returns the segments as read back.

    Documents are dealt by ranges of doc_id and sorted; each task cuts its range into segments of about SEGMENT_CHARS
    characters, so no task holds more than a segment. A segment row has its part (range number), place within the
    part, the ids of its documents, their token counts and one Dac blob; `before` counts the tokens of the part that
    come before it. Spark's Parquet writer stores the rows, so executors need no common local folder, and without
    compression, so that `token` reads an id from the codes as they lie there. Null texts are empty, null ids come first, rows with equal ids lie side by side, an empty table gives no segments.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            keys = batch.column(0)
            for i, texts in text_blocks(batch.column(1), SEGMENT_CHARS):
                ids, lens = tokenizer(path).encode(texts)
                if end_id is not None:
                    ends = np.cumsum(lens)
                    ids = np.insert(ids, ends, end_id)
                    lens = lens + 1
                own = keys.slice(i, len(texts))
                row = (part, place, len(texts), len(ids), before, own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), np.packbits(own.is_valid().to_numpy(zero_copy_only=False)).tobytes(), Dac.pack(lens, levels), Dac.pack(ids, levels))
                kinds = (pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 4)
                yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], [f.split()[0] for f in SEGMENT_SCHEMA.split(", ")])
                place, before = place + 1, before + len(ids)

    order = F.col("doc_id").asc_nulls_first()
    chosen = docs.select("doc_id", "text")
    dealt = chosen.repartitionByRange(partitions, order) if partitions else chosen.repartitionByRange(order)
    return stored(dealt.sortWithinPartitions(order).mapInArrow(run, SEGMENT_SCHEMA), "tokens", "uncompressed")


def part_starts(segments: DataFrame) -> DataFrame:
    """(part, part_start): tokens before each part. One row per part of the write, a count that is set, not data."""
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))


def token(segments: DataFrame, i: int) -> int:
    """Id number i of the whole store: the segment that has it is found by its numbers alone, then one chunk a level is read."""
    ends = segments.join(F.broadcast(part_starts(segments)), "part").withColumn("start", F.col("before") + F.col("part_start"))
    found = ends.filter((F.col("start") <= i) & (F.col("start") + F.col("n_tokens") > i)).select("part", "place", "start").first()
    if i < 0 or found is None:
        raise IndexError(i)
    codes = segments.filter((F.col("part") == found.part) & (F.col("place") == found.place)).select("codes").first().codes
    return Dac(codes).get(i - found.start)


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the segment files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_docs"]
                valid = np.unpackbits(np.frombuffer(row["has_id"], np.uint8), count=n).astype(bool)
                lens, ids = Dac(row["lens"]).all().astype(np.int64), Dac(row["codes"]).all().astype("<u4")
                ends = np.cumsum(lens)
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lens.tolist())]
                doc_ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=~valid)
                yield pa.record_batch([doc_ids, pa.array(row["start"] + ends - lens), pa.array(lens), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = segments.join(F.broadcast(part_starts(segments)), "part").withColumn("start", F.col("before") + F.col("part_start"))
    return placed.select("n_docs", "start", "doc_ids", "has_id", "lens", "codes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(read(spark, sf_dir, "documents")))
