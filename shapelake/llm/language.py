"""Language ID with hyperdimensional profiles.

A letter is a random vector of +1 and -1. An n-gram is the product of its letters' vectors, each rotated by its
place (binding); a text is the sum of its n-grams (bundling), a language the sum over its documents. A document
gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm.common import read, text_blocks
from shapelake.llm.wordhash import BASE_1, mix

DIMENSIONS = 512
NGRAM = 3
SEED = 20
BLOCK_CHARS, BLOCK_TEXTS = 400_000, 256
#: n-grams whose vectors are held at once.
GRAMS = 8192
POINTS = 0x110000


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """A vector of +1 and -1 for each code point, from bits of its hash, so every letter of every script has its own."""
    many = -(-dimensions // 64)
    words = mix(mix(points.astype(np.uint64) + np.uint64(seed << 32))[:, None] + np.arange(1, many + 1, dtype=np.uint64) * np.uint64(BASE_1))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(points), -1), axis=1)[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


class Profiler:
    """Bundles texts into hypervectors; n-grams are vectors bound once per block of texts, GRAMS at a time."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.lower = np.zeros(POINTS, np.int32)  # the letter in lower case; 0: not a letter
        letters = np.array([p for p in range(POINTS) if not 0xD800 <= p < 0xE000 and chr(p).isalpha()])
        self.lower[letters] = [ord(chr(p).lower()[0]) for p in letters.tolist()]
        self.number = np.zeros(POINTS, np.int32)
        self.present = np.zeros(POINTS, bool)
        self.place = np.zeros(1 << 24, np.int32)

    def stream(self, points: np.ndarray, owner: np.ndarray, keep_first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(letters, owner) with one 0 for what lies between and after words, and before them if a text starts so; texts are parted by their owner."""
        flat = self.lower[points]
        keep = flat > 0
        keep[1:] |= (flat[:-1] > 0) | (owner[1:] != owner[:-1])
        keep[:1] |= keep_first
        return flat[keep], owner[keep]

    def add(self, out: np.ndarray, flat: np.ndarray, owner: np.ndarray) -> None:
        """Adds the vectors of all n-grams of letters `flat` to the rows of their owners."""
        if len(flat) < NGRAM:
            return
        self.present[flat] = True
        self.present[0] = True
        points = np.flatnonzero(self.present)
        self.present[points] = False
        self.number[points] = np.arange(len(points))
        symbol, base = self.number[flat].astype(np.int64), len(points)
        n = len(flat) - NGRAM + 1
        code = symbol[:n].copy()
        for k in range(1, NGRAM):
            code = code * base + symbol[k : n + k]
        real = (owner[:n] == owner[NGRAM - 1 :]) & (code > 0)
        code, owner = code[real], owner[:n][real]
        if base**NGRAM <= len(self.place):
            self.place[code] = 1
            grams = np.flatnonzero(self.place[: base**NGRAM])
            self.place[grams] = np.arange(len(grams))
            at = self.place[code]
            self.place[grams] = 0
        else:
            grams, at = np.unique(code, return_inverse=True)
        letters = letter_vectors(points, self.dimensions, self.seed)
        rotated = [np.roll(letters, NGRAM - 1 - k, axis=1) for k in range(NGRAM)]
        for first in range(0, len(grams), GRAMS):
            some = grams[first : first + GRAMS]
            vectors = np.ones((len(some), self.dimensions), np.int8)
            for k in range(NGRAM):
                vectors *= rotated[k][some // base ** (NGRAM - 1 - k) % base]
            here = slice(None) if len(grams) <= GRAMS else (at >= first) & (at < first + GRAMS)
            counts = np.bincount(owner[here] * len(some) + (at[here] - first), minlength=len(out) * len(some)).reshape(len(out), len(some))
            out += counts.astype(np.float32) @ vectors.astype(np.float32)

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(vectors of the texts, letters in each). Sums are whole numbers below 2 ** 24 a step, so they are exact in any order."""
        out, letters = np.zeros((len(texts), self.dimensions), np.float64), np.zeros(len(texts), np.int64)
        lens = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        short = np.flatnonzero(lens <= BLOCK_CHARS)
        points = code_points("".join(texts[i] for i in short if texts[i]))
        flat, owner = self.stream(points, np.repeat(short, lens[short]), True) if len(points) else (points, points)
        if len(points):
            self.add(out, flat, owner)
            letters += np.bincount(owner[flat > 0], minlength=len(texts))
        for i in np.flatnonzero(lens > BLOCK_CHARS):  # in pieces, each with the last letters of the one before
            carry, after = np.zeros(0, np.int32), True
            for a in range(0, int(lens[i]), BLOCK_CHARS):
                points = code_points(texts[i][a : a + BLOCK_CHARS])
                flat, _ = self.stream(points, np.zeros(len(points), np.int8), after)
                letters[i] += np.count_nonzero(flat)
                after, flat = bool(self.lower[points[-1]]), np.concatenate([carry, flat])
                self.add(out[i : i + 1], flat, np.zeros(len(flat), np.int64))
                carry = flat[max(len(flat) - NGRAM + 1, 0) :]
        return out, letters


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_profilers: dict = {}


def profiler(dimensions: int, seed: int) -> Profiler:
    if (dimensions, seed) not in _profilers:
        _profilers[dimensions, seed] = Profiler(dimensions, seed)
    return _profilers[dimensions, seed]


def train(labelled: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Prototype of each non-null language: the sum of its documents' vectors, over all rows.

    Tasks bundle their own documents; partial sums of whole numbers are added by Spark for each language and
    dimension, so the result does not depend on the partitioning. What reaches the driver is one vector a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for i, texts in text_blocks(batch.column(1), BLOCK_CHARS, BLOCK_TEXTS):
                langs = np.array(batch.column(0).slice(i, len(texts)).to_pylist(), dtype=object)
                vectors, _ = profiler(dimensions, seed).bundle(texts)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0)
        for lang, v in sums.items():
            yield pa.record_batch([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v.astype(np.int64))], ["lang", "k", "v"])

    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col).mapInArrow(run, "lang string, k int, v long")
    out: dict[str, np.ndarray] = {}
    for r in rows.groupBy("lang", "k").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r.lang, np.zeros(dimensions))[r.k] = r.v
    return {k: v for k, v in out.items() if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, (carried columns), lang_pred, score. Reads doc_id and text only.

    score is the cosine with the chosen prototype, negative ones as 0. Texts that are null or have no letter, and all
    texts if nothing was learned, get `und` and 0. Ties go to the language that comes first by code point.
    """
    langs = sorted(prototypes)
    matrix = np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in langs]).T if langs else None
    dimensions = len(matrix) if langs else DIMENSIONS
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for _, texts in text_blocks(batch.column(batch.num_columns - 1), BLOCK_CHARS, BLOCK_TEXTS):
                vectors, letters = profiler(dimensions, seed).bundle(texts)
                if matrix is None:
                    names += ["und"] * len(texts)
                    scores.append(np.zeros(len(texts)))
                    continue
                norms = np.linalg.norm(vectors, axis=1)
                cosine = vectors @ matrix / np.maximum(norms, 1e-9)[:, None]
                best, known = cosine.argmax(axis=1), letters > 0
                names += [langs[b] if k else "und" for b, k in zip(best, known)]
                scores.append(np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0))
            out = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.record_batch([*out, pa.array(names, pa.string()), pa.array(np.concatenate(scores).astype(float) if scores else [], pa.float64())], ["doc_id", *carry, "lang_pred", "score"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in ("doc_id", *carry))
    return docs.select("doc_id", *carry, "text").mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", "lang")
    learn = marked.filter(~F.col("held_out") & F.col("doc_id").isNotNull()).select("lang", "text")
    return predict(marked.select("doc_id", "held_out", "text"), train(learn), carry=("held_out",))
