"""Shared pieces of the training-data operators: word rules, shared storage and batch helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that parts words, as a regular-expression class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees (spark.checkpoint.dir). Where it is unset, a local session gets a folder of its own; a cluster raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shapelake-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


_written: dict[str, list[str]] = {}


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors. See clean."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the tables that `stored` wrote in this application, and tells how many; results that read them are void from then on."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    return len(paths)


def told_apart(docs: DataFrame, *carry: str) -> DataFrame:
    """(k, t, text) and the columns to carry: k is doc_id, null as the largest long; (k, t) differs for texts that differ, also where rows share an id.

    t is a hash of the text; where no id (null is one) has several rows it is 0, which shuffles for less.
    """
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("k")
    shared = docs.select(k).groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    t = F.lit(0).cast("long") if shared.isEmpty() else F.xxhash64("text")
    return docs.select(k, t.alias("t"), "text", *carry)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def n_words_of(text: Column) -> Column:
    """Number of words (long); 0 for null."""
    return F.size(words_of(text)).cast("long")


def text_blocks(texts: pa.Array, most_chars: int = 300_000, most_texts: int = 4096) -> Iterator[tuple[int, list[str | None]]]:
    """(number of its first row, texts) of blocks of about most_chars; a longer text ends a block. Only a block's texts are Python objects at a time."""
    block: list[str | None] = []
    start = chars = 0
    for row, text in enumerate(texts):
        block.append(text.as_py())
        chars += len(block[-1] or "")
        if chars >= most_chars or len(block) >= most_texts:
            yield start, block
            start, block, chars = row + 1, [], 0
    if block:
        yield start, block


def release() -> None:
    """Gives what was freed back to the system, for the end of a task: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries lack it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, end: Callable[[], None] | None = None) -> DataFrame:
    """df.mapInArrow with a function of one batch, and one for the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)
        batch = None
        if end:
            end()

    return df.mapInArrow(run, schema)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [starts[i], starts[i] + lens[i])."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total, dtype=np.int64)


class Numbered(dict):
    """A dict that gives each unknown key the next number and notes it in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


#: What a piece takes up beside its characters: as an object, in the dict and in the arrays.
PIECE_BYTES = 130


class PieceTable:
    """Memo from text pieces to id sequences: each distinct piece is encoded once per worker.

    The table is emptied once its pieces take up `limit` bytes, so it never holds more than that and a block's pieces.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = 80_000_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index = Numbered()
        self.starts = np.zeros(1024, np.int64)
        self.lens = np.zeros(1024, np.int32)
        self.flat = np.zeros(4096, np.int32)
        self.used = self.size = 0

    def lookup(self, parts: Iterable) -> np.ndarray:
        """Row number of every part, encoding those not seen before."""
        if self.size > self.limit:
            self.clear()
        rows = np.fromiter(map(self.index.__getitem__, parts), np.int64)
        if self.index.new:
            new, self.index.new = self.index.new, []
            self.size += sum(map(len, new)) + PIECE_BYTES * len(new)
            try:
                self._add(len(self.index) - len(new), *self.encode(new))
            except BaseException:
                self.clear()
                raise
        return rows

    def _add(self, at: int, flat: np.ndarray, lens: np.ndarray) -> None:
        while at + len(lens) > len(self.starts):
            self.starts, self.lens = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lens, 2 * len(self.lens))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.lens[at : at + len(lens)] = lens
        self.starts[at : at + len(lens)] = self.used + np.cumsum(lens) - lens
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The concatenated ids of the rows, and the number of ids of each row."""
        lens = self.lens[rows]
        return self.flat[ragged(self.starts[rows], lens)], lens
