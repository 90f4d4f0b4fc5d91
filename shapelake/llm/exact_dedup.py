"""Exact dedup: a persistent digest index, bucketed and sorted by hash, met by sort-merge anti-join."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapelake.llm.common import SPACE_CLASS, read, shared_dir, stored

#: Buckets of a new index: one for so many rows of its first batch, at least so many.
ROWS_A_BUCKET, MIN_BUCKETS = 2_000_000, 16


def text_digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text without ASCII white space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", ""), 256)


class DigestIndex:
    """A table (digest, keep_id, group_size) of every text seen, bucketed and sorted by digest.

    The index is what the files at its path hold, whichever session wrote them; a session whose catalog lacks the
    table registers it over the files. The folder's file `_buckets` tells the number of buckets they are in; a new index
    gets one for each ROWS_A_BUCKET rows of its first batch, unless told a number.

    `resolve` finds the row that stays for each distinct text of a batch; `add` keeps of these the texts that
    the index lacks (sort-merge anti-join: the index side is read in its buckets, without a shuffle) and
    appends them; `compacted` copies an index of many appends into one with one sorted file a bucket. Null texts count
    as empty, null ids are allowed (they sort after all others), repeated rows count as copies, an empty batch appends
    nothing. Only the two named columns of a batch are read, so further columns of whatever name do no harm.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        known = self._location() if name else None
        self.path = path or known or f"{shared_dir(spark).rstrip('/')}/{self.name}"
        if known and self._qualified(known) != self._qualified(self.path):
            raise ValueError(f"table {self.name} is at {known}, not at {self.path}")

    def _location(self) -> str | None:
        """Where the session catalog has the table; None if it has none of the name."""
        if not self.spark.catalog.tableExists(self.name):
            return None
        return self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").filter("col_name = 'Location'").first().data_type

    def _folder(self, path: str):
        """(file system, path) of Hadoop."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), folder

    def _qualified(self, path: str) -> str:
        fs, folder = self._folder(path)
        return fs.makeQualified(folder).toString()

    def exists(self) -> bool:
        """Whether the folder holds texts."""
        fs, folder = self._folder(self.path)
        return fs.exists(folder) and any(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(folder))

    def _register(self, schema: StructType) -> None:
        """Make the table known to the catalog, over the files that are there. Only INSERTs follow, which leave them alone."""
        fs, folder = self._folder(self.path)
        note = self.spark._jvm.org.apache.hadoop.fs.Path(folder, "_buckets")
        if fs.exists(note):
            with_note = fs.open(note)
            self.buckets = int(with_note.readUTF())
            with_note.close()
        else:
            self.buckets = self.buckets or MIN_BUCKETS
            with_note = fs.create(note)
            with_note.writeUTF(str(self.buckets))
            with_note.close()
        if not self.spark.catalog.tableExists(self.name):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
            at = self.path.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{at}'")
        self.spark.catalog.refreshTable(self.name)  # other sessions may have added files

    def table(self) -> DataFrame:
        if self.exists():
            self._register(self.spark.read.parquet(self.path).schema)
        return self.spark.table(self.name)

    @staticmethod
    def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_chars, digest) of every row."""
        return docs.select(
            F.col(id_col).alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars"), text_digest(F.col(text_col)).alias("digest")
        )

    @staticmethod
    def resolve(digests: DataFrame) -> DataFrame:
        """One row per distinct text: longest original text stays, then smallest id. Partial sums precede the shuffle."""
        first = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("id"))
        return digests.groupBy("digest").agg(F.min(first).getField("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

    def add(self, resolved: DataFrame) -> DataFrame:
        """Append the texts the index lacks; returns the index."""
        if self.exists():
            resolved = resolved.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        else:
            self.buckets = self.buckets or max(MIN_BUCKETS, -(-resolved.count() // ROWS_A_BUCKET))
            self._register(resolved.schema)
        (
            resolved.repartitionById(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)))  # a task for each bucket writes its one file
            .write.bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).format("parquet").mode("append").saveAsTable(self.name)
        )
        return self.table()

    def of(self, digests: DataFrame) -> DataFrame:
        """(digest, keep_id, n) of each distinct digest that the index knows, n: rows of `digests` that have it. The index isn't shuffled."""
        counts = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
        return counts.join(self.table().select("digest", "keep_id").hint("merge"), "digest")

    def compacted(self, name: str, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """A copy with one sorted file a bucket, for an index that many batches were added to. The caller drops the old one."""
        new = DigestIndex(self.spark, name, path, buckets)
        if new.exists():
            raise ValueError(f"{new.path} holds an index already")
        new.add(self.table())
        return new


def batches(digests: DataFrame) -> list[DataFrame]:
    """The rows of `digests` in two batches by the length of their text, longest first, so that the row of a text that stays is in the first that has the text."""
    middle = digests.approxQuantile("n_chars", [0.5], 0.01)
    return [digests.filter(F.col("n_chars") > m) for m in middle] + [digests.filter(F.col("n_chars") <= m) for m in middle]


def keepers(digests: DataFrame, index: DigestIndex) -> DataFrame:
    """(digest, keep_id, n) of each distinct text of (doc_id, n_chars, digest), once the index has taken it in, batch by batch."""
    for batch in batches(digests) or [digests]:
        index.add(DigestIndex.resolve(batch))
    return index.of(digests)


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts already in the index keep the row they had (then no row of docs is kept for them).
    group_size counts the rows of docs with the text. Rows with the id of the row that stays and its text all count as
    that row, so the caller should use unique ids.
    """
    index = index or DigestIndex(docs.sparkSession)
    digests = stored(DigestIndex.digests(docs), "digests")
    kept = stored(keepers(digests, index), "keepers")
    # A join of two shuffled sides, so that Spark can split the copies of a text that many rows have.
    return digests.join(kept.hint("merge"), "digest").select(
        "doc_id", "keep_id", F.col("n").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept,
       h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n_chars DESC, doc_id)
"""
