"""A corpus pipeline of five stages: quality rules, exact dedup, near-dedup, source mixing and byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return
the columns that docs has. Nulls, empty tables, repeated rows and further columns are as the operators define them:
a null text fails the quality rules; of rows alike in id and text one stays (the one of the least hash, after the longest
text); a null id is an id like others. Columns can be of any type that has a hash, so not maps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm import bpe, common, exact_dedup, mixing, near_dedup, quality

POLICY = "v1"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy passes."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    return quality.ledger(packed, carry=("row",)).filter(quality.passes(POLICY)).select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text: the longest, then the one of the smallest id."""
    digests = common.stored(exact_dedup.DigestIndex.digests(docs), "digests")
    kept = exact_dedup.keepers(digests, exact_dedup.DigestIndex(spark)).select("digest", "keep_id")
    rows = docs.select(exact_dedup.text_digest(F.col("text")).alias("digest"), F.struct(*docs.columns).alias("row"))
    same = (F.col("d") == F.col("digest")) & F.col("row.doc_id").eqNullSafe(F.col("keep_id"))
    stay = rows.join(kept.withColumnRenamed("digest", "d"), same)
    longest = F.struct(-F.coalesce(F.length("row.text"), F.lit(0)), F.xxhash64("row"))
    return stay.groupBy("digest", F.col("row.doc_id").alias("id")).agg(F.min_by("row", longest).alias("row")).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, judged by its text; of rows alike in id and text one."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    kept = near_dedup.classes_by_row(packed).filter("kept").select(F.col("k").alias("__k"), F.col("t").alias("__t"))
    stay = common.told_apart(packed, "row").join(kept, (F.col("k") == F.col("__k")) & (F.col("t") == F.col("__t")), "left_semi")
    return stay.groupBy("k", "t").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    keyed = docs.select("doc_id", "source", common.n_words_of(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
    taken = mixing.mix(common.stored(keyed, "keyed"), carry=("row",)).filter("repeats > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("__n")).select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near-dedup", near_copies),
    ("source mixing", source_mix),
    ("byte-level BPE", byte_bpe),
]

#: Near-duplicates and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage{k}")
    return docs
