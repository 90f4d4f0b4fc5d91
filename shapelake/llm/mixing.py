"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapelake.llm.common import n_words_of, read, stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Hexadecimal digits of the seeded hash that name one of 4096 slices of a source, or of a slice.
SLICE_DIGITS = 3


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target), the targets summing to the sum of the sizes.

    Each source gets its weight's share but at most max_epochs times its size; what is over goes to the rest by
    weight until no source is above its cap. Sorted by cap / weight, the clamped sources are a prefix: the level
    is the first (total - caps before) / (weights from here on) that does not exceed the source's own cap / weight.
    """
    every = Window.partitionBy()
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % n + 1).cast("int"))
    caps = (
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("k", F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())))
    )
    order = Window.orderBy("k")
    level = (F.col("total") - (F.sum("cap").over(order) - F.col("cap"))) / (F.sum("weight").over(every) - F.sum("weight").over(order) + F.col("weight"))
    levels = caps.withColumn("level", level).withColumn("free", F.col("level") <= F.col("cap") / F.col("weight"))
    first = F.min(F.when(F.col("free"), F.struct("k", "level"))).over(every)
    return levels.withColumn("first", first).select(
        "source", "source_size",
        F.when(F.col("k") < F.col("first.k"), F.col("cap").cast("double")).otherwise(F.least(F.col("weight") * F.col("first.level"), F.col("cap").cast("double"))).alias("target"),
    )


def seeded(doc_id: Column, size: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"), size.cast("string")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, carried columns) -> doc_id, size, source_size, target, repeats, taken and the carried columns.

    A source whose target is r times its size takes every document floor(r) times, and once more those that come
    first by a seeded hash, until the fraction of r is reached (to within half a document). The order within a
    source is found in three steps so that no task sorts a whole source: slices of the hash space are summed, then slices
    of the slice that holds the cut, and only the rows of that one of these which holds it are ordered. Rows meet one row a source,
    so those that carry much aren't shuffled where the sources are few. Null sources are a source of their own, null
    sizes count as 0, rows alike in id and size lie side by side in the order, by a hash of what they carry. Empty
    input gives an empty result.
    """
    sized = docs.select("doc_id", "source", *carry, F.coalesce("size", F.lit(0)).cast("long").alias("size")).withColumn("key", seeded(F.col("doc_id"), F.col("size"), seed))
    sized = sized.withColumns({"slice": F.substring("key", 1, SLICE_DIGITS), "part": F.substring("key", SLICE_DIGITS + 1, SLICE_DIGITS)})
    slices = stored(sized.groupBy("source", "slice").agg(F.sum("size").alias("words")), "slices")
    targets = stored(water_fill(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs), "targets").withColumns({
        "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"),
    }).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))

    def cut_of(sums: DataFrame, limits: DataFrame, step: str) -> DataFrame:
        """limits (s, wanted, ..) with the first step of the source whose words reach beyond what is wanted, as `step`_cut, and what comes before it."""
        order = Window.partitionBy("source").orderBy(step)
        met = sums.withColumn("before", F.sum("words").over(order) - F.col("words")).join(limits.select(F.col("s").alias("l"), "wanted"), F.col("source").eqNullSafe(F.col("l")))
        first = met.filter(F.col("before") + F.col("words") > F.col("wanted")).groupBy(F.col("source").alias("f")).agg(F.min(step).alias(f"{step}_cut"), F.min("before").alias("before"))
        return limits.join(first, F.col("s").eqNullSafe(F.col("f")), "left").drop("f")

    limits = stored(cut_of(slices, targets.withColumnRenamed("source", "s"), "slice"), "limits")
    at_cut = sized.select("source", "slice", "part", "size").join(limits.select(F.col("s").alias("l"), "slice_cut"), F.col("source").eqNullSafe(F.col("l")) & (F.col("slice") == F.col("slice_cut")))
    inner = limits.select("s", (F.col("wanted") - F.col("before")).alias("wanted"))
    parts = cut_of(at_cut.groupBy("source", "part").agg(F.sum("size").alias("words")), inner, "part").select(F.col("s").alias("p"), "part_cut", F.col("before").alias("within"))
    limits = stored(limits.join(parts, F.col("s").eqNullSafe(F.col("p"))).drop("p"), "cuts")
    joined = sized.join(limits, F.col("source").eqNullSafe(F.col("s")))
    # a source without words has no cut, and its rows aren't taken once more
    compare = lambda mine, cut: F.when(F.col(mine) < F.col(cut), -1).when(F.col(mine) == F.col(cut), 0).otherwise(1)
    side = F.when(compare("slice", "slice_cut") == 0, compare("part", "part_cut")).otherwise(compare("slice", "slice_cut"))
    placed = joined.withColumn("side", side)
    within = Window.partitionBy("source", "slice", "part").orderBy("key", F.col("doc_id").asc_nulls_last(), *([F.xxhash64(*carry)] if carry else []))
    upto = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    cut = placed.filter("side = 0").withColumn("extra", F.col("before") + F.col("within") + upto <= F.col("wanted"))
    both = placed.filter("side <> 0").withColumn("extra", F.col("side") < 0).unionByName(cut)
    repeats = F.least(F.col("whole") + F.col("extra").cast("long"), F.lit(max_epochs).cast("long"))
    return both.select("doc_id", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"), *carry)


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): one pass over the texts, stored, so that later steps read numbers only."""
    return stored(docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size")), "sized")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized_documents(read(spark, sf_dir, "documents")))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (SELECT *, md5('7:' || doc_id::VARCHAR || ':' || size::VARCHAR) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
             source_size * 3 AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s),
c AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM w),
l AS (SELECT *, (total - ((sum(cap) OVER (ORDER BY k))::BIGINT - cap))
              / ((sum(weight) OVER ())::BIGINT - (sum(weight) OVER (ORDER BY k))::BIGINT + weight) AS level FROM c),
f AS (SELECT min(k) AS k0, arg_min(level, k) AS level0 FROM l WHERE level <= cap / weight),
t AS (SELECT source, source_size,
             CASE WHEN k < k0 THEN cap::DOUBLE ELSE least(weight * level0, cap::DOUBLE) END AS target FROM l, f),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
o AS (SELECT k.doc_id, k.size, u.source_size, u.target, u.whole, target - whole * u.source_size AS wanted,
             (sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS upto,
             (sum(k.size) OVER (PARTITION BY k.source, substr(key, 1, 3)))::BIGINT AS words,
             (min(key) OVER (PARTITION BY k.source, substr(key, 1, 3))) AS first_key, k.source, substr(key, 1, 3) AS slice
      FROM k JOIN u ON k.source IS NOT DISTINCT FROM u.source),
p AS (SELECT *, (min(upto - size) OVER (PARTITION BY source, slice))::BIGINT AS before FROM o),
r AS (SELECT *, least(whole + CASE WHEN before < wanted AND before + words > wanted THEN (upto - size / 2 <= wanted)::BIGINT
                             ELSE (before < wanted)::BIGINT END, 3)::BIGINT AS repeats FROM p)
SELECT doc_id, size, source_size, target, repeats, repeats * size AS taken FROM r
"""
