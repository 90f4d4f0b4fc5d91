"""Landmarks as CSV (`id, x, y, z`, # comments) and JSON (id, coordinates, optional description and uncertainty)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JSON_SCHEMA = "id STRING, coordinates ARRAY<DOUBLE>, description STRING, uncertainty STRUCT<stddevs: ARRAY<DOUBLE>, pcvectors: ARRAY<ARRAY<DOUBLE>>>"


def read_csv(spark: SparkSession, path: str, dim: int = 3) -> DataFrame:
    """(id, coord array<double>) with the first `dim` coordinates."""
    schema = "id STRING, " + ", ".join(f"c{k} DOUBLE" for k in range(3))
    rows = spark.read.csv(path, schema=schema, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.select("id", F.array(*[f"c{k}" for k in range(dim)]).alias("coord"))


def from_csv_lines(lines: DataFrame, column: str = "value", dim: int = 3) -> DataFrame:
    """The same from a column of text lines, as a stream or table gives them."""
    parts = F.split(F.col(column), ",")
    rows = lines.filter(~F.trim(column).startswith("#") & (F.trim(column) != ""))
    return rows.select(F.trim(F.get(parts, F.lit(0))).alias("id"), F.array(*[F.trim(F.get(parts, F.lit(k + 1))).cast("double") for k in range(dim)]).alias("coord"))


def write_csv(landmarks: DataFrame, path: str, dim: int = 3) -> None:
    """Missing coordinates are written as 0."""
    cols = [F.coalesce(F.get("coord", F.lit(k)), F.lit(0.0)).alias(f"c{k}") for k in range(3)]
    landmarks.select("id", *cols).write.mode("overwrite").csv(path)


def flat(landmark: Column, dim: int) -> list[Column]:
    return [
        landmark["id"].alias("id"), F.slice(landmark["coordinates"], 1, dim).alias("coord"), landmark["description"].alias("description"),
        landmark["uncertainty"]["stddevs"].alias("stddevs"), landmark["uncertainty"]["pcvectors"].alias("pcvectors"),
    ]


def read_json(spark: SparkSession, path: str, dim: int = 3) -> DataFrame:
    """id, coord, description, stddevs, pcvectors of a file with an array of landmarks; unknown keys are ignored."""
    rows = spark.read.json(path, schema=JSON_SCHEMA, multiLine=True)
    return rows.select(*flat(F.struct(*rows.columns), dim))


def from_json_texts(texts: DataFrame, column: str = "value", dim: int = 3) -> DataFrame:
    rows = texts.select(F.explode(F.from_json(column, f"ARRAY<STRUCT<{JSON_SCHEMA}>>")).alias("l"))
    return rows.select(*flat(F.col("l"), dim))


def write_json(landmarks: DataFrame, path: str) -> None:
    """One array of landmarks in one text file: landmark sets are small by nature."""
    has = F.col("stddevs").isNotNull()
    row = F.struct("id", F.col("coord").alias("coordinates"), "description", F.when(has, F.struct("stddevs", "pcvectors")).alias("uncertainty"))
    landmarks.agg(F.to_json(F.array_sort(F.collect_list(row))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def covariance(stddevs: Column, vectors: Column, dim: int) -> Column:
    """Column-major d x d covariance of standard deviations along axes."""
    entry = lambda i, j: F.aggregate(F.zip_with(stddevs, vectors, lambda s, v: s * s * F.get(v, F.lit(i)) * F.get(v, F.lit(j))), F.lit(0.0), lambda a, x: a + x)
    return F.array(*[entry(i, j) for j in range(dim) for i in range(dim)])
