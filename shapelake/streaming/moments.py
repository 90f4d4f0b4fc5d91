"""Running moments of a stream, by window and key, mergeable across micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(stream: DataFrame, time: str, value: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, key, n, mean and var_samp of each window; works on streams (watermarked) and on tables alike."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    groups = rows.groupBy(F.window(time, window).alias("w"), by)
    return groups.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")).select(F.col("w.start").alias("start"), by, "n", "mean", "var")


def chain_log(stream: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Acceptance ratio of each proposal in a stream of chain rows (ts, generated_by, accepted)."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(time, window).alias("w"), "generated_by").agg(F.avg(F.col("accepted").cast("int")).alias("ratio"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "generated_by", "ratio", "n")
