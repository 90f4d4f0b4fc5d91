"""Chat formatting: logged snapshots that are prefixes of longer conversations collapse, the rest is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapelake.llm.common import read, stored

#: The marks around a turn of the rendered text.
TURN_START, ROLE_END, TURN_END = "<|im_start|>", "\n", "<|im_end|>\n"


def framed(value: Column) -> Column:
    """A string that no other value shares, null included."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.length(value).cast("string"), F.lit(":"), value))


def turn_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, conv, k (place of the turn, from 1), n_turns, role, text, and h, g: rolling hash of the conversation's first k turns.

    The rows of one conv_id, ordered by turn (nulls first), then role and text, make a conversation. A row without
    conv_id belongs to none and is a conversation of its own, so such rows never gather in one group. The hash of a
    prefix is the exclusive or of 120 bits of SHA-256 of each turn with its place, so one ordered pass gives it for
    every prefix, and a long conversation is never held in one value.
    """
    chosen = turns.select("conv_id", "turn", "role", "text")
    named = chosen.filter(F.col("conv_id").isNotNull()).withColumn("conv", F.concat(F.lit("="), F.col("conv_id").cast("string")))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = named.withColumn("k", F.row_number().over(order))
    alone = chosen.filter(F.col("conv_id").isNull()).withColumn("conv", F.concat(F.lit("?"), F.monotonically_increasing_id().cast("string"))).withColumn("k", F.lit(1))
    digest = F.sha2(F.concat(F.col("k").cast("string"), F.lit(":"), framed(F.col("role")), framed(F.col("text"))), 256)
    number = lambda d, at: F.conv(F.substring(d, at, 15), 16, 10).cast("long")
    hashed = lambda df: df.withColumn("d", digest).withColumns({"h": number(F.col("d"), 1), "g": number(F.col("d"), 16)}).drop("d")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed(placed).withColumns({"h": F.bit_xor("h").over(upto), "g": F.bit_xor("g").over(upto), "n_turns": F.count(F.lit(1)).over(Window.partitionBy("conv"))})
    return rolled.unionByName(hashed(alone).withColumn("n_turns", F.lit(1).cast("long")))


def rendered(turns: Column) -> Column:
    """The turns as one text; a null role is `user`, a null text empty."""
    one = lambda t: F.concat(F.lit(TURN_START), F.coalesce(t["role"], F.lit("user")), F.lit(ROLE_END), F.coalesce(t["text"], F.lit("")), F.lit(TURN_END))
    return F.concat_ws("", F.transform(turns, one))


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered of every maximal conversation.

    A conversation goes if it is a proper prefix of another, turn by turn in role and text; of equal ones the
    smallest conv_id stays (null ids last), and n_copies counts them all. A row given twice is two turns; without
    conv_id it is two equal conversations. An empty table gives no rows; other columns are not read. Only the turns
    of conversations that stay are gathered, for their text.
    """
    rows = stored(turn_hashes(turns), "turns", "zstd")
    last = F.col("k") == F.col("n_turns")
    first = F.min(F.struct(F.col("conv_id").isNull().alias("n"), "conv_id", "conv")).alias("first")
    ids = rows.filter(last).groupBy("h", "g", "k").agg(first, F.count(F.lit(1)).alias("n_copies"))
    longer = rows.filter(~last).select("h", "g", "k").distinct()
    kept = ids.join(longer, ["h", "g", "k"], "left_anti").select(F.col("first.conv").alias("conv"), "n_copies")
    stay = rows.select("conv", "conv_id", "k", "role", "text").join(kept, "conv")
    texts = stay.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.first("n_copies").cast("long").alias("n_copies"), F.array_sort(F.collect_list(F.struct("k", "role", "text"))).alias("turns"))
    return texts.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", rendered(F.col("turns")).alias("rendered"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(read(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH c AS (SELECT *, coalesce(conv_id::VARCHAR, '?' || (row_number() OVER ())::VARCHAR) AS conv FROM conversations),
t AS (
  SELECT conv, conv_id, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k, role, text,
         CASE WHEN role IS NULL THEN '-' ELSE length(role)::VARCHAR || ':' || role END
         || CASE WHEN text IS NULL THEN '-' ELSE length(text)::VARCHAR || ':' || text END AS f
  FROM c),
p AS (SELECT conv, k, md5(string_agg(f, '' ORDER BY k) OVER (PARTITION BY conv ORDER BY k)) AS h FROM t),
w AS (SELECT conv, max(k) AS n, arg_max(h, k) AS h FROM p GROUP BY conv),
l AS (SELECT DISTINCT p.h FROM p JOIN w USING (conv) WHERE p.k < w.n),
i AS (SELECT conv, any_value(conv_id) AS conv_id FROM t GROUP BY conv),
g AS (SELECT arg_min(w.conv, (conv_id IS NULL, conv_id, w.conv)) AS conv, any_value(n) AS n_turns, count(*) AS n_copies
      FROM w JOIN i USING (conv) WHERE h NOT IN (SELECT h FROM l) GROUP BY h),
r AS (SELECT conv, string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
      FROM t GROUP BY conv)
SELECT conv_id, n_turns::BIGINT AS n_turns, n_copies::BIGINT AS n_copies, rendered FROM g JOIN r USING (conv) JOIN i USING (conv)
"""
