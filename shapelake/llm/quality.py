"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations are bit arithmetic."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm.common import SPACE_CLASS, read, words_of


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails`, a condition on the measurements, is true. Its place in the list is its bit."""

    name: str
    fails: Callable[[], Column]


def c(name: str) -> Column:
    return F.col(name)


#: The order is part of the ledger's format: new rules go to the end.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda: c("n_words") < 50),
    Rule("repeated_trigrams", lambda: 100 * c("n_repeat_words") > 50 * c("n_words")),
    Rule("symbols", lambda: 4 * c("n_symbols") > c("n_words")),
    Rule("repeated_lines", lambda: 2 * c("n_dup_lines") > c("n_lines")),
    Rule("short_words", lambda: c("word_chars") < 2 * c("n_words")),
    Rule("long_words", lambda: c("word_chars") > 20 * c("n_words")),
    Rule("capitals", lambda: 2 * c("n_capitals") > c("word_chars")),
)
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_trigrams"),
    "v1": ("few_words", "repeated_trigrams", "symbols", "repeated_lines", "short_words", "long_words", "capitals"),
}


def policy_mask(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << k for k, r in enumerate(rules) if r.name in names)


def measurements(text: Column) -> dict[str, Column]:
    """Measurements that need no words; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    return {
        "word_chars": left(SPACE_CLASS + "+"),
        "n_symbols": left(r"[^#*$%&|<>]+"),
        "n_capitals": left(r"[^\p{Lu}]+"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


#: Bits of a packed window that hold its position; the bits above hold a hash of its words.
POSITION_BITS = 26


def neighbours(df: DataFrame, sorted_col: str, same: Callable[[Column, Column], Column], value: Callable[[Column], Column], out: str) -> DataFrame:
    """Adds `out`: value(x) of those elements of the sorted array that are the same as the one before or after, ascending.

    Each array that is read more than once is a column of its own, so that it is computed once a row.
    """
    s, eq = F.col(sorted_col), F.col("__eq")
    after = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda x, y: F.coalesce(same(x, y), F.lit(False)))
    marked = F.zip_with(s, F.zip_with(eq, F.concat(F.array(F.lit(False)), eq), lambda x, y: x | y), lambda x, y: F.when(y, value(x)))
    return df.withColumn("__eq", after).withColumn(out, F.array_sort(F.filter(marked, lambda x: x.isNotNull()))).drop("__eq", sorted_col)


def repeat_positions(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds `out`: ascending positions of the 3-word windows whose words occur twice or more in the text.

    First hash and position of every window are packed into one long and sorted, a primitive sort; windows whose
    hash occurs twice (all repeated ones, rarely others) are then compared by their words.
    """
    w, h = F.col(words), F.col("__h")
    rest = lambda k: F.slice(h, k, F.greatest(F.size(h), F.lit(1)))
    triple = F.zip_with(F.zip_with(h, rest(2), lambda x, y: F.xxhash64(x, y)), rest(3), lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y)))
    packed = F.transform(F.filter(triple, lambda x: x.isNotNull()), lambda x, i: F.shiftleft(x, POSITION_BITS).bitwiseOR(i.cast("long")))
    key = lambda x: F.shiftright(x, POSITION_BITS)
    hashed = df.withColumn("__h", F.transform(w, lambda x: F.xxhash64(x))).withColumn("__s", F.sort_array(packed)).drop("__h")
    suspects = neighbours(hashed, "__s", lambda x, y: key(x) == key(y), lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int"), "__p")
    word = lambda p, k: F.get(w, p + k)
    windows = F.transform("__p", lambda p: F.struct(F.concat_ws(" ", word(p, 0), word(p, 1), word(p, 2)).alias("w"), p.alias("p")))
    exact = suspects.withColumn("__s", F.array_sort(windows)).drop("__p")
    return neighbours(exact, "__s", lambda x, y: x["w"] == y["w"], lambda x: x["p"], out)


def covered(positions: Column, width: int) -> Column:
    """Number of places covered by windows of the width at these ascending positions."""
    state = F.aggregate(
        positions,
        F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(p - a["last"], F.lit(width))).alias("n")),
    )
    return state["n"].cast("long")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, (carried columns), the measurements, and fail_bits: bit k is set if rule k fails.

    One row per input row, no shuffle, no Python. Null and blank texts measure 0 throughout and so fail few_words
    only; null ids are kept; other columns are dropped unless carried.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(F.col(id_col).alias("doc_id"), *carry, *(v.alias(k) for k, v in measurements(text).items()), words_of(text).alias("__w"))
    repeated = repeat_positions(step.withColumn("n_words", F.size("__w").cast("long")), "__w", "__r")
    measured = repeated.withColumn("n_repeat_words", covered(F.col("__r"), 3)).drop("__w", "__r")
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    # An expression that isn't deterministic keeps the optimizer from moving a caller's filter below this projection, where
    # it would evaluate the measurements again for each place that reads them.
    return measured.withColumn("fail_bits", bits.bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit(0).cast("long"))))


def passes(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy, rules)).cast("long")) == 0


def ablations(ledgered: DataFrame, policy: str | tuple[str, ...] = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule: rows that fail it, and rows that only it rejects under the policy (kept if it were left out).

    Rows are first counted by bit pattern, of which there are at most 2 ** len(rules).
    """
    mask = policy_mask(policy, rules)
    patterns = ledgered.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    bit = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(rules)]))
    spread = patterns.select("fail_bits", "n", bit.alias("r")).select("fail_bits", "n", "r.rule", "r.bit")
    return spread.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "fail_bits",
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_capitals,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
b AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (4 * n_symbols > n_words)::BIGINT
          + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT
          + 64 * (2 * n_capitals > word_chars)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 127) = 0 AS kept, fail_bits FROM b
"""
