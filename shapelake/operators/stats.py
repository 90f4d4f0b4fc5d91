"""Aggregations: centroids, boxes, moments, integrals, losses, histograms and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelake.functions.scalar import bspline
from shapelake.functions.vector import Vec


def center_of_mass(points: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names])


def bounding_box(points: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """min_ and max_ of each coordinate, extents and volume."""
    box = points.groupBy(*by).agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("min", F.min), ("max", F.max))])
    extent = [F.col(f"max_{n}") - F.col(f"min_{n}") for n in names]
    volume = extent[0]
    for e in extent[1:]:
        volume = volume * e
    return box.withColumn("volume", volume)


def moments(points: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n, mean_x and cov_x_y (divided by n - 1; by 1 for a single row)."""
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"mean_{a}") for a in names]]
    aggs += [F.coalesce(F.covar_samp(a, b), F.lit(0.0)).alias(f"cov_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return points.groupBy(*by).agg(*aggs)


def integrate_scalar(samples: DataFrame, value: Column, density: Column) -> DataFrame:
    """Sum of f / p over N; undefined values count as 0."""
    return samples.agg(F.try_divide(F.sum(F.coalesce(value, F.lit(0.0)) / density), F.count(F.lit(1))).alias("integral"))


def integrate_vector(samples: DataFrame, value: Vec, density: Column, names: Sequence[str]) -> DataFrame:
    """As integrate_scalar for each component, but over N - 1; NULL for fewer than two samples."""
    return samples.agg(*[F.try_divide(F.sum(F.coalesce(v, F.lit(0.0)) / density), F.count(F.lit(1)) - 1).alias(n) for v, n in zip(value.parts, names)])


def mean_squares(residual: Column) -> Column:
    return F.avg(F.coalesce(residual * residual, F.lit(0.0)))


def huber(residual: Column, delta: float = 1.345) -> Column:
    """Mean Huber loss. The test is residual < delta without an absolute value, so large negative residuals stay quadratic."""
    loss = F.when(residual < delta, residual * residual / 2).otherwise(delta * (residual - delta / 2))
    return F.avg(F.coalesce(loss, F.lit(0.0)))


def joint_histogram(samples: DataFrame, fixed: str, moving: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """(by.., f, m, p): Parzen histogram; order 0 in the fixed value, order 3 in the moving one. Ranges are max + 1 - min.

    A row adds to at most four moving bins, which are exploded before a partially aggregated sum. by: columns of few
    values, each with a histogram of its own.
    """
    box = samples.groupBy(*by).agg(*[g(c).alias(f"{k}_{c}") for c in (fixed, moving) for k, g in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias("n"))
    width = lambda c: (F.col(f"hi_{c}") + 1 - F.col(f"lo_{c}")) / bins
    chosen = samples.select(*by, fixed, moving)
    placed = chosen.join(F.broadcast(box), list(by)) if by else chosen.crossJoin(F.broadcast(box))
    rows = placed.select(*by, F.floor((F.col(fixed) - F.col(f"lo_{fixed}")) / width(fixed)).alias("f"), ((F.col(moving) - F.col(f"lo_{moving}")) / width(moving)).alias("x"), "n")
    taps = F.explode(F.array(*[F.floor("x") + k for k in (-1, 0, 1, 2)])).alias("m")
    weighted = rows.select(*by, "f", "x", "n", taps).withColumn("w", bspline(F.col("x") - F.col("m"), 3) / F.col("n"))
    return weighted.filter("w > 0").groupBy(*by, "f", "m").agg(F.sum("w").alias("p"))


def mutual_information(joint: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., neg_mi): negated mutual information of joint histograms, the value to minimise."""
    pf, pm = joint.groupBy(*by, "f").agg(F.sum("p").alias("pf")), joint.groupBy(*by, "m").agg(F.sum("p").alias("pm"))
    both = joint.join(pf, [*by, "f"]).join(pm, [*by, "m"])
    return both.groupBy(*by).agg((-F.sum(F.col("p") * F.log(F.col("p") / (F.col("pf") * F.col("pm"))))).alias("neg_mi"))


def shuffle_key(key: Column, seed: int) -> Column:
    """A number that orders ids at random, by integer arithmetic that any SQL engine repeats."""
    return F.pmod((key + seed) * 1103515245 + 12345, F.lit(2147483648))


def folds(items: DataFrame, key: str, n_folds: int, n_items: int, seed: int = 0) -> DataFrame:
    """Adds fold: items in seeded order in groups of n_items div n_folds; what is left over has fold NULL (never tested).

    The order is numbered range by range (see numbered), so no task sorts all items.
    """
    from shapelake.operators.mesh import numbered

    size = n_items // n_folds
    placed = numbered(items.withColumn("__s", F.struct(shuffle_key(F.col(key), seed).alias("s"), F.col(key).alias("k"))), "__s", "__o")
    return placed.withColumn("fold", F.when(F.col("__o") < size * n_folds, F.floor(F.col("__o") / size))).drop("__o", "__s")


def gaussian_log_density(x: Column, mean: float, sd: float) -> Column:
    z = (x - mean) / sd
    return -z * z / 2 - F.log(F.lit(sd * (2 * 3.141592653589793) ** 0.5))


def log_pdf_2d(v: Vec, mean: Vec, cxx: Column, cxy: Column, cyy: Column) -> Column:
    """NULL for a singular covariance."""
    return -mahalanobis2_2d(v, mean, cxx, cxy, cyy) / 2 - F.log(cxx * cyy - cxy * cxy) / 2 - F.log(F.lit(2 * 3.141592653589793))


def mahalanobis2_2d(v: Vec, mean: Vec, cxx: Column, cxy: Column, cyy: Column) -> Column:
    d = v - mean
    return F.try_divide(cyy * d[0] * d[0] - 2 * cxy * d[0] * d[1] + cxx * d[1] * d[1], cxx * cyy - cxy * cxy)


def rigid_2d(pairs: DataFrame, scaled: bool = False) -> DataFrame:
    """angle, scale, tx, ty of the least-squares transformation of (ax, ay) to (bx, by), from one pass of moments."""
    m = pairs.agg(
        *[F.avg(c).alias(f"m{c}") for c in ("ax", "ay", "bx", "by")], *[F.covar_pop(a, b).alias(f"{a}{b}") for a in ("ax", "ay") for b in ("bx", "by")],
        (F.var_pop("ax") + F.var_pop("ay")).alias("va"),
    )
    s, c = F.col("axby") - F.col("aybx"), F.col("axbx") + F.col("ayby")
    k = F.try_divide(F.sqrt(s * s + c * c), F.col("va")) if scaled else F.lit(1.0)
    step = m.withColumn("angle", F.atan2(s, c)).withColumn("scale", k)
    turn = lambda a, b: F.col("scale") * (F.cos("angle") * a + F.sin("angle") * b)
    return step.select("angle", "scale", (F.col("mbx") - turn(F.col("max"), -F.col("may"))).alias("tx"), (F.col("mby") - turn(F.col("may"), F.col("max"))).alias("ty"))
