"""Point distribution models: PCA of shapes in correspondence, as tables with one row for each point."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelake.storage import saved
from shapelake.plans.gp import distributed_regression
from shapelake.plans.linalg import fix_signs

XYZ = ("x", "y", "z")


@dataclass(frozen=True)
class ShapeModel:
    """points: (point_id, component, mean, basis array<double>) of displacements from the reference (point_id, coordinates).

    names: the components, which are columns of the reference: ("x", "y") for a 2-D model, ("value",) with a reference
    value for an intensity model, displacement columns of 0 for a deformation model.
    """

    reference: DataFrame
    points: DataFrame
    variance: np.ndarray
    cells: DataFrame | None = None
    names: tuple[str, ...] = XYZ

    @property
    def rank(self) -> int:
        return len(self.variance)

    def displacement(self, a: Sequence[float]) -> DataFrame:
        """(point_id, component, value) of the instance with these coefficients."""
        value = F.col("mean")
        for k, x in enumerate(a):
            value = value + F.get("basis", F.lit(k)) * float(x * math.sqrt(self.variance[k]))
        return self.points.select("point_id", "component", value.alias("value"))

    def instance(self, a: Sequence[float]) -> DataFrame:
        """Points of the shape with these coefficients."""
        wide = self.displacement(a).groupBy("point_id").agg(*[F.sum(F.when(F.col("component") == k, F.col("value"))).alias(f"d{n}") for k, n in enumerate(self.names)])
        return self.reference.join(wide, "point_id").select("point_id", *[(F.col(n) + F.coalesce(f"d{n}", F.lit(0.0))).alias(n) for n in self.names])

    def mean(self) -> DataFrame:
        return self.instance(())

    def sample(self, seed: int = 0) -> DataFrame:
        return self.instance(np.random.default_rng(seed).standard_normal(self.rank))

    def truncate(self, rank: int) -> ShapeModel:
        return ShapeModel(self.reference, self.points.withColumn("basis", F.slice("basis", 1, rank)), self.variance[:rank], self.cells, self.names)

    def logpdf(self, a: np.ndarray) -> float:
        return float(-0.5 * (np.dot(a, a) + len(a) * math.log(2 * math.pi)))

    def pdf(self, a: np.ndarray) -> float:
        return math.exp(self.logpdf(a))

    def covariance(self) -> DataFrame:
        """(point_id, i, j, cov) of each point's displacement."""
        scaled = F.transform("basis", lambda x, k: x * F.sqrt(F.get(F.array(*[F.lit(float(v)) for v in self.variance]), k)))
        rows = self.points.select("point_id", "component", scaled.alias("q"))
        dot = F.aggregate(F.zip_with("q", "r", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return rows.withColumnsRenamed({"component": "i"}).join(rows.select("point_id", F.col("component").alias("j"), F.col("q").alias("r")), "point_id").select("point_id", "i", "j", dot.alias("cov"))

    def _residuals(self, observed: DataFrame) -> DataFrame:
        ref = self.reference.select("point_id", *[F.col(n).alias(f"r{n}") for n in self.names])
        parts = F.array(*[F.struct(F.lit(k).alias("component"), (F.col(n) - F.col(f"r{n}")).alias("value")) for k, n in enumerate(self.names)])
        long = observed.join(ref, "point_id").select("point_id", F.explode(parts).alias("p")).select("point_id", "p.*")
        roots = F.array(*[F.lit(float(math.sqrt(v))) for v in self.variance])
        joined = long.join(self.points, ["point_id", "component"]).filter(F.col("value").isNotNull() & ~F.isnan("value"))
        return joined.select(F.zip_with("basis", roots, lambda x, y: x * y).alias("q"), (F.col("value") - F.col("mean")).alias("y"))

    def coefficients(self, shape: DataFrame, noise: float = 1e-5) -> np.ndarray:
        return distributed_regression(self._residuals(shape), "q", "y", noise)[0]

    def project(self, shape: DataFrame) -> DataFrame:
        return self.instance(self.coefficients(shape))

    def posterior(self, observed: DataFrame, noise: float = 1.0) -> ShapeModel:
        """Conditioned on positions of some points; NaN and missing coordinates are left out."""
        a, cov = distributed_regression(self._residuals(observed), "q", "y", noise)
        d = np.sqrt(self.variance)
        values, u = np.linalg.eigh(d[:, None] * cov * d[None, :])
        order = np.argsort(values)[::-1]
        return self._rebased(u[:, order], np.maximum(values[order], 0), a * d)

    def _rebased(self, u: np.ndarray, variance: np.ndarray, shift: np.ndarray) -> ShapeModel:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                b = np.stack(pdf.basis.to_numpy()) if len(pdf) else np.zeros((0, len(shift)))
                yield pd.DataFrame({"point_id": pdf.point_id, "component": pdf.component, "mean": pdf["mean"] + b @ shift, "basis": list(b @ u)})

        return ShapeModel(self.reference, self.points.mapInPandas(run, "point_id long, component int, mean double, basis array<double>"), variance, self.cells, self.names)

    def marginal(self, point_ids: DataFrame) -> ShapeModel:
        keep = point_ids.select("point_id")
        return ShapeModel(self.reference.join(keep, "point_id", "left_semi"), self.points.join(keep, "point_id", "left_semi"), self.variance, None, self.names)

    def change_reference(self, reference: DataFrame) -> ShapeModel:
        """The same shapes as displacements from another reference with the same ids."""
        old = self.reference.select("point_id", F.posexplode(F.array(*self.names)).alias("component", "o"))
        new = reference.select("point_id", F.posexplode(F.array(*self.names)).alias("component", "n"))
        both = self.points.join(old, ["point_id", "component"]).join(new, ["point_id", "component"])
        return ShapeModel(reference, both.select("point_id", "component", (F.col("mean") + F.col("o") - F.col("n")).alias("mean"), "basis"), self.variance, self.cells, self.names)

    def transform(self, rigid) -> ShapeModel:
        """All shapes moved by a rigid transformation: the basis vectors turn with it."""
        m = rigid.linear
        reference = rigid.on(self.reference, self.names)
        wide = self.points.groupBy("point_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("component", "mean", "basis"))), lambda s: F.struct(s["mean"].alias("mean"), s["basis"].alias("basis"))).alias("c"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for p, cs in zip(pdf.point_id, pdf.c):
                    mean, basis = m @ np.array([x["mean"] for x in cs]), m @ np.stack([x["basis"] for x in cs])
                    rows += [(p, k, float(mean[k]), basis[k]) for k in range(len(m))]
                yield pd.DataFrame(rows, columns=["point_id", "component", "mean", "basis"])

        return ShapeModel(reference, wide.mapInPandas(run, "point_id long, component int, mean double, basis array<double>"), self.variance, self.cells, self.names)

    def augment(self, extra: DataFrame, variance: np.ndarray) -> ShapeModel:
        """Adds basis vectors (point_id, component, basis) of given variances, made orthonormal with the old ones."""
        joined = self.points.join(extra.withColumnRenamed("basis", "more"), ["point_id", "component"]).select("point_id", "component", "mean", F.concat("basis", "more").alias("basis"))
        d = np.sqrt(np.concatenate([self.variance, variance]))
        gram = gram_of(joined, "basis", len(d)) * d[:, None] * d[None, :]
        values, v = np.linalg.eigh(gram)
        order = np.argsort(values)[::-1]
        order = order[values[order] > 1e-12 * max(values.max(), 1e-300)]
        turn = d[:, None] * v[:, order] / np.sqrt(values[order])
        return ShapeModel(self.reference, joined, np.zeros(len(d)), self.cells, self.names)._rebased(turn, values[order], np.zeros(len(d)))


def gram_of(rows: DataFrame, column: str, r: int) -> np.ndarray:
    """Sum over rows of v vt for an array column of length r. Each task sends its sum once, as r compressed rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((r, r))
        for pdf in batches:
            if len(pdf):
                q = np.stack(pdf[column].to_numpy())
                total += q.T @ q
        yield pd.DataFrame({"k": np.arange(r), "v": [x.tobytes() for x in total]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, v in zip(pdf.k, pdf.v):
                sums[k] = sums.get(k, 0.0) + np.frombuffer(v)
        yield pd.DataFrame({"k": list(sums), "v": [x.tobytes() for x in sums.values()]}) if sums else pd.DataFrame({"k": np.zeros(0, int), "v": []})

    parts = rows.select(column).mapInPandas(run, "k int, v binary").repartition(min(r, 64), "k").mapInPandas(add, "k int, v binary")
    out = np.zeros((r, r))
    for row in parts.collect():
        out[row.k] = np.frombuffer(bytes(row.v))
    return out


#: The smaller of the numbers of items and of coordinates of a PCA, whose square the driver holds, is at most this.
MOST_SIDE = 20_000
#: Coordinates of an item that are summed in one task.
SPLIT = 200_000


def pca_model(reference: DataFrame, shapes: DataFrame, cells: DataFrame | None = None, rank: int | None = None, names: Sequence[str] = XYZ) -> ShapeModel:
    """Model of (item_id, point_id, components) shapes in correspondence with the reference; at least 3 items.

    Every item has every point of the reference, else ValueError. Where items are fewer than coordinates, their Gram
    matrix is summed over the points and its eigenvectors are projected back point by point; else the covariance of
    the coordinates is summed over the items. Either way the larger side stays a table; variances are divided by n - 1.
    """
    names, d = tuple(names), len(names)
    ref = reference.select("point_id", *[F.col(c).alias(f"r{c}") for c in names])
    parts = F.array(*[F.struct(F.lit(k).alias("component"), (F.col(c) - F.col(f"r{c}")).alias("v")) for k, c in enumerate(names)])
    long = shapes.join(ref, "point_id").select("item_id", "point_id", F.explode(parts).alias("p")).select("item_id", "point_id", "p.component", "p.v")
    rows = long.groupBy("point_id", "component").agg(F.avg("v").alias("mean"), F.count("v").alias("n")).transform(saved)
    n, points = shapes.select("item_id").distinct().count(), reference.count()
    least, most, coordinates = rows.agg(F.min("n"), F.max("n"), F.count(F.lit(1))).first()
    if n < 3:
        raise ValueError("at least three items are needed")
    if (least, most, coordinates) != (n, n, points * d):
        raise ValueError("items and reference differ in their points")
    if min(n, coordinates) > MOST_SIDE:
        raise ValueError(f"more than {MOST_SIDE} items and coordinates")
    centred = long.join(rows.select("point_id", "component", "mean"), ["point_id", "component"]).withColumn("v", F.col("v") - F.col("mean"))
    wanted = n - 1 if rank is None else min(rank, n - 1)

    def chosen(values: np.ndarray) -> np.ndarray:
        order = np.argsort(values)[::-1][:wanted]
        return order[values[order] > 1e-12 * max(values.max(), 1e-300)]

    if n <= coordinates:
        gathered = centred.groupBy("point_id", "component").agg(F.first("mean").alias("mean"), F.transform(F.array_sort(F.collect_list(F.struct("item_id", "v"))), lambda s: s["v"]).alias("vs")).transform(saved)
        values, v = np.linalg.eigh(gram_of(gathered, "vs", n))
        order = chosen(values)
        v = fix_signs(v[:, order]) / np.sqrt(values[order])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                b = np.stack(pdf.vs.to_numpy()) @ v if len(pdf) else np.zeros((0, v.shape[1]))
                yield pd.DataFrame({"point_id": pdf.point_id, "component": pdf.component, "mean": pdf["mean"], "basis": list(b)})

        basis = gathered.mapInPandas(run, "point_id long, component int, mean double, basis array<double>")
    else:
        gathered = centred.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("point_id", "component", "v"))), lambda s: s["v"]).alias("vs"))
        values, v = np.linalg.eigh(gram_of(gathered, "vs", coordinates))
        order = chosen(values)
        v = fix_signs(v[:, order])
        keys = sorted((r.point_id, r.component, r["mean"]) for r in rows.collect())
        basis = reference.sparkSession.createDataFrame([(p, c, m, x.tolist()) for (p, c, m), x in zip(keys, v)], "point_id long, component int, mean double, basis array<double>")
    return ShapeModel(reference, basis, values[order] / (n - 1), cells, names)


def procrustes(shapes: DataFrame, target: DataFrame) -> DataFrame:
    """Each item of (item_id, point_id, x, y, z) moved rigidly onto the target (point_id, x, y, z).

    One pass of moments for each item (9 covariances, 6 means), a 3 x 3 SVD for each item's row, and a join back.
    """
    t = target.select("point_id", *[F.col(c).alias(f"t{c}") for c in XYZ])
    joined = shapes.join(t, "point_id")
    m = joined.groupBy("item_id").agg(*[F.avg(c).alias(f"m{c}") for c in XYZ], *[F.avg(f"t{c}").alias(f"n{c}") for c in XYZ], *[F.covar_pop(a, f"t{b}").alias(f"c{a}{b}") for a in XYZ for b in XYZ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                cov = np.array([[getattr(row, f"c{a}{b}") for b in XYZ] for a in XYZ])
                turn, shift = fit_rotation(cov, np.array([row.mx, row.my, row.mz]), np.array([row.nx, row.ny, row.nz]))
                out.append((row.item_id, turn.ravel(), shift))
            yield pd.DataFrame(out, columns=["item_id", "m", "s"])

    fits = m.mapInPandas(run, "item_id long, m array<double>, s array<double>")
    moved = [sum((F.get("m", F.lit(3 * i + j)) * F.col(c) for j, c in enumerate(XYZ)), F.get("s", F.lit(i))).alias(n) for i, n in enumerate(XYZ)]
    return shapes.join(fits, "item_id").select("item_id", "point_id", *moved)


def fit_rotation(cov: np.ndarray, mean: np.ndarray, target_mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift from the covariance of source with target; a reflection flips the last axis."""
    u, _, vt = np.linalg.svd(cov.T)
    s = np.eye(len(mean))
    s[-1, -1] = np.sign(np.linalg.det(u @ vt)) or 1.0
    turn = u @ s @ vt
    return turn, target_mean - turn @ mean


def gpa(shapes: DataFrame, iterations: int = 3, halt: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """Generalised Procrustes: align all items to their mean, again and again; returns aligned shapes and mean."""
    mean_of = lambda df: df.groupBy("point_id").agg(*[F.avg(c).alias(c) for c in XYZ])
    first = shapes.agg(F.min("item_id")).first()[0]
    mean = shapes.filter(F.col("item_id") == first).select("point_id", *XYZ)
    aligned = shapes
    for _ in range(iterations):
        aligned = procrustes(shapes, mean).transform(saved)
        new = mean_of(aligned).transform(saved)
        old = mean.toDF("point_id", "a", "b", "c")
        moved = new.join(old, "point_id").agg(F.avg(F.sqrt((F.col("x") - F.col("a")) ** 2 + (F.col("y") - F.col("b")) ** 2 + (F.col("z") - F.col("c")) ** 2))).first()[0]
        mean = new
        if moved is None or moved < halt:
            break
    return aligned, mean


def cross_validate(reference: DataFrame, shapes: DataFrame, folds: DataFrame, evaluate) -> list:
    """evaluate(model, test shapes) for each fold of (item_id, fold); rows without a fold are never tested."""
    out = []
    for row in folds.filter("fold IS NOT NULL").select("fold").distinct().orderBy("fold").collect():
        test = folds.filter(F.col("fold") == row.fold).select("item_id")
        out.append(evaluate(pca_model(reference, shapes.join(test, "item_id", "left_anti")), shapes.join(test, "item_id", "left_semi")))
    return out


def distance(a: Sequence[str], b: Sequence[str]) -> Column:
    return F.sqrt(sum(((F.col(x) - F.col(y)) ** 2 for x, y in zip(a, b)), F.lit(0.0)))


def projections(model: ShapeModel, shapes: DataFrame, noise: float = 1e-5) -> DataFrame:
    """(item_id, a): the coefficients of every item of (item_id, point_id, components), each from the sum of its normal equations.

    Rows of an item meet in SPLIT coordinates or less a task, where they are summed; the sums of an item's parts are then added.
    """
    r = model.rank
    ref = model.reference.select("point_id", *[F.col(c).alias(f"r{c}") for c in model.names])
    parts = F.array(*[F.struct(F.lit(k).alias("component"), (F.col(c) - F.col(f"r{c}")).alias("value")) for k, c in enumerate(model.names)])
    long = shapes.join(ref, "point_id").select("item_id", "point_id", F.explode(parts).alias("p")).select("item_id", "point_id", "p.*")
    joined = long.join(model.points, ["point_id", "component"]).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    splits = -(-model.reference.count() * len(model.names) // SPLIT) or 1
    rows = joined.select("item_id", F.pmod(F.xxhash64("point_id"), F.lit(splits)).alias("part"), "basis", (F.col("value") - F.col("mean")).alias("y"))
    deviation = np.sqrt(model.variance)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for item, own in pdf.groupby("item_id"):
                q = np.stack(own.basis.to_numpy()) * deviation
                out.append((item, np.concatenate([q.T @ q, (q.T @ own.y.to_numpy())[:, None]], axis=1).tobytes()))
            yield pd.DataFrame(out, columns=["item_id", "m"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = sum(np.frombuffer(x).reshape(r, r + 1) for x in pdf.m)
        return pd.DataFrame({"item_id": pdf.item_id[:1], "a": [np.linalg.solve(m[:, :r] / noise + np.eye(r), m[:, r] / noise)]})

    met = rows.repartition("item_id", "part").sortWithinPartitions("item_id")
    return met.mapInPandas(sums, "item_id long, m binary").groupBy("item_id").applyInPandas(solve, "item_id long, a array<double>")


def instances(model: ShapeModel, coefficients: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, point_id, components) of the shapes with the coefficients (key, a)."""
    value = F.col("mean")
    for k, v in enumerate(model.variance):
        value = value + F.get("basis", F.lit(k)) * F.get("a", F.lit(k)) * float(math.sqrt(v))
    moved = model.points.crossJoin(coefficients).select(key, "point_id", "component", value.alias("value"))
    wide = moved.groupBy(key, "point_id").agg(*[F.sum(F.when(F.col("component") == k, F.col("value"))).alias(f"d{n}") for k, n in enumerate(model.names)])
    return wide.join(model.reference, "point_id").select(key, "point_id", *[(F.col(n) + F.coalesce(f"d{n}", F.lit(0.0))).alias(n) for n in model.names])


def projection_errors(model: ShapeModel, tests: DataFrame) -> DataFrame:
    """(item_id, error): mean distance of each item's points to those of its projection, all items in one plan.

    Every item's own rows meet the model's by point, so items and points are never crossed.
    """
    names = model.names
    a = projections(model, tests)
    rows = tests.select("item_id", "point_id", *names).join(a, "item_id").join(model.points, "point_id")
    value = F.col("mean")
    for k, v in enumerate(model.variance):
        value = value + F.get("basis", F.lit(k)) * F.get("a", F.lit(k)) * float(math.sqrt(v))
    ref = model.reference.select("point_id", *[F.col(n).alias(f"r{n}") for n in names])
    here = F.element_at(F.array(*[F.col(n) - F.col(f"r{n}") for n in names]), F.col("component") + 1)
    gaps = rows.join(ref, "point_id").groupBy("item_id", "point_id").agg(F.sqrt(F.sum((here - value) ** 2)).alias("d"))
    return gaps.groupBy("item_id").agg(F.avg("d").alias("error"))


def generalization(model: ShapeModel, tests: DataFrame) -> float:
    """Mean distance of test shapes to their projections."""
    return projection_errors(model, tests).agg(F.avg("error")).first()[0] or 0.0


def specificity(model: ShapeModel, shapes: DataFrame, samples: int, seed: int = 0) -> float:
    """Mean over `samples` random instances of the mean point distance to the nearest training shape, in one plan."""
    spark, names = shapes.sparkSession, model.names
    drawn = [(k, np.random.default_rng(seed + k).standard_normal(model.rank).tolist()) for k in range(samples)]
    made = instances(model, F.broadcast(spark.createDataFrame(drawn, "sample_id long, a array<double>")), "sample_id")
    other = [f"s{n}" for n in names]
    pairs = shapes.join(made.toDF("sample_id", "point_id", *other), "point_id").groupBy("sample_id", "item_id").agg(F.avg(distance(names, other)).alias("d"))
    return pairs.groupBy("sample_id").agg(F.min("d").alias("d")).agg(F.avg("d")).first()[0]
