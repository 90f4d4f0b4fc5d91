"""Processes and models on the points of a table: dense discrete processes, intensity models, shapes as fields."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.operators.mesh import Mesh, decimate
from shapelake.operators.spatial import nearest
from shapelake.plans.gp import GaussianProcess, Mvn, regression
from shapelake.plans.kernels import MatrixKernel
from shapelake.plans.linalg import eig_of_factor, pivoted_cholesky
from shapelake.plans.pdm import XYZ, ShapeModel

#: A dense process has a square matrix of this side at most; larger ones are ShapeModels, whose points are tables.
MOST_VALUES = 20_000


@dataclass(frozen=True)
class DiscreteProcess:
    """A Gaussian process on n points (n, d) with k values each: mean (n, k), covariance (n k, n k); on the driver."""

    points: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    def __post_init__(self):
        if self.cov.shape != (self.mean.size, self.mean.size) or len(self.points) != len(self.mean):
            raise ValueError("points, mean and covariance do not fit together")
        if self.mean.size > MOST_VALUES:
            raise ValueError(f"more than {MOST_VALUES} values: use a low-rank model")

    @staticmethod
    def of(process: GaussianProcess, points: np.ndarray) -> DiscreteProcess:
        return DiscreteProcess(points, process.mean(points), process.kernel.block(points, points))

    @property
    def dim(self) -> int:
        return self.mean.shape[1]

    def distribution(self) -> Mvn:
        return Mvn(self.mean.ravel(), self.cov)

    def _rows(self, ids: Sequence[int]) -> np.ndarray:
        return (np.asarray(ids)[:, None] * self.dim + np.arange(self.dim)).ravel()

    def sample(self, seed: int = 0) -> np.ndarray:
        return self.distribution().sample(1, seed).reshape(self.mean.shape)

    def marginal(self, ids: Sequence[int]) -> DiscreteProcess:
        at = self._rows(ids)
        return DiscreteProcess(self.points[list(ids)], self.mean[list(ids)], self.cov[np.ix_(at, at)])

    def marginal_at(self, point: int) -> Mvn:
        at = self._rows([point])
        return Mvn(self.mean[point], self.cov[np.ix_(at, at)])

    def logpdf(self, values: np.ndarray) -> float:
        return self.distribution().logpdf(values.ravel())

    def pdf(self, values: np.ndarray) -> float:
        return self.distribution().pdf(values.ravel())

    def posterior(self, ids: Sequence[int], values: np.ndarray, noise: float | np.ndarray) -> DiscreteProcess:
        """Conditioned on values (m, k) at points by number, with noise variance or covariance (m k, m k); NaN is left out."""
        at, y = self._rows(ids), (np.asarray(values) - self.mean[list(ids)]).ravel()
        error = noise * np.eye(len(y)) if np.isscalar(noise) else np.asarray(noise)
        use = ~np.isnan(y)
        cross = self.cov[:, at[use]]
        gain = np.linalg.solve((self.cov[np.ix_(at, at)] + error)[np.ix_(use, use)], cross.T).T
        return DiscreteProcess(self.points, self.mean + (gain @ y[use]).reshape(self.mean.shape), self.cov - gain @ cross.T)

    def marginal_likelihood(self, ids: Sequence[int], values: np.ndarray, noise: float) -> float:
        if not len(ids):
            raise ValueError("observations are needed")
        part = self.marginal(ids)
        return Mvn(part.mean.ravel(), part.cov + noise * np.eye(part.mean.size)).logpdf(np.asarray(values).ravel())

    def project(self, values: np.ndarray) -> np.ndarray:
        """Regression on all points with a small noise, so approximate."""
        return self.posterior(range(len(self.points)), values, 1e-5).mean

    def _closest(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([((x[i : i + 256, None] - self.points[None]) ** 2).sum(2).argmin(1) for i in range(0, len(x), 256)] or [np.zeros(0, int)])

    def interpolate(self) -> GaussianProcess:
        """A process for all points of space with the mean and covariance of the nearest points."""
        block = lambda x, z: self.cov[np.ix_(self._rows(self._closest(x)), self._rows(self._closest(z)))]
        return GaussianProcess(lambda x: self.mean[self._closest(x)], MatrixKernel(self.dim, block))

    def low_rank(self, tolerance: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(variances, orthonormal basis (n k, rank)) from a pivoted Cholesky factor of the covariance."""
        factor, _ = pivoted_cholesky(np.diag(self.cov), lambda i: self.cov[:, i], tolerance)
        u, values = eig_of_factor(factor)
        return values, u

    def coefficients(self, values: np.ndarray, noise: float = 1e-5) -> np.ndarray:
        variance, u = self.low_rank()
        return regression(u * np.sqrt(variance), (np.asarray(values) - self.mean).ravel(), noise)[0]

    def model(self, spark, names: Sequence[str] = XYZ) -> ShapeModel:
        """As a low-rank model whose points are a table, with displacements from reference values of 0 or, for as many components, the points."""
        variance, u = self.low_rank()
        base = self.points if self.points.shape[1] == self.dim else np.zeros(self.mean.shape)
        reference = spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(base)], "point_id long, " + ", ".join(f"{n} double" for n in names))
        basis = u.reshape(*self.mean.shape, -1)
        rows = [(i, c, float(self.mean[i, c]), basis[i, c].tolist()) for i in range(len(self.mean)) for c in range(self.dim)]
        return ShapeModel(reference, spark.createDataFrame(rows, "point_id long, component int, mean double, basis array<double>"), variance, None, tuple(names))


def interpolated(model: ShapeModel, queries: DataFrame, start: float) -> DataFrame:
    """(q_id, component, mean, basis) of a low-rank model at queries (q_id, x, y, ..): those of the nearest reference point."""
    names = [n for n in XYZ if n in model.reference.columns]
    near = nearest(queries, model.reference, start, names, point_id="point_id").select("q_id", F.col("p_id").alias("point_id"))
    return near.join(model.points, "point_id").select("q_id", "component", "mean", "basis")


def interpolated_instance(model: ShapeModel, a: Sequence[float], queries: DataFrame, start: float) -> DataFrame:
    """(q_id, component, value): the displacement of an instance at any points."""
    value = F.col("mean")
    for k, x in enumerate(a):
        value = value + F.get("basis", F.lit(k)) * float(x * math.sqrt(model.variance[k]))
    return interpolated(model, queries, start).select("q_id", "component", value.alias("value"))


def decimated(model: ShapeModel, size: float) -> ShapeModel:
    """The model on a coarser reference (see operators.mesh.decimate), each of whose points moves like the nearest old one."""
    first = None if model.cells is None else model.cells.first()
    if first is None:
        raise ValueError("a model with cells is needed")
    small = decimate(Mesh(model.reference, model.cells, len(first.pids)), size)
    at = interpolated(model, small.points.withColumnRenamed("point_id", "q_id"), size)
    return ShapeModel(small.points, at.withColumnRenamed("q_id", "point_id"), model.variance, small.cells, model.names)


@dataclass(frozen=True)
class VolumeIntensityModel:
    """A shape model and a model of the values at the same points: reference values plus mean and basis."""

    shape: ShapeModel
    intensity: ShapeModel

    def __post_init__(self):
        if self.intensity.names != ("value",):
            raise ValueError("the intensity model has one component, `value`")

    def instance(self, shape: Sequence[float], intensity: Sequence[float]) -> DataFrame:
        """(point_id, coordinates, value)."""
        return self.shape.instance(shape).join(self.intensity.instance(intensity), "point_id")

    def mean(self) -> DataFrame:
        return self.instance((), ())

    def zero_coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(self.shape.rank), np.zeros(self.intensity.rank)

    def sample(self, seed: int = 0) -> DataFrame:
        rng = np.random.default_rng(seed)
        return self.instance(rng.standard_normal(self.shape.rank), rng.standard_normal(self.intensity.rank))


# --- shapes as fields


def mesh_to_transformation(reference: DataFrame, shape: DataFrame, queries: DataFrame, start: float, names: Sequence[str] = XYZ) -> DataFrame:
    """(q_id, coordinates): each query goes to the point of `shape` that has the id of the nearest reference point.

    Both are (point_id, coordinates); ValueError where they differ in the number of points.
    """
    if reference.count() != shape.count():
        raise ValueError("reference and shape differ in their number of points")
    near = nearest(queries, reference, start, names, point_id="point_id").select("q_id", F.col("p_id").alias("point_id"))
    return near.join(shape.select("point_id", *names), "point_id").select("q_id", *names)


def displacement_fields(reference: DataFrame, shapes: DataFrame, queries: DataFrame, start: float, names: Sequence[str] = XYZ) -> DataFrame:
    """(item_id, q_id, dx, ..): the displacement field of every item, extended to the queries by the nearest reference point.

    The neighbour is searched once for all items.
    """
    near = nearest(queries, reference, start, names, point_id="point_id").select("q_id", F.col("p_id").alias("point_id"))
    ref = reference.select("point_id", *[F.col(n).alias(f"r{n}") for n in names])
    moves = shapes.join(ref, "point_id").select("item_id", "point_id", *[(F.col(n) - F.col(f"r{n}")).alias(f"d{n}") for n in names])
    return near.join(moves, "point_id").select("item_id", "q_id", *[f"d{n}" for n in names])


def likely_points(model: ShapeModel, target: DataFrame, most: float, start: float) -> DataFrame:
    """(point_id, coordinates, density 1): reference points whose mean position's nearest target point is, by the point's own distribution, within `most` standard deviations.

    target: (point_id, coordinates). The Mahalanobis distance is that of the displacement to the target point without the mean.
    """
    names, d = model.names, len(model.names)
    mean = model.mean()
    near = nearest(mean.select(F.col("point_id").alias("q_id"), *names), target, start, names, point_id="point_id").select(F.col("q_id").alias("point_id"), F.col("p_id").alias("t"))
    moved = near.join(target.select(F.col("point_id").alias("t"), *[F.col(n).alias(f"t{n}") for n in names]), "t").join(mean.select("point_id", *[F.col(n).alias(f"m{n}") for n in names]), "point_id")
    gaps = moved.select("point_id", F.array(*[F.col(f"t{n}") - F.col(f"m{n}") for n in names]).alias("gap"))
    cov = model.covariance().groupBy("point_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "cov"))), lambda s: s["cov"]).alias("cov"))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                gap, c = np.stack(pdf.gap.to_numpy()), np.stack(pdf["cov"].to_numpy()).reshape(-1, d, d)
                far = np.sqrt(np.maximum(np.einsum("ni,nij,nj->n", gap, np.linalg.pinv(c), gap), 0))
                yield pd.DataFrame({"point_id": pdf.point_id[far < most]})

    chosen = gaps.join(cov, "point_id").mapInPandas(run, "point_id long")
    return model.reference.join(chosen, "point_id", "left_semi").select("point_id", *names, F.lit(1.0).alias("density"))
