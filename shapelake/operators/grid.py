"""Regular grids and images: arithmetic index maps, interpolation, smoothing and distance transforms."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.functions.scalar import bspline
from shapelake.functions.vector import Mat, Vec


@dataclass(frozen=True)
class Grid:
    """Points origin + directions @ (index * spacing); the first index runs fastest."""

    origin: tuple[float, ...]
    spacing: tuple[float, ...]
    size: tuple[int, ...]
    directions: tuple[tuple[float, ...], ...] | None = None

    @staticmethod
    def from_box(origin: Sequence[float], extent: Sequence[float], size: Sequence[int]) -> Grid:
        """Spacing is extent / (size + 1) in 1-D and extent / size else, so the far corner is left out."""
        more = 1 if len(size) == 1 else 0
        return Grid(tuple(map(float, origin)), tuple(e / (n + more) for e, n in zip(extent, size)), tuple(size))

    @staticmethod
    def from_box_and_spacing(origin: Sequence[float], extent: Sequence[float], spacing: Sequence[float]) -> Grid:
        return Grid(tuple(map(float, origin)), tuple(map(float, spacing)), tuple(int(np.ceil(e / s)) for e, s in zip(extent, spacing)))

    @property
    def dim(self) -> int:
        return len(self.size)

    @property
    def n(self) -> int:
        return int(np.prod(self.size))

    def matrix(self) -> np.ndarray:
        d = np.eye(self.dim) if self.directions is None else np.array(self.directions, float)
        return d * np.array(self.spacing)

    def index(self, voxel_id: Column) -> list[Column]:
        out = []
        for n in self.size:
            out.append(voxel_id % n)
            voxel_id = F.floor(voxel_id / n)
        return out

    def voxel_id(self, index: Sequence[Column]) -> Column:
        total, step = F.lit(0).cast("long"), 1
        for i, n in zip(index, self.size):
            total, step = total + i * F.lit(step).cast("long"), step * n
        return total

    def point(self, index: Sequence[Column]) -> Vec:
        v = Vec(tuple(i.cast("double") for i in index))
        if self.directions is None:
            return Vec(tuple(x * s + o for x, s, o in zip(v.parts, self.spacing, self.origin)))
        return Mat.of(self.matrix().tolist()).apply(v) + Vec.of(*self.origin)

    def continuous_index(self, p: Vec) -> Vec:
        if self.directions is None:
            return Vec(tuple((x - o) / s for x, s, o in zip(p.parts, self.spacing, self.origin)))
        return Mat.of(np.linalg.inv(self.matrix()).tolist()).apply(p - Vec.of(*self.origin))

    def nearest_index(self, p: Vec) -> list[Column]:
        """Rounded continuous index, clamped to the grid: the nearest point without a search."""
        return [F.least(F.greatest(F.floor(c + 0.5), F.lit(0)), F.lit(n - 1)).cast("long") for c, n in zip(self.continuous_index(p).parts, self.size)]

    def on_grid(self, p: Vec, tolerance: float = 1e-8) -> Column:
        """Whether p is a grid point. One-sided, as defined: only a rest above the tolerance counts against it."""
        inside = F.lit(True)
        for c, n in zip(self.continuous_index(p).parts, self.size):
            inside = inside & (c - F.floor(c + 0.5) <= tolerance) & (F.floor(c + 0.5) < n)
        return inside

    def points(self, spark: SparkSession, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
        ids = spark.range(self.n).withColumnRenamed("id", "voxel_id")
        return ids.select("voxel_id", *self.point(self.index(F.col("voxel_id"))).columns(*names[: self.dim]))


def taps(queries: DataFrame, grid: Grid, names: Sequence[str], query_id: str, degree: int) -> DataFrame:
    """q_id and for each axis k a tap t{k} with its index i, weight w and derivative d by the index; a row for each combination of taps."""
    c = grid.continuous_index(Vec.of(*names))
    q = queries.select(F.col(query_id).alias("q_id"), *c.columns(*[f"c{k}" for k in range(grid.dim)]))
    for k, n in enumerate(grid.size):
        x = F.col(f"c{k}")
        base = F.floor(x) if degree == 1 else F.floor(x + 0.5) - degree // 2 if degree % 2 == 0 else F.floor(x) - degree // 2
        options = []
        for t in [0, 1] if degree == 1 else range(degree + 1):
            i = base + t
            if degree == 1:
                where, weight, slope = F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)), (1 - (x - base)) if t == 0 else (x - base), F.lit(2.0 * t - 1)
            else:
                period = max(2 * n - 2, 1)
                m = F.pmod(i, F.lit(period))
                where, weight = F.least(m, period - m) if n > 1 else F.lit(0), bspline(x - i, degree)
                slope = bspline(x - i + 0.5, degree - 1) - bspline(x - i - 0.5, degree - 1) if degree else F.lit(0.0)
            options.append(F.struct(where.cast("long").alias("i"), weight.alias("w"), slope.alias("d")))
        q = q.withColumn(f"t{k}", F.explode(F.array(*options)))
    return q


def product(parts: Sequence[Column]) -> Column:
    out = F.lit(1.0)
    for p in parts:
        out = out * p
    return out


def interpolate(queries: DataFrame, image: DataFrame, grid: Grid, names: Sequence[str], query_id: str = "q_id", degree: int = 1) -> DataFrame:
    """(q_id, value): multilinear (degree 1) or B-spline (degree 0, 2, 3) interpolation of (voxel_id, value).

    Each query explodes into its taps, whose indices are clamped to the grid (degree 1) or mirrored at its edges, and
    meets the voxels by an equi-join. For degrees 2 and 3 the image holds coefficients (see bspline_coefficients).
    """
    axes = range(grid.dim)
    rows = taps(queries, grid, names, query_id, degree).select("q_id", grid.voxel_id([F.col(f"t{k}.i") for k in axes]).alias("voxel_id"), product([F.col(f"t{k}.w") for k in axes]).alias("w"))
    return rows.join(image, "voxel_id").groupBy("q_id").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def interpolate_with_gradient(queries: DataFrame, image: DataFrame, grid: Grid, names: Sequence[str], query_id: str = "q_id", degree: int = 3) -> DataFrame:
    """(q_id, value, g0, ..): interpolation as above with its analytic gradient by position, from the same taps and one join."""
    axes = range(grid.dim)
    slopes = [product([F.col(f"t{j}.d" if j == k else f"t{j}.w") for j in axes]) for k in axes]
    rows = taps(queries, grid, names, query_id, degree).select("q_id", grid.voxel_id([F.col(f"t{k}.i") for k in axes]).alias("voxel_id"), product([F.col(f"t{k}.w") for k in axes]).alias("w"), *[s.alias(f"s{k}") for k, s in enumerate(slopes)])
    sums = [F.sum(F.col("w") * F.col("value")).alias("value"), *[F.sum(F.col(f"s{k}") * F.col("value")).alias(f"s{k}") for k in axes]]
    found = rows.join(image, "voxel_id").groupBy("q_id").agg(*sums)
    turn = np.linalg.inv(grid.matrix())  # of the index by the position
    return found.select("q_id", "value", *[sum((F.col(f"s{k}") * float(turn[k, i]) for k in axes), F.lit(0.0)).alias(f"g{i}") for i in axes])


def along_axis(image: DataFrame, grid: Grid, axis: int, line: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Applies line(array) -> array to every grid line of the axis; lines are independent groups of bounded size."""
    step, n = int(np.prod(grid.size[:axis], dtype=int)), grid.size[axis]
    key = (F.floor(F.col("voxel_id") / (step * n)) * step + F.col("voxel_id") % step).alias("line")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("voxel_id")
        return pd.DataFrame({"voxel_id": pdf.voxel_id, "value": line(pdf.value.to_numpy(float))})

    return image.select("voxel_id", F.col("value").cast("double").alias("value"), key).groupBy("line").applyInPandas(run, "voxel_id long, value double")


def bspline_coefficients(image: DataFrame, grid: Grid, degree: int) -> DataFrame:
    """Recursive prefilter, axis by axis, with mirrored edges; degree 0 and 1 need none."""
    #: Poles of the B-spline filters.
    poles = {2: (np.sqrt(8.0) - 3.0,), 3: (np.sqrt(3.0) - 2.0,)}.get(degree, ())

    def line(v: np.ndarray) -> np.ndarray:
        n = len(v)
        if n == 1:
            return v
        c = v.copy()
        for z in poles:
            c *= (1 - z) * (1 - 1 / z)
            mirror = np.concatenate([c, c[-2:0:-1]])
            c[0] = (mirror * z ** np.arange(len(mirror))).sum() / (1 - z ** len(mirror))
            for i in range(1, n):
                c[i] += z * c[i - 1]
            c[n - 1] = z / (z * z - 1) * (c[n - 1] + z * c[n - 2])
            for i in range(n - 2, -1, -1):
                c[i] = z * (c[i + 1] - c[i])
        return c

    for axis in range(grid.dim if poles else 0):
        image = along_axis(image, grid, axis, line)
    return image


def gaussian_smoothing(image: DataFrame, grid: Grid, sigma: float, cut: float = 3.0) -> DataFrame:
    """Separable Gaussian of physical sigma, weights normalised where the kernel leaves the image."""

    def kernel_line(spacing: float):
        r = int(np.ceil(cut * sigma / spacing))
        k = np.exp(-0.5 * (np.arange(-r, r + 1) * spacing / sigma) ** 2)
        return lambda v: np.convolve(v, k, "full")[r : r + len(v)] / np.convolve(np.ones(len(v)), k, "full")[r : r + len(v)]

    for axis in range(grid.dim):
        image = along_axis(image, grid, axis, kernel_line(grid.spacing[axis]))
    return image


def squared_distance_to(mask: DataFrame, grid: Grid) -> DataFrame:
    """(voxel_id, value): squared distance to the nearest voxel whose value is true; lower envelopes of parabolas, axis by axis."""

    def line_of(spacing: float):
        def line(f: np.ndarray) -> np.ndarray:
            n = len(f)
            x = np.arange(n) * spacing
            v, z, out = [], [], np.full(n, np.inf)
            for q in range(n):
                if not np.isfinite(f[q]):
                    continue
                while v:
                    p = v[-1]
                    s = ((f[q] + x[q] ** 2) - (f[p] + x[p] ** 2)) / (2 * (x[q] - x[p]))
                    if s > z[-1]:
                        break
                    v.pop(), z.pop()
                z.append(s if v else -np.inf)
                v.append(q)
            if v:
                k = np.searchsorted(np.array(z), x, side="right") - 1
                at = np.array(v)[k]
                out = (x - x[at]) ** 2 + f[at]
            return out

        return line

    image = mask.select("voxel_id", F.when(F.col("value").cast("boolean"), 0.0).otherwise(float("inf")).alias("value"))
    for axis in range(grid.dim):
        image = along_axis(image, grid, axis, line_of(grid.spacing[axis]))
    return image


def distance_transform(mask: DataFrame, grid: Grid) -> DataFrame:
    """Signed: the distance to the object outside of it, minus the distance to the background inside."""
    outside = squared_distance_to(mask, grid).withColumnRenamed("value", "out2")
    inside = squared_distance_to(mask.withColumn("value", ~F.col("value").cast("boolean")), grid).withColumnRenamed("value", "in2")
    return outside.join(inside, "voxel_id").select("voxel_id", (F.sqrt("out2") - F.sqrt("in2")).alias("value"))


def gradient(image: DataFrame, grid: Grid, axis: int) -> DataFrame:
    return along_axis(image, grid, axis, lambda v: np.gradient(v, grid.spacing[axis]) if len(v) > 1 else np.zeros(1))


