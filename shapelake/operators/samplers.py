"""Samplers of boxes, grids and meshes, and a sampler as a SQL table function."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from shapelake.operators.grid import Grid
from shapelake.operators.mesh import Mesh, numbered, sample_on_surface
from shapelake.storage import saved

XYZ = ("x", "y", "z")


def uniform(spark: SparkSession, lower: Sequence[float], upper: Sequence[float], n: int, seed: int) -> DataFrame:
    """(sample_id, x, ..., density): n points uniform in a box."""
    volume = float(np.prod(np.subtract(upper, lower)))
    columns = [(F.lit(float(a)) + F.rand(seed + k) * float(b - a)).alias(m) for k, (a, b, m) in enumerate(zip(lower, upper, XYZ))]
    return spark.range(n).select(F.col("id").alias("sample_id"), *columns, F.lit(1 / volume).alias("density"))


def on_grid(spark: SparkSession, grid: Grid) -> DataFrame:
    """All grid points; the density is that of a uniform distribution over the grid's box."""
    volume = float(np.prod(np.multiply(grid.spacing, grid.size)))
    return grid.points(spark).withColumnRenamed("voxel_id", "sample_id").withColumn("density", F.lit(1 / volume))


def fixed_points(points: DataFrame, n: int, seed: int) -> DataFrame:
    """n of the points, the same for the same seed: those that come first by a seeded hash."""
    return points.orderBy(F.xxhash64("point_id", F.lit(seed)), "point_id").limit(n)


def on_mesh(mesh: Mesh, n: int, seed: int) -> DataFrame:
    """(sample_id, x, y, z, density): about n points uniform over the surface."""
    area = mesh.measure().select(F.col("measure").alias("total"))
    s = sample_on_surface(mesh, n, seed).join(mesh.cornered(), "cell_id").crossJoin(F.broadcast(area))
    at = [(F.col("u") * F.col(f"a0.{c}") + F.col("v") * F.col(f"a1.{c}") + F.col("w") * F.col(f"a2.{c}")).alias(c) for c in XYZ]
    return s.select("sample_id", *at, (1 / F.col("total")).alias("density"))


def in_tetrahedra(mesh: Mesh, n: int, seed: int) -> DataFrame:
    """(cell_id, x, y, z): about n points uniform in the volume, each cell's share drawn as for surfaces.

    Inside a cell the weights are exponential draws over their sum, which is uniform.
    """
    volume = mesh.measures()
    share = volume.crossJoin(F.broadcast(volume.agg(F.sum("measure").alias("total")))).withColumn("m", F.col("measure") / F.col("total") * n)
    times = share.withColumn("k", (F.floor("m") + (F.rand(seed) < F.col("m") - F.floor("m")).cast("long")).cast("int")).filter("k > 0")
    rows = times.select("cell_id", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("i"))
    for k in range(4):
        rows = rows.withColumn(f"e{k}", -F.log(1 - F.rand(seed + 1 + k)))
    total = F.col("e0") + F.col("e1") + F.col("e2") + F.col("e3")
    at = [(sum((F.col(f"e{k}") * F.col(f"a{k}.{c}") for k in range(4)), F.lit(0.0)) / total).alias(c) for c in XYZ]
    return rows.join(mesh.cornered(), "cell_id").select("cell_id", *at)


def vertices(mesh: Mesh, n: int, seed: int) -> DataFrame:
    """(sample_id, x, y, z, density): n draws with repetition among the points of any mesh, the same for the same seed."""
    points = numbered(mesh.points.select("point_id", *XYZ), "point_id", "__k")
    many, measure = mesh.points.count(), mesh.measure().select(F.col("measure").alias("total"))
    drawn = mesh.points.sparkSession.range(n if many else 0).select(F.col("id").alias("sample_id"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(many, 1))).alias("__k"))
    return drawn.join(points, "__k").crossJoin(F.broadcast(measure)).select("sample_id", *XYZ, (1 / F.col("total")).alias("density"))


def fixed(samples: DataFrame) -> DataFrame:
    """The same draws each time: a sampler's rows, kept in the shared folder."""
    return samples.transform(saved)


@udtf(returnType=T.StructType([T.StructField(n, T.DoubleType()) for n in XYZ]))
class UniformBox:
    """SELECT * FROM uniform_box(n, side, seed): n points uniform in a cube from the origin."""

    def eval(self, n: int, side: float, seed: int):
        for row in np.random.default_rng(seed).random((n, 3)) * float(side):
            yield tuple(map(float, row))


def register(spark: SparkSession) -> None:
    spark.udtf.register("uniform_box", UniformBox)


def move_uncertain_landmarks(landmarks: DataFrame, transform, draws: int = 5000, seed: int = 0) -> DataFrame:
    """(id, coord, cov) moved by a function of (n, d) arrays; the covariance is that of moved draws around each landmark."""

    def run(batches):
        for pdf in batches:
            coords, covs = [], []
            for i, (c, k) in enumerate(zip(pdf.coord, pdf["cov"])):
                c = np.array(c, float)
                coords.append(transform(c[None])[0])
                if k is None:
                    covs.append(None)
                else:
                    d = len(c)
                    s = np.random.default_rng([seed, i]).multivariate_normal(c, np.array(k).reshape(d, d), draws)
                    covs.append(np.cov(transform(s).T).reshape(d, d).ravel(order="F"))
            yield pdf.assign(coord=coords, cov=covs)

    return landmarks.select("id", "coord", "cov").mapInPandas(run, "id string, coord array<double>, cov array<double>")
