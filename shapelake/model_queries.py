"""Queries of models and iterative plans. Where SQL can't say it, tests compare with analytic or NumPy results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from shapelake.storage import saved
from shapelake.functions import transform as tf
from shapelake.functions.vector import Vec
from shapelake.operators import grid as gr
from shapelake.operators import mesh as ms
from shapelake.operators import stats as st
from shapelake.plans import gp, kernels, linalg, mcmc, pdm, register
from shapelake.queries import MESH, QUERIES, SQL, _image, grid_of, part_mesh, query, r, t
from shapelake.streaming.moments import chain_log, windowed_moments


@query(f"WITH {MESH}, l AS (SELECT c_custkey AS line_id, c_acctbal / 300 AS ox, (c_custkey % 40) + 0.37::DOUBLE AS oy, -5.0::DOUBLE AS oz, 0.01::DOUBLE AS dx, 0.02::DOUBLE AS dy, 1.0::DOUBLE AS dz FROM customer WHERE c_custkey % 50 = 0), "
       "h AS (SELECT *, bx-ax e1x, by_-ay e1y, bz-az e1z, cx-ax e2x, cy-ay e2y, cz-az e2z, ox-ax sx, oy-ay sy, oz-az sz FROM (SELECT cell_id, ax, ay, az, bx, b_y AS by_, bz, cx, cy, cz FROM tri), l), "
       "k AS (SELECT *, dy*e2z-dz*e2y hx, dz*e2x-dx*e2z hy, dx*e2y-dy*e2x hz, sy*e1z-sz*e1y qx, sz*e1x-sx*e1z qy, sx*e1y-sy*e1x qz FROM h), "
       "m AS (SELECT *, e1x*hx+e1y*hy+e1z*hz AS det FROM k), "
       "n AS (SELECT line_id, cell_id, (sx*hx+sy*hy+sz*hz)/det AS u, (dx*qx+dy*qy+dz*qz)/det AS v, (e2x*qx+e2y*qy+e2z*qz)/det AS t FROM m WHERE abs(det) > 1e-12) "
       "SELECT line_id, cell_id, round(t, 6) AS t, round(1 - u - v, 6) AS u, round(u, 6) AS v, round(v, 6) AS w FROM n WHERE u >= 0 AND v >= 0 AND u + v <= 1")  # fmt: skip
def line_intersection(spark, d):
    lines = t(spark, d, "customer").filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("line_id"), (F.col("c_acctbal") / 300).alias("ox"), ((F.col("c_custkey") % 40) + 0.37).alias("oy"), F.lit(-5.0).alias("oz"), F.lit(0.01).alias("dx"), F.lit(0.02).alias("dy"), F.lit(1.0).alias("dz"))
    return part_mesh(spark, d).intersections(lines).select("line_id", "cell_id", *[r(c).alias(c) for c in ("t", "u", "v", "w")])


@query("WITH v AS (SELECT p_partkey AS voxel_id, (p_partkey % 40)::DOUBLE AS x, (p_partkey // 40)::DOUBLE * 2 AS y, p_size > 45 AS on_ FROM part), o AS (SELECT a.voxel_id, min(CASE WHEN b.on_ THEN (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) END) AS o2, min(CASE WHEN NOT b.on_ THEN (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) END) AS i2 FROM v a, v b GROUP BY 1) SELECT voxel_id, round(sqrt(o2) - sqrt(i2), 6) AS value FROM o")
def distance_transform(spark, d):
    mask = t(spark, d, "part").select(F.col("p_partkey").alias("voxel_id"), (F.col("p_size") > 45).alias("value"))
    return gr.distance_transform(mask, grid_of(spark, d, (40,), (1.0, 2.0))).select("voxel_id", r("value").alias("value"))


@query("WITH im AS (SELECT p_partkey % 40 AS x, p_partkey // 40 AS y, p_size::DOUBLE AS s FROM part), a AS (SELECT p.x, p.y, sum(exp(-0.5 * (p.x - q.x) * (p.x - q.x) / 2.25) * q.s) / sum(exp(-0.5 * (p.x - q.x) * (p.x - q.x) / 2.25)) AS s FROM im p JOIN im q ON p.y = q.y AND abs(p.x - q.x) <= 5 GROUP BY 1, 2), b AS (SELECT p.x, p.y, sum(exp(-0.5 * (p.y - q.y) * (p.y - q.y) / 2.25) * q.s) / sum(exp(-0.5 * (p.y - q.y) * (p.y - q.y) / 2.25)) AS s FROM a p JOIN a q ON p.x = q.x AND abs(p.y - q.y) <= 5 GROUP BY 1, 2) SELECT y * 40 + x AS voxel_id, round(s, 6) AS value FROM b")
def gaussian_smoothing(spark, d):
    return gr.gaussian_smoothing(_image(spark, d), grid_of(spark, d, (40,)), 1.5).select("voxel_id", r("value").alias("value"))


@query()
def bspline_image(spark, d):
    """Cubic interpolation of an image at its own grid points and between them."""
    grid = grid_of(spark, d, (40,))
    fine = gr.Grid((0.0, 0.0), (0.5, 0.5), tuple(2 * n - 1 for n in grid.size)).points(spark)
    return gr.interpolate(fine, gr.bspline_coefficients(_image(spark, d), grid, 3), grid, ("x", "y"), "voxel_id", 3)


def _surface_queries(spark, d):
    i = F.col("c_custkey")
    return t(spark, d, "customer").select(i.alias("q_id"), (i % 39 + 0.3).alias("x"), (i % 4 + 0.6).alias("y"), (F.col("c_acctbal") / 2000).alias("z"))


@query()
def surface_distance(spark, d):
    return part_mesh(spark, d).closest_on_surface(_surface_queries(spark, d), 1.0)


@query(f"WITH {MESH}, a AS (SELECT point_id, x, y, z FROM pts WHERE point_id % 2 = 0), b AS (SELECT point_id, x, y, z FROM pts WHERE point_id % 2 = 1), d AS (SELECT a.point_id AS i, b.point_id AS j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM a, b) SELECT round(greatest((SELECT max(m) FROM (SELECT min(d) AS m FROM d GROUP BY i)), (SELECT max(m) FROM (SELECT min(d) AS m FROM d GROUP BY j))), 6) AS hausdorff")
def point_set_hausdorff(spark, d):
    p = part_mesh(spark, d).points.select("point_id", "x", "y", "z")
    return ms.hausdorff(p.filter("point_id % 2 = 0"), p.filter("point_id % 2 = 1"), 1.0).select(r("hausdorff").alias("hausdorff"))


@query("SELECT round(2.0 * sum(((x BETWEEN 0 AND 30) AND (y BETWEEN 2 AND 9))::INT) / (sum((x BETWEEN 0 AND 30)::INT) + sum((y BETWEEN 2 AND 9)::INT)), 6) AS dice FROM (SELECT l_quantity AS x, l_discount * 100 AS y FROM lineitem)")
def dice_coefficient(spark, d):
    p = t(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return ms.dice(F.col("x").between(0, 30), F.col("y").between(2, 9), p).select(r("dice").alias("dice"))


@query(f"WITH {MESH}, g AS (SELECT point_id, min(point_id) OVER w AS t_ FROM pts WINDOW w AS (PARTITION BY floor(x / 3), floor(y / 3), floor(z / 3))) SELECT cell_id, a.t_ AS a, b.t_ AS b, c.t_ AS c FROM cells JOIN g a ON a.point_id = pids[1] JOIN g b ON b.point_id = pids[2] JOIN g c ON c.point_id = pids[3] WHERE a.t_ <> b.t_ AND b.t_ <> c.t_ AND a.t_ <> c.t_")
def decimate(spark, d):
    """Vertex clustering."""
    m = ms.decimate(part_mesh(spark, d), 3.0)
    return m.cells.select("cell_id", *[F.element_at("pids", k + 1).alias(n) for k, n in enumerate("abc")])


@query()
def sample_surface(spark, d):
    return ms.sample_on_surface(part_mesh(spark, d), 5000, 3)


def hour(column):
    return F.date_format(column, "yyyy-MM-dd HH").alias(column)


@query("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H') AS start, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 7) AS var FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    return windowed_moments(t(spark, d, "events"), "ts", "value", "event_type").select(hour("start"), "event_type", "n", r("mean").alias("mean"), r("var", 7).alias("var"))


@query("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H') AS start, event_type AS generated_by, round(avg((value > 50)::INT), 6) AS ratio, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_acceptance(spark, d):
    rows = t(spark, d, "events").select("ts", F.col("event_type").alias("generated_by"), (F.col("value") > 50).alias("accepted"))
    return chain_log(rows).select(hour("start"), "generated_by", r("ratio").alias("ratio"), "n")


# --- models


def _shapes(spark, d):
    """Embeddings as shapes: every vector an item of 22 points of three numbers, those after the 64th being 0."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.posexplode(F.concat(F.col("embedding").cast("array<double>"), F.array(F.lit(0.0), F.lit(0.0)))).alias("k", "v"))
    rows = e.groupBy("item_id", F.floor(F.col("k") / 3).alias("point_id"))
    return rows.agg(*[F.max(F.when(F.col("k") % 3 == j, F.col("v"))).alias(n) for j, n in enumerate("xyz")])


def _reference(shapes):
    return shapes.groupBy("point_id").agg(*[F.avg(n).alias(n) for n in "xyz"])


@query()
def pca_model(spark, d):
    shapes = _shapes(spark, d)
    m = pdm.pca_model(_reference(shapes), shapes, rank=5)
    return m.instance([1.0, -1.0]).select("point_id", *[r(c, 4).alias(c) for c in "xyz"])


@query()
def pdm_posterior(spark, d):
    shapes = _shapes(spark, d).transform(saved)
    m = pdm.pca_model(_reference(shapes), shapes, rank=5)
    seen = shapes.filter("item_id = 3 AND point_id < 5").select("point_id", "x", "y", "z")
    return m.posterior(seen, 0.01).mean().select("point_id", *[r(c, 4).alias(c) for c in "xyz"])


@query()
def gpa(spark, d):
    aligned, mean = pdm.gpa(_shapes(spark, d), 3)
    return mean.select("point_id", *[r(c, 4).alias(c) for c in "xyz"])


@query()
def gp_regression(spark, d):
    """Values of events over the hour, learned from all of them through a low-rank process, predicted for each."""
    e = t(spark, d, "events").select("event_id", (F.hour("ts") + F.minute("ts") / 60.0).alias("x"), "value")
    low = gp.nystrom(kernels.diagonal(kernels.gaussian(3.0, 20.0), 1), np.linspace(0, 24, 60)[:, None], 12)
    return gp.table_regression(low, e, ["x"], "value", 25.0, "event_id").select("event_id", r("mean").alias("mean"))


@query()
def nystrom(spark, d):
    e = t(spark, d, "events").select("event_id", (F.hour("ts") + F.minute("ts") / 60.0).alias("x"))
    low = gp.nystrom(kernels.diagonal(kernels.gaussian(4.0), 1), np.linspace(0, 24, 60)[:, None], 8)
    return gp.GaussianProcess(lambda x: low.instance(np.ones(low.rank), x), kernels.diagonal(kernels.gaussian(4.0), 1)).predict(e, ["x"], "event_id", ["value"])


@query()
def pivoted_cholesky(spark, d):
    """Of the kernel matrix of the vertices of `part`, kept in a table: one pass over it for each pivot."""
    p = part_mesh(spark, d).points.select("point_id", "x", "y", "z")
    return linalg.tall_pivoted_cholesky(p, kernels.gaussian(8.0), ["x", "y", "z"], 5)


@query()
def random_svd(spark, d):
    s, _ = linalg.tall_random_svd(t(spark, d, "embeddings"), "embedding", 10, power=20)
    return spark.createDataFrame([(k, float(round(x, 6))) for k, x in enumerate(s)], "k int, s double")


@query()
def rigid3d(spark, d):
    """Recovers a known rigid motion of the vertices."""
    p = part_mesh(spark, d).points.select(F.col("point_id").alias("id"), "x", "y", "z")
    moved = tf.translation_after_rotation((1, 2, 3), (0.3, -0.2, 0.5), (0, 0, 0)).on(p, ("x", "y", "z"))
    fit = register.landmark_fit(register.match_landmarks(p, moved, ("x", "y", "z")), ("x", "y", "z"))
    return spark.createDataFrame([(k, float(round(v, 6))) for k, v in enumerate(fit.parameters)], "k int, value double")


@query()
def mh_chain(spark, d):
    walk = mcmc.mixture((0.5, mcmc.random_walk(1.0)), (0.5, mcmc.random_walk(4.0)))
    return mcmc.chains(spark, walk, mcmc.gaussian_evaluator(1.0, 3.5), [0.0], 8, 500, 2000, 10)


@query()
def registration_fit(spark, d):
    """Translation that registers a shifted bump with the original, from samples on a grid."""
    bump = lambda x: (np.exp(-(x**2).sum(axis=1)), -2 * x * np.exp(-(x**2).sum(axis=1))[:, None])
    grid = gr.Grid((-2.0, -2.0), (0.1, 0.1), (41, 41)).points(spark)
    samples = grid.withColumn("f", F.exp(-(Vec.of("x", "y") + Vec.of(0.3, -0.2)).norm2()))
    metric = register.PointwiseMetric(samples, ("x", "y"), "f", bump, tf.translation_space(2), register.squared_loss)
    steps = list(register.registration(metric, (0.0, 0.0), iterations=15))
    return spark.createDataFrame([(s.iteration, *map(float, s.parameters), s.value) for s in steps], "iteration int, tx double, ty double, value double")


@query()
def cross_validation(spark, d):
    shapes = _shapes(spark, d).transform(saved)
    items = shapes.select("item_id").distinct()
    folds = st.folds(items, "item_id", 3, items.count())
    errors = pdm.cross_validate(_reference(shapes), shapes, folds, lambda m, test: pdm.generalization(m.truncate(5), test))
    return spark.createDataFrame([(k, float(e)) for k, e in enumerate(errors)], "fold int, error double")


@query("SELECT event_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS previous FROM events")
def chain_lag(spark, d):
    """Each state's predecessor in its chain."""
    return t(spark, d, "events").select("event_id", F.lag("event_id", 1, -1).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("previous"))


__all__ = ["QUERIES", "SQL"]
