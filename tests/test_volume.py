import numpy as np
from pyspark.sql import functions as F

from shapelake.functions import transform as tf
from shapelake.operators import grid as gr
from shapelake.operators import samplers as sm
from shapelake.operators import volume as vo
from shapelake.operators.mesh import Mesh
from shapelake.plans import asm, pdm, register
from shapelake.sources import datasource, formats as fm, tables as tb
from test_mesh_grid import sphere


def two_tets(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 0.0, 2.0), (2, 0.0, 1.0, 0.0, 3.0), (3, 0.0, 0.0, 1.0, 4.0), (4, 1.0, 1.0, 1.0, 9.0)], "point_id long, x double, y double, z double, value double")
    return Mesh(points, spark.createDataFrame([(0, [0, 1, 2, 3]), (1, [1, 2, 3, 4])], "cell_id long, pids array<long>"), 4)


Q = "q_id long, x double, y double, z double"


def test_volume_queries(spark):
    m = two_tets(spark)
    q = spark.createDataFrame([(0, 0.1, 0.1, 0.1), (1, 0.5, 0.5, 0.5), (2, -2.0, 0.2, 0.2)], Q)
    got = {r.q_id: (r.inside, round(r.d2, 6)) for r in vo.closest_in_volume(m, q, 0.7).collect()}
    assert got == {0: (True, 0.0), 1: (True, 0.0), 2: (False, 4.0)}
    values = {r.q_id: round(r.value, 6) for r in vo.in_volume(m, q, 0.7).collect()}
    assert set(values) == {0, 1} and values[0] == round(0.7 * 1 + 0.1 * (2 + 3 + 4), 6)
    lines = spark.createDataFrame([(1, 0.1, 0.15, -1.0, 0.0, 0.0, 1.0), (2, 5.0, 5.0, -1.0, 0.0, 0.0, 1.0)], "line_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    assert {r.line_id: r.hit for r in vo.has_intersection(m, lines).collect()} == {1: True, 2: False}
    assert sorted(round(r.t, 6) for r in vo.volume_intersections(m, lines).collect()) == [1.0, 1.75, 1.95]
    s = sm.in_tetrahedra(m, 2000, 3)
    assert abs(s.count() - 2000) < 5 and s.filter("x < 0 OR y < 0 OR z < 0 OR x > 1 OR y > 1 OR z > 1").count() == 0


def test_images_of_a_sphere(spark):
    m = sphere(spark)
    grid = gr.Grid((-1.6, -1.6, -1.6), (0.8, 0.8, 0.8), (5, 5, 5))
    rows = vo.distance_image(m, grid, 0.8).join(grid.points(spark), "voxel_id").collect()
    assert len(rows) == 125 and all(abs(r.value - abs((r.x**2 + r.y**2 + r.z**2) ** 0.5 - 1)) < 0.06 for r in rows)
    inside = vo.binary_image(m, grid, 0.8).join(grid.points(spark), "voxel_id").collect()
    assert all((r.value == 1) == (r.x**2 + r.y**2 + r.z**2 < 1) for r in inside)
    s = sm.on_mesh(m, 1000, 1)
    assert abs(s.agg(F.avg(1 / F.col("density"))).first()[0] - 4 * np.pi) < 0.3


def test_interpolators(spark):
    m = sphere(spark)
    m = m.with_points(m.points.withColumn("value", F.col("z")))
    q = spark.createDataFrame([(0, 0.0, 0.0, 3.0), (1, 2.0, 0.0, 0.1)], Q)
    got = {r.q_id: r.value for r in vo.on_surface(m, q, 1.0).collect()}
    assert abs(got[0] - 1) < 0.05 and abs(got[1] - 0.05) < 0.06
    assert {r.q_id for r in vo.nearest_neighbour(q, m.points, 0.5).collect()} == {0, 1}


def test_line_directions(spark):
    points = spark.createDataFrame([(k, float(k), 0.0) for k in range(4)], "point_id long, x double, y double")
    m = Mesh(points, spark.createDataFrame([(0, [1, 0]), (1, [1, 2]), (2, [3, 2])], "cell_id long, pids array<long>"), 2)
    fixed = vo.consistent_directions(m)
    assert {r.cell_id: r.pids for r in fixed.cells.collect()} == {0: [0, 1], 1: [1, 2], 2: [2, 3]}
    assert m.measure(("x", "y")).first()[0] == 3 and {(r.nx, r.ny) for r in vo.line_normals(fixed).collect()} == {(0.0, -1.0)}


def test_samplers(spark):
    u = sm.uniform(spark, (0, 0), (2, 5), 4000, 1)
    assert abs(u.agg(F.avg("x")).first()[0] - 1) < 0.1 and u.first().density == 0.1
    assert sm.on_grid(spark, gr.Grid((0.0,), (0.5,), (10,))).first().density == 0.2
    p = sphere(spark).points
    assert sm.fixed_points(p, 5, 2).collect() == sm.fixed_points(p.repartition(3), 5, 2).collect()
    sm.register(spark)
    assert spark.sql("SELECT count(*) FROM uniform_box(50, 2.0D, 7)").first()[0] == 50


def test_uncertain_landmarks(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], [4.0, 0.0, 0.0, 1.0]), ("b", [0.0, 1.0], None)], "id string, coord array<double>, cov array<double>")
    t = tf.rotation((np.pi / 2,), (0, 0))
    got = {r.id: r for r in sm.move_uncertain_landmarks(df, t.numpy).collect()}
    assert np.allclose(got["a"].coord, [0, 1]) and np.allclose(got["a"]["cov"], [1, 0, 0, 4], atol=0.3) and got["b"]["cov"] is None


def test_mesh_data_source(spark, tmp_path):
    (tmp_path / "m.ply").write_bytes(fm.write_ply(fm.MeshData(np.eye(3), np.array([[0, 1, 2]]))))
    datasource.register(spark)
    read = spark.read.format("shapelake_mesh").option("path", str(tmp_path / "*.ply"))
    assert read.load().count() == 3 and read.option("table", "cells").load().first().pids == [0, 1, 2]


def test_model_exchange(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, p, *map(float, rng.normal(size=3))) for i in range(4) for p in range(5)]
    shapes = spark.createDataFrame(rows, "item_id long, point_id long, x double, y double, z double")
    m = pdm.pca_model(shapes.filter("item_id = 0").drop("item_id"), shapes)
    again = tb.model_from_json(spark, tb.model_to_json(m))
    a, b = (sorted(map(tuple, x.instance([0.5]).collect())) for x in (m, again))
    assert np.allclose(a, b)
    profiles = spark.createDataFrame([(0, [1.0, 2.0], [1.0, 0.0, 0.0, 1.0])], "point_id long, mean array<double>, precision array<double>")
    tb.write_active_shape_model(asm.ActiveShapeModel(m, profiles, 2, 0.5), str(tmp_path / "asm"))
    back = tb.read_active_shape_model(spark, str(tmp_path / "asm"))
    assert back.n_features == 2 and back.profiles.count() == 1 and back.sample_features().count() == 1


def test_mutual_information_is_best_at_the_truth(spark):
    image = lambda x: (np.exp(-(x**2).sum(axis=1)), None)
    grid = gr.Grid((-2.0, -2.0), (0.2, 0.2), (21, 21)).points(spark).withColumn("f", F.exp(-(F.col("x") * F.col("x") + F.col("y") * F.col("y"))))
    mi = register.MutualInformation(grid, ("x", "y"), "f", image, tf.translation_space(2))
    assert mi.value(np.zeros(2)) < mi.value(np.array([0.8, 0.0])) < 0
    _, g = mi.value_and_derivative(np.array([0.6, 0.0]), 0.1)
    assert g[0] > 0
