import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.operators import grid as gr
from shapelake.operators import mesh as ms
from shapelake.operators import spatial as sp


def sphere(spark, radius=1.0, rounds=2):
    """A subdivided icosahedron."""
    g = (1 + 5**0.5) / 2
    p = [np.array(v, float) for v in [(-1, g, 0), (1, g, 0), (-1, -g, 0), (1, -g, 0), (0, -1, g), (0, 1, g), (0, -1, -g), (0, 1, -g), (g, 0, -1), (g, 0, 1), (-g, 0, -1), (-g, 0, 1)]]
    f = [(0, 11, 5), (0, 5, 1), (0, 1, 7), (0, 7, 10), (0, 10, 11), (1, 5, 9), (5, 11, 4), (11, 10, 2), (10, 7, 6), (7, 1, 8), (3, 9, 4), (3, 4, 2), (3, 2, 6), (3, 6, 8), (3, 8, 9), (4, 9, 5), (2, 4, 11), (6, 2, 10), (8, 6, 7), (9, 8, 1)]
    for _ in range(rounds):
        mid, out = {}, []
        for t in f:
            k = []
            for a, b in zip(t, t[1:] + t[:1]):
                key = (min(a, b), max(a, b))
                if key not in mid:
                    mid[key] = len(p)
                    p.append((p[a] + p[b]) / 2)
                k.append(mid[key])
            out += [(t[0], k[0], k[2]), (t[1], k[1], k[0]), (t[2], k[2], k[1]), tuple(k)]
        f = out
    p = [radius * v / np.linalg.norm(v) for v in p]
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "point_id long, x double, y double, z double")
    return ms.Mesh(points, spark.createDataFrame([(i, list(map(int, t))) for i, t in enumerate(f)], "cell_id long, pids array<long>"))


def test_sphere(spark):
    m = sphere(spark)
    assert abs(m.measure().first()[0] - 4 * np.pi) < 0.3
    assert m.boundary_facets().count() == 0
    n = m.vertex_normals().join(m.points, "point_id").select((F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z")).alias("d"))
    assert n.agg(F.min("d")).first()[0] > 0.98


def test_clip_opens_a_boundary_and_compact_renumbers(spark):
    m = sphere(spark).clip(F.col("z") > 0.5)
    assert m.boundary_facets().count() > 0
    small, ids = m.compact()
    n = small.points.count()
    assert small.points.agg(F.min("point_id"), F.max("point_id"), F.countDistinct("point_id")).first() == (0, n - 1, n)
    assert abs(small.measure().first()[0] - m.measure().first()[0]) < 1e-9
    both = small.join(small)
    assert abs(both.measure().first()[0] - 2 * m.measure().first()[0]) < 1e-9


def test_closest_point_on_sphere(spark):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(40, 3)) * 2
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(q)], "q_id long, x double, y double, z double")
    got = {r.q_id: r for r in sphere(spark, rounds=3).closest_on_surface(rows, 0.5).collect()}
    assert len(got) == 40
    for i, v in enumerate(q):
        assert abs(got[i].d2**0.5 - abs(np.linalg.norm(v) - 1)) < 0.02
        assert abs(got[i].u + got[i].v + got[i].w - 1) < 1e-9


def test_line_through_sphere_meets_it_twice(spark):
    lines = spark.createDataFrame([(1, 0.013, 0.021, 5.0, 0.001, 0.002, -1.0)], "line_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    t = sorted(r.t for r in sphere(spark).intersections(lines).collect())
    assert len(t) == 2 and abs(t[0] - 4) < 0.05 and abs(t[1] - 6) < 0.05


def test_outer_surface_of_two_tetrahedra(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0), (4, 1.0, 1.0, 1.0)], "point_id long, x double, y double, z double")
    m = ms.Mesh(points, spark.createDataFrame([(0, [0, 1, 2, 3]), (1, [1, 2, 3, 4])], "cell_id long, pids array<long>"), 4)
    surface = m.outer_surface()
    assert surface.cells.count() == 6 and surface.boundary_facets().count() == 0
    out = surface.cell_normals().join(surface.cornered().select("cell_id", "a0"), "cell_id")
    centre = F.struct(*[F.lit(0.4).alias(n) for n in "xyz"])
    away = sum(((F.col(f"a0.{n}") - centre[n]) * F.col(f"n{n}") for n in "xyz"), F.lit(0.0))
    assert out.select(F.min(away)).first()[0] > 0


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    p, q = rng.random((300, 3)), rng.random((60, 3)) * 3
    frame = lambda a, k: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(a)], f"{k} long, x double, y double, z double")
    got = {r.q_id: r.p_id for r in sp.nearest(frame(q, "q_id"), frame(p, "p_id"), 0.1).collect()}
    d = ((q[:, None] - p[None]) ** 2).sum(2)
    assert got == {i: int(k) for i, k in enumerate(d.argmin(1))}


def test_knn_ties_go_to_the_smaller_id(spark):
    q = spark.createDataFrame([(0, [0.0, 0.0])], "q_id long, q_vec array<double>")
    p = spark.createDataFrame([(7, [1.0, 0.0]), (3, [0.0, 1.0]), (5, [-1.0, 0.0]), (9, [2.0, 0.0])], "p_id long, p_vec array<double>")
    assert [r.p_id for r in sp.knn(q, p, 2).orderBy("rank").collect()] == [3, 5]
    assert sp.knn(q, p.filter("p_id < 0"), 2).count() == 0


def test_grid_maps(spark):
    g = gr.Grid((1.0, 2.0), (0.5, 2.0), (4, 3))
    rows = g.points(spark).collect()
    assert rows[5].x == 1.5 and rows[5].y == 4.0 and len(rows) == 12
    assert gr.Grid.from_box((0,), (10,), (4,)).spacing == (2.0,) and gr.Grid.from_box((0, 0), (10, 10), (5, 4)).spacing == (2.0, 2.5)


@pytest.mark.parametrize("degree", [0, 1, 2, 3])
def test_interpolation_keeps_grid_values(spark, degree):
    g = gr.Grid((0.0, 0.0), (1.0, 1.0), (7, 5))
    image = g.points(spark).select("voxel_id", (F.sin("x") + F.cos("y") * 2).alias("value")).cache()
    got = gr.interpolate(g.points(spark), gr.bspline_coefficients(image, g, degree), g, ("x", "y"), "voxel_id", degree)
    worst = got.join(image.withColumnsRenamed({"voxel_id": "q_id", "value": "v"}), "q_id").agg(F.max(F.abs(F.col("value") - F.col("v")))).first()[0]
    assert worst < 1e-9


def test_distance_transform_of_a_half(spark):
    g = gr.Grid((0.0, 0.0), (1.0, 1.0), (6, 4))
    mask = g.points(spark).select("voxel_id", "x", (F.col("x") >= 3).alias("value"))
    values = gr.distance_transform(mask.select("voxel_id", "value"), g).join(mask.select("voxel_id", "x"), "voxel_id").select("x", "value").distinct().collect()
    assert {(r.x, r.value) for r in values} == {(0, 3), (1, 2), (2, 1), (3, -1), (4, -2), (5, -3)}


def test_surface_samples_follow_the_area(spark):
    m = sphere(spark)
    s = ms.sample_on_surface(m, 4000, 1)
    assert abs(s.count() - 4000) < 120
    assert abs(s.agg(F.avg(F.col("u") + F.col("v") + F.col("w"))).first()[0] - 1) < 1e-9
