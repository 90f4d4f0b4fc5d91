"""Discrete processes, intensity models, correspondences, samplers, parameters of fits and metrics between surfaces."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.functions import barycentric as bc
from shapelake.operators import grid as gr
from shapelake.operators import mesh as ms
from shapelake.operators import samplers, volume
from shapelake.operators.correspondence import SurfaceCorrespondence, warped_property
from shapelake.plans import discrete, fitting, gp, kernels, mcmc, pdm, register
from shapelake.sources import tables


@pytest.fixture(scope="module")
def process():
    x = np.stack([np.linspace(0, 4, 9), np.zeros(9)], axis=1)
    return discrete.DiscreteProcess.of(gp.GaussianProcess.zero_mean(kernels.diagonal(kernels.gaussian(1.5), 2)), x)


def test_discrete_process(process):
    full = process.distribution()
    assert process.dim == 2 and process.marginal_at(3).cov.shape == (2, 2)
    part = process.marginal([1, 4])
    assert np.allclose(part.cov, full.marginal([2, 3, 8, 9]).cov) and (part.points == process.points[[1, 4]]).all()
    values = np.array([[1.0, 0.5], [np.nan, -1.0]])
    post = process.posterior([2, 6], values, 1e-4)
    assert abs(post.mean[2, 0] - 1) < 1e-2 and abs(post.mean[6, 1] + 1) < 1e-2 and post.marginal_at(2).cov[0, 0] < 1e-3 < post.marginal_at(6).cov[0, 0]
    want = gp.GaussianProcess.zero_mean(kernels.diagonal(kernels.gaussian(1.5), 2)).posterior(process.points[[2, 6]], values, 1e-4)
    assert np.allclose(want.mean(process.points), post.mean, atol=1e-6)
    like = process.marginal_likelihood([2], np.array([[1.0, 0.5]]), 0.1)
    assert abs(like - gp.Mvn(np.zeros(2), 1.1 * np.eye(2)).logpdf(np.array([1.0, 0.5]))) < 1e-9
    draw = process.sample(1)
    assert draw.shape == (9, 2) and np.allclose(process.project(draw), draw, atol=1e-2)
    at = process.interpolate()
    assert np.allclose(at.mean(np.array([[0.9, 3.0]])), post.mean[:1] * 0) and np.allclose(at.kernel.block(np.array([[0.1, 0.0]]), np.array([[0.9, 0.0]])), process.cov[:2, 4:6])
    noisy = discrete.DiscreteProcess(process.points, process.mean, process.cov + 0.1 * np.eye(18))
    assert abs(noisy.logpdf(draw) - noisy.distribution().logpdf(draw.ravel())) < 1e-12 and noisy.pdf(draw * 0) > 0
    for wrong in ((process.points[:3], process.mean, process.cov), (process.points, process.mean, process.cov[:4, :4])):
        with pytest.raises(ValueError):
            discrete.DiscreteProcess(*wrong)
    assert gp.NDimensionalNormal is gp.Mvn


def test_discrete_process_as_a_table(spark, process, tmp_path):
    variance, u = process.low_rank()
    assert np.allclose(u @ np.diag(variance) @ u.T, process.cov, atol=1e-5)
    model = process.model(spark, ("x", "y"))
    a = np.array([1.0, -0.5])
    want = process.points + (u[:, :2] @ (np.sqrt(variance[:2]) * a)).reshape(9, 2)
    got = np.array(sorted(tuple(r) for r in model.instance(a).select("point_id", "x", "y").collect()))
    assert np.allclose(got[:, 1:], want)
    assert np.allclose(process.coefficients(want - process.points)[:2], a, atol=1e-2)
    queries = spark.createDataFrame([(0, 0.6, 0.1), (1, 3.9, -1.0)], "q_id long, x double, y double")
    rows = {(r.q_id, r.component): r.value for r in discrete.interpolated_instance(model, a, queries, 0.5).collect()}
    moved = want - process.points
    assert all(abs(rows[q, c] - moved[p, c]) < 1e-9 for q, p in ((0, 1), (1, 8)) for c in (0, 1))
    tables.write_model(model, str(tmp_path / "m"), "deformation model")
    back = tables.read_model(spark, str(tmp_path / "m"), "deformation model")
    assert back.names == ("x", "y") and np.allclose(back.variance, model.variance) and back.points.count() == 18
    with pytest.raises(ValueError):
        tables.read_model(spark, str(tmp_path / "m"), "shape model")
    again = tables.model_from_json(spark, tables.model_to_json(model))
    assert again.names == ("x", "y") and again.reference.columns == ["point_id", "x", "y"]


def test_volume_intensity_model(spark, tmp_path):
    rng = np.random.default_rng(2)
    x, v = rng.normal(0, 1, (6, 5, 3)), rng.normal(10, 2, (6, 5))
    shapes = spark.createDataFrame([(i, p, *map(float, x[i, p]), float(v[i, p])) for i in range(6) for p in range(5)], "item_id long, point_id long, x double, y double, z double, value double")
    ref = shapes.groupBy("point_id").agg(*[F.avg(n).alias(n) for n in ("x", "y", "z", "value")])
    model = discrete.VolumeIntensityModel(pdm.pca_model(ref.drop("value"), shapes), pdm.pca_model(ref.select("point_id", "value"), shapes, names=("value",)))
    rows = {r.point_id: r for r in model.mean().collect()}
    assert all(abs(rows[p].value - v[:, p].mean()) < 1e-9 and abs(rows[p].x - x[:, p, 0].mean()) < 1e-9 for p in range(5))
    assert [len(z) for z in model.zero_coefficients()] == [5, 5]
    tables.write_volume_intensity_model(model, str(tmp_path / "vi"))
    back = tables.read_volume_intensity_model(spark, str(tmp_path / "vi"))
    one, two = (sorted(map(tuple, m.sample(3).select("point_id", "x", "value").collect())) for m in (model, back))
    assert np.allclose(one, two)
    with pytest.raises(ValueError):
        discrete.VolumeIntensityModel(model.shape, model.shape)


def test_decimated_model(spark):
    ref = points(spark, [(0, 0, 0), (0.1, 0, 0), (5, 0, 0), (5, 5, 0)])
    cells = spark.createDataFrame([(0, [0, 2, 3]), (1, [0, 1, 2])], "cell_id long, pids array<long>")
    rows = [(p, c, 0.0, [float(p == 2 and c == 0)]) for p in range(4) for c in range(3)]
    model = pdm.ShapeModel(ref, spark.createDataFrame(rows, "point_id long, component int, mean double, basis array<double>"), np.array([4.0]), cells)
    small = discrete.decimated(model, 1.0)
    moved = {r.point_id: r.x for r in small.instance([1.0]).collect()}
    assert moved == {0: 0.05, 2: 7.0, 3: 5.0} and small.cells.count() == 1
    with pytest.raises(ValueError):
        discrete.decimated(pdm.ShapeModel(ref, model.points, model.variance), 1.0)
    assert tables.read_statistical_mesh_model is tables.read_model


def points(spark, rows):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(rows)], "point_id long, x double, y double, z double")


def test_shapes_as_fields(spark):
    ref, shape = [(0, 0, 0), (4, 0, 0), (0, 4, 0)], [(1, 0, 0), (4, 1, 0), (0, 4, 1)]
    queries = spark.createDataFrame([(0, 0.4, 0.2, 0.0), (1, 3.0, 0.5, 0.0)], "q_id long, x double, y double, z double")
    moved = {r.q_id: (r.x, r.y, r.z) for r in discrete.mesh_to_transformation(points(spark, ref), points(spark, shape), queries, 1.0).collect()}
    assert moved == {0: (1, 0, 0), 1: (4, 1, 0)}
    shapes = points(spark, shape).withColumn("item_id", F.lit(7))
    fields = {r.q_id: (r.item_id, r.dx, r.dy, r.dz) for r in discrete.displacement_fields(points(spark, ref), shapes, queries, 1.0).collect()}
    assert fields == {0: (7, 1, 0, 0), 1: (7, 0, 1, 0)}
    with pytest.raises(ValueError):
        discrete.mesh_to_transformation(points(spark, ref), points(spark, shape[:2]), queries, 1.0)


def test_likely_points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.1, (40, 4, 3)) + np.arange(4)[:, None] * 5
    shapes = spark.createDataFrame([(i, p, *map(float, x[i, p])) for i in range(40) for p in range(4)], "item_id long, point_id long, x double, y double, z double")
    ref = shapes.groupBy("point_id").agg(*[F.avg(n).alias(n) for n in "xyz"])
    model = pdm.pca_model(ref, shapes)
    target = points(spark, [x[:, p].mean(0) + (0.05 if p < 3 else 2.0) for p in range(4)])
    assert {r.point_id for r in discrete.likely_points(model, target, 3.0, 1.0).collect()} == {0, 1, 2}


def square(spark):
    return ms.Mesh(points(spark, [(0, 0, 0), (2, 0, 0), (2, 2, 0), (0, 2, 0), (9, 9, 9)]).withColumn("value", F.col("x") + 10 * F.col("y")), spark.createDataFrame([(0, [0, 1, 2]), (1, [0, 2, 3])], "cell_id long, pids array<long>"))


def test_correspondence_of_surfaces(spark):
    mesh = square(spark)
    other = ms.Mesh(points(spark, [(5, 5, 5)] * 4), spark.createDataFrame([(10, [2, 0, 1]), (11, [3, 2, 0]), (12, [1, 2, 3])], "cell_id long, pids array<long>"))
    same = spark.createDataFrame([(k, k) for k in range(4)], "point_id long, to_point long")
    c = SurfaceCorrespondence.between(other, mesh, same)
    at = spark.createDataFrame([(1, 10, 0.5, 0.3, 0.2), (2, 11, 0.1, 0.2, 0.7), (3, 12, 1.0, 0.0, 0.0)], "name long, cell_id long, u double, v double, w double")
    got = {r.name: (r.cell_id, r.u, r.v, r.w) for r in c.corresponding(at).collect()}
    assert got == {1: (0, 0.3, 0.2, 0.5), 2: (1, 0.7, 0.2, 0.1)}
    values = {r.name: r.value for r in warped_property(mesh, c, at).collect()}
    # corners 0, 1, 2, 3 have 0, 2, 22, 20
    assert abs(values[1] - (0.3 * 0 + 0.2 * 2 + 0.5 * 22)) < 1e-12 and abs(values[2] - (0.7 * 0 + 0.2 * 22 + 0.1 * 20)) < 1e-12
    small, ids = mesh.compact()
    back = SurfaceCorrespondence.of_compaction(mesh, small, ids)
    assert sorted((r.cell_id, r.to_cell, r.corners) for r in back.cells.collect()) == [(0, 0, [0, 1, 2]), (1, 1, [0, 1, 2])]


def test_metrics_between_surfaces(spark):
    mesh = ms.Mesh(square(spark).points.filter("point_id < 4"), square(spark).cells)
    above = mesh.with_points(mesh.points.withColumn("z", F.when(F.col("point_id") == 2, 3.0).otherwise(1.0)))
    assert abs(ms.average_surface_distance(above, mesh, 1.0).first()[0] - 1.5) < 1e-9
    assert abs(ms.surface_hausdorff(mesh, above, 1.0).first()[0] - 3.0) < 1e-9
    spheres = {r.cell_id: r for r in mesh.containment_spheres().collect()}
    assert abs(spheres[0].radius - math.sqrt(2)) < 1e-9 and abs(spheres[0].cx - 1) < 1e-9


def test_least_spheres_hold_all_corners():
    rng = np.random.default_rng(4)
    for m in (1, 2, 3, 4):
        c = rng.normal(0, 1, (200, m, 3))
        centre, radius = bc.containment_spheres(c)
        far = np.linalg.norm(c - centre[:, None], axis=2)
        assert (far.max(1) <= radius + 1e-9).all()
        for _ in range(20):  # no nearby centre does better
            moved = np.linalg.norm(c - (centre + rng.normal(0, 0.02, centre.shape))[:, None], axis=2).max(1)
            assert (moved >= radius - 1e-9).all()
    flat = np.array([[[0, 0, 0], [1, 0, 0], [2, 0, 0], [2, 0, 0]]], float)
    assert np.allclose(bc.containment_spheres(flat)[1], 1)


def test_closest_point_of_a_volume(spark):
    tet = ms.Mesh(points(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]), spark.createDataFrame([(4, [0, 1, 2, 3])], "cell_id long, pids array<long>"), 4)
    q = spark.createDataFrame([(0, 0.1, 0.1, 0.1), (1, 0.2, 0.3, -2.0), (2, 5.0, -1.0, -1.0)], "q_id long, x double, y double, z double")
    rows = {r.q_id: r for r in volume.closest_in_volume(tet, q, 1.0).collect()}
    assert rows[0].inside and rows[0].cell_id == 4 and np.allclose(rows[0].weights, [0.7, 0.1, 0.1, 0.1])
    assert not rows[1].inside and abs(rows[1].d2 - 4) < 1e-12 and np.allclose([rows[1].x, rows[1].y, rows[1].z], [0.2, 0.3, 0])
    assert np.allclose([rows[2].x, rows[2].y, rows[2].z], [1, 0, 0]) and len(rows[2].weights) == 3


def test_samplers_of_vertices(spark):
    tet = ms.Mesh(points(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]), spark.createDataFrame([(4, [0, 1, 2, 3])], "cell_id long, pids array<long>"), 4)
    drawn = lambda seed: samplers.vertices(tet, 400, seed).orderBy("sample_id").collect()
    rows = drawn(5)
    assert len(rows) == 400 and rows == drawn(5) != drawn(6)
    counts = {}
    for r in rows:
        counts[r.x, r.y, r.z] = counts.get((r.x, r.y, r.z), 0) + 1
        assert abs(r.density - 6) < 1e-9
    assert len(counts) == 4 and min(counts.values()) > 60
    kept = samplers.fixed(samplers.in_tetrahedra(tet, 50, 1))
    assert sorted(kept.collect()) == sorted(kept.collect())


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_gradient_of_an_interpolated_image(spark, degree):
    turn = ((0.0, -1.0), (1.0, 0.0))
    grid = gr.Grid((1.0, 2.0), (0.5, 0.25), (12, 15), turn)
    image = grid.points(spark, ("x", "y")).select("voxel_id", (F.sin("x") + F.col("y") * F.col("y") / 4).alias("value"))
    coefficients = gr.bspline_coefficients(image, grid, degree)
    rng = np.random.default_rng(6)
    index = rng.uniform(2, 9, (40, 2))
    at = np.array([1.0, 2.0]) + (index * [0.5, 0.25]) @ np.array(turn).T
    h = 1e-5
    rows = [(k * 5 + j, *map(float, p + d)) for k, p in enumerate(at) for j, d in enumerate(([0, 0], [h, 0], [-h, 0], [0, h], [0, -h]))]
    q = spark.createDataFrame(rows, "q_id long, x double, y double")
    got = {r.q_id: r for r in gr.interpolate_with_gradient(q, coefficients, grid, ("x", "y"), degree=degree).collect()}
    plain = {r.q_id: r.value for r in gr.interpolate(q, coefficients, grid, ("x", "y"), degree=degree).collect()}
    for k in range(40):
        r = got[5 * k]
        assert abs(r.value - plain[5 * k]) < 1e-12
        want = [(plain[5 * k + 1] - plain[5 * k + 2]) / (2 * h), (plain[5 * k + 3] - plain[5 * k + 4]) / (2 * h)]
        assert np.allclose([r.g0, r.g1], want, atol=1e-4)


def test_parameters_of_a_fit():
    p = fitting.Parameters((0.5, -1.0), (1.0, 2.0, 3.0), (0.1, 0.2, 0.3), 2.0)
    assert fitting.Parameters.of(p.flat()) == p and np.allclose(fitting.SHAPE.get(p.flat()), [0.5, -1])
    assert fitting.Lens.field("scale").put(p, 3.0).scale == 3.0
    moved = p.pose((1.0, 0.0, 0.0)).numpy(np.array([[1.0, 0.0, 0.0]]))
    assert np.allclose(moved, 2 * np.array([[1.0, 0, 0]]) + [1, 2, 3])
    with pytest.raises(ValueError):
        fitting.Parameters.of(np.zeros(3))
    rng = np.random.default_rng(7)
    walk = fitting.partial(mcmc.random_walk(0.5, "angles"), fitting.ANGLES)
    new, label = walk.propose(p.flat(), rng)
    assert label == "angles" and (new[[0, 1, 2, 6, 7, 8]] == p.flat()[[0, 1, 2, 6, 7, 8]]).all() and (new[3:6] != p.flat()[3:6]).all()
    assert np.isfinite(walk.log_transition(p.flat(), new)) and walk.log_transition(p.flat(), p.flat() + 1) == -math.inf
    inner = fitting.Lens.at(slice(3, 6)).then(fitting.Lens.at([1]))
    assert inner.put(p.flat(), [9.0])[4] == 9.0 and inner.get(p.flat())[0] == 0.2
    typed = fitting.converted(walk, fitting.Parameters.flat, fitting.Parameters.of)
    assert isinstance(typed.propose(p, rng)[0], fitting.Parameters) and typed.symmetric
    pair = fitting.pair_evaluator(mcmc.gaussian_evaluator(0, 1), mcmc.gaussian_evaluator(2, 3), 2)
    s = np.array([0.1, 0.2, 0.3])
    assert abs(pair(s) - mcmc.gaussian_evaluator(0, 1)(s[:2]) - mcmc.gaussian_evaluator(2, 3)(s[2:])) < 1e-12
    exact = fitting.corrected(mcmc.random_walk(1.0), mcmc.gaussian_evaluator(0, 1))
    steps = mcmc.metropolis_hastings(exact, mcmc.gaussian_evaluator(0, 1), np.zeros(1), rng)
    assert all(next(steps)[1] for _ in range(50))  # its ratio cancels the gain


def test_prefetching_gives_the_same_chain():
    run = lambda f, **more: [x[0][0] for x, _ in zip(f(mcmc.random_walk(1.0), mcmc.gaussian_evaluator(1, 2), np.zeros(1), np.random.default_rng(8), **more), range(4000))]
    one, many = run(mcmc.metropolis_hastings), run(mcmc.with_prefetching, batch=4)
    assert abs(np.mean(one) - 1) < 0.4 and abs(np.mean(many) - 1) < 0.4 and abs(np.std(many) - 2) < 0.5


def test_jacobian_of_a_deformation():
    low = gp.nystrom(kernels.diagonal(kernels.gaussian(2.0), 2), np.random.default_rng(9).uniform(0, 3, (30, 2)), 4)
    t = register.gp_transformation_space(low)((0.1, 0.2, -0.3, 0.4))
    x, h = np.array([[1.0, 2.0]]), 1e-6
    columns = [(register.gp_transformation_space(low)(tuple(np.array(t.parameters) + h * e)).numpy(x) - register.gp_transformation_space(low)(tuple(np.array(t.parameters) - h * e)).numpy(x)).ravel() / (2 * h) for e in np.eye(4)]
    assert np.allclose(t.parameter_jacobian(x), np.stack(columns, axis=1), atol=1e-5)
