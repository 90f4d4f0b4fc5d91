import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.functions import transform as tf
from shapelake.operators import stats as st
from shapelake.plans import asm, gp, kernels, linalg, mcmc, pdm, register


def test_pivoted_cholesky():
    x = np.random.default_rng(0).random((60, 1))
    k = kernels.gaussian(1.0).block(x, x)
    l, pivots = linalg.pivoted_cholesky(np.diag(k), lambda i: k[:, i], 1e-10)
    assert np.linalg.norm(k - l @ l.T) < 1e-5 and len(pivots) < 20
    u, values = linalg.approximate_eig(k, 1e-12)
    assert np.allclose(values[:3], np.sort(np.linalg.eigvalsh(k))[::-1][:3])


def test_tall_cholesky_agrees(spark):
    x = np.random.default_rng(1).random((40, 2))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "point_id long, x double, y double")
    rows = linalg.tall_pivoted_cholesky(df, kernels.gaussian(1.0), ["x", "y"], 4).orderBy("point_id").collect()
    k = kernels.gaussian(1.0).block(x, x)
    expect, _ = linalg.pivoted_cholesky(np.diag(k), lambda i: k[:, i], most=4)
    assert np.allclose(np.array([r.l for r in rows]), expect, atol=1e-8)


def test_random_svd_and_optimisers():
    a = np.random.default_rng(2).random((30, 30))
    assert np.allclose(linalg.random_svd(a, 5)[1], np.linalg.svd(a)[1][:5], rtol=1e-3)
    cost = lambda x: (float(((x - 3) ** 2).sum()), 2 * (x - 3))
    assert np.allclose(list(linalg.lbfgs(cost, np.zeros(3)))[-1].parameters, 3, atol=1e-4)
    for search in ("fixed", "golden", "robbins-monro"):
        assert np.allclose(list(linalg.gradient_descent(cost, np.zeros(2), 300, 0.3, search))[-1].parameters, 3, atol=0.1)


def test_kernels():
    x, y = np.random.default_rng(3).random((4, 2)), np.random.default_rng(4).random((3, 2))
    g = kernels.gaussian(2.0, 3.0)
    assert np.allclose(g.block(x, y), 9 * np.exp(-((x[:, None] - y) ** 2).sum(2) / 4))
    assert np.allclose((g + g * 2.0).block(x, y), 3 * g.block(x, y))
    assert kernels.diagonal(g, 3).block(x, y).shape == (12, 9)
    assert np.all(np.linalg.eigvalsh(kernels.bspline_kernel(3, 1).block(x, x)) > -1e-9)
    with pytest.raises(ValueError):
        kernels.diagonal(g, 2) + kernels.diagonal(g, 3)


def test_mvn():
    m = gp.Mvn(np.array([1.0, 2.0]), np.array([[2.0, 0.5], [0.5, 1.0]]))
    x = np.array([0.3, 2.5])
    assert math.isclose(m.logpdf(x), math.log(m.pdf(x)), rel_tol=1e-6)
    c = m.conditional({0: 2.0})
    assert math.isclose(c.mean[0], 2.25) and math.isclose(c.cov[0, 0], 0.875)
    s = m.sample(40000, 1)
    assert np.allclose(np.cov(s.T), m.cov, atol=0.06)
    assert m.marginal([1]).mean[0] == 2.0 and m.principal_components()[0][1] > m.principal_components()[1][1]


def test_regression_keeps_landmarks_and_forms_agree():
    k = kernels.diagonal(kernels.gaussian(1.0), 1)
    x, y = np.linspace(0, 3, 7)[:, None], np.sin(np.linspace(0, 3, 7))[:, None]
    exact = gp.GaussianProcess.zero_mean(k).posterior(x, y, 1e-8)
    assert np.allclose(exact.mean(x), y, atol=1e-4)
    low = gp.nystrom(k, np.linspace(-1, 4, 80)[:, None], 30)
    assert np.allclose(low.posterior(x, y, 1e-4).mean(x), gp.GaussianProcess.zero_mean(k).posterior(x, y, 1e-4).mean(x), atol=1e-2)
    assert math.isclose(low.marginal_likelihood(x, y, 0.1), gp.GaussianProcess(low.mean, kernels.MatrixKernel(1, low.covariance)).marginal_likelihood(x, y, 0.1), rel_tol=1e-6)
    with_gap = y.copy()
    with_gap[3] = np.nan
    assert np.isfinite(low.posterior(x, with_gap, 1e-4).mean(x)).all()
    chol = gp.cholesky_process(k, np.linspace(0, 3, 40)[:, None], 1e-10)
    assert np.allclose(chol.covariance(x, x), k.block(x, x), atol=1e-3)


def shapes_of(spark, n=6, points=15, seed=0):
    rng = np.random.default_rng(seed)
    base, modes = rng.normal(size=(points, 3)), rng.normal(size=(2, points, 3))
    rows = []
    for i in range(n):
        s = base + rng.normal() * modes[0] + 0.3 * rng.normal() * modes[1]
        rows += [(i, p, *map(float, v)) for p, v in enumerate(s)]
    shapes = spark.createDataFrame(rows, "item_id long, point_id long, x double, y double, z double")
    return shapes, shapes.groupBy("point_id").agg(*[F.avg(c).alias(c) for c in "xyz"])


def numbers(df):
    return np.array([(r.x, r.y, r.z) for r in df.orderBy("point_id").collect()])


def test_pca_model_projects_training_shapes(spark):
    shapes, ref = shapes_of(spark)
    ref = ref.checkpoint()
    m = pdm.pca_model(ref, shapes)
    assert m.rank == 2
    one = shapes.filter("item_id = 2").select("point_id", "x", "y", "z")
    assert np.allclose(numbers(m.project(one)), numbers(one), atol=1e-3)
    assert np.allclose(numbers(m.mean()), numbers(ref))
    post = m.posterior(one.filter("point_id < 4"), 1e-4)
    assert np.allclose(numbers(post.mean()), numbers(one), atol=0.05)
    moved = m.transform(tf.rotation((0.1, 0.2, 0.3), (0, 0, 0)))
    assert np.allclose(numbers(moved.instance([1.0])), tf.rotation((0.1, 0.2, 0.3), (0, 0, 0)).numpy(numbers(m.instance([1.0]))), atol=1e-6)
    with pytest.raises(ValueError):
        pdm.pca_model(ref, shapes.filter("item_id < 2"))


def test_gpa_removes_rigid_motion(spark):
    shapes, _ = shapes_of(spark, 1)
    base = shapes.select("point_id", "x", "y", "z")
    all_ = None
    for i in range(3):
        t = tf.translation_after_rotation((i, 2 * i, 0), (0.2 * i, 0.1, -0.1 * i), (0, 0, 0))
        part = t.on(base, ("x", "y", "z")).withColumn("item_id", F.lit(i).cast("long"))
        all_ = part if all_ is None else all_.unionByName(part)
    aligned, mean = pdm.gpa(all_)
    spread = aligned.groupBy("point_id").agg(F.stddev_pop("x").alias("s")).agg(F.max("s")).first()[0]
    assert spread < 1e-6


@pytest.mark.parametrize("dim", [2, 3])
def test_landmark_registration(spark, dim):
    names = ("x", "y", "z")[:dim]
    x = np.random.default_rng(5).normal(size=(8, dim))
    angles = (0.4,) if dim == 2 else (0.4, -0.2, 0.3)
    t = tf.similarity((1.0,) * dim, 1.3, angles, (0.0,) * dim)
    frame = lambda a: spark.createDataFrame([(str(i), *map(float, v)) for i, v in enumerate(a)], "id string, " + ", ".join(f"{n} double" for n in names))
    fit = register.landmark_fit(register.match_landmarks(frame(x), frame(t.numpy(x)), names), names, similarity=True)
    assert np.allclose(fit.numpy(x), t.numpy(x), atol=1e-8)
    with pytest.raises(ValueError):
        register.landmark_fit(register.match_landmarks(frame(x[:1]), frame(x[:1]), names), names)


def test_huber_has_no_absolute_value(spark):
    df = spark.createDataFrame([(-10.0,), (10.0,)], "r double")
    assert math.isclose(df.agg(st.huber(F.col("r"))).first()[0], (50 + 1.345 * (10 - 1.345 / 2)) / 2)


def test_metropolis_hastings(spark):
    chain = mcmc.chains(spark, mcmc.mixture((0.5, mcmc.random_walk(3.0)), (0.5, mcmc.random_walk(8.0))), mcmc.gaussian_evaluator(1.0, 3.5), [0.0], 8, 500, 5000)
    row = chain.select(F.get("state", F.lit(0)).alias("x")).agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
    assert abs(row.m - 1) < 0.25 and abs(row.s - 3.5) < 0.4
    assert {r.generated_by for r in mcmc.acceptance_ratios(chain).collect()} == {"RandomWalk(3.0)", "RandomWalk(8.0)"}
    assert mcmc.best_sample(chain).first().logp <= mcmc.gaussian_evaluator(1.0, 3.5)(np.array([1.0]))
    again = mcmc.chains(spark, mcmc.random_walk(3.0), mcmc.gaussian_evaluator(1.0, 3.5), [0.0], 2, 0, 50)
    assert again.collect() == again.collect()


def test_prefetching_and_filters():
    rng = np.random.default_rng(0)
    e = mcmc.gaussian_evaluator(1.0, 3.5)
    for it in (mcmc.with_prefetching(mcmc.random_walk(6.0), e, np.zeros(1), rng), mcmc.metropolis_hastings(mcmc.filtered(mcmc.random_walk(6.0), e), mcmc.cached(e), np.zeros(1), rng)):
        x = [float(next(it)[0][0]) for _ in range(12000)]
        assert abs(np.mean(x[1000:]) - 1) < 0.5
    both = mcmc.combined(mcmc.random_walk(1.0, "a"), mcmc.identity())
    assert both.propose(np.zeros(2), rng)[1] == "Combined(a,Identity)"
    assert mcmc.mixture((1, mcmc.identity())).log_transition(np.zeros(1), np.ones(1)) == -math.inf


def test_active_shape_fit(spark):
    ring = np.array([[math.cos(a), math.sin(a), 0.0] for a in np.linspace(0, 2 * math.pi, 24, endpoint=False)])
    sizes = [0.8, 0.9, 1.0, 1.1, 1.2]
    rows = [(i, p, *map(float, v * s), *map(float, v)) for i, s in enumerate(sizes) for p, v in enumerate(ring)]
    samples = spark.createDataFrame(rows, "item_id long, point_id long, x double, y double, z double, nx double, ny double, nz double")
    ref = spark.createDataFrame([(p, *map(float, v)) for p, v in enumerate(ring)], "point_id long, x double, y double, z double")
    image = lambda s: lambda x: 1 / (1 + np.exp(20 * (np.linalg.norm(x, axis=1) - s)))
    model = asm.train(pdm.pca_model(ref, samples, rank=1), samples, lambda i: image(sizes[i]), 5, 0.1)
    normals = lambda df: df.withColumn("r", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).select("point_id", "x", "y", "z", (F.col("x") / F.col("r")).alias("nx"), (F.col("y") / F.col("r")).alias("ny"), F.lit(0.0).alias("nz"))
    *_, (_, shape) = asm.fit(model, image(1.15), normals, np.linspace(-0.4, 0.4, 17), 4, 0.01)
    assert abs(np.linalg.norm(numbers(shape), axis=1).mean() - 1.15) < 0.05


def test_folds_leave_the_rest_out(spark):
    df = st.folds(spark.range(10), "id", 3, 10)
    sizes = {r.fold: r["count"] for r in df.groupBy("fold").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 3, None: 1}
