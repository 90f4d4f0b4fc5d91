"""Queries without SQL against NumPy, and plans that go other ways by size."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake import model_queries as q
from shapelake.functions.transform import translation_after_rotation
from shapelake.operators import spatial as sp
from shapelake.operators import stats as st
from shapelake.plans import gp, kernels, linalg, pdm

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")


def vectors(spark, v, i, name):
    return spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], f"{i} long, {name} array<double>")


def _chebyshev():
    return lambda a, b: np.abs(a[:, None] - b[None]).max(axis=2)  # not a module's function, so it goes to workers by value


chebyshev = _chebyshev()


@pytest.mark.parametrize("metric", ["l2", "l1", chebyshev])
@pytest.mark.parametrize("k,same", [(1, True), (4, False)])
def test_clusters_give_exact_neighbours(spark, monkeypatch, metric, k, same):
    monkeypatch.setattr(sp, "CLUSTER", 25)
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(c, 0.3, (60, 6)) for c in rng.normal(0, 4, (6, 6))] + [np.zeros((5, 6))])
    queries = p if same else rng.normal(0, 3, (50, 6))
    got = sp.knn(vectors(spark, queries, "q_id", "q_vec"), vectors(spark, p, "p_id", "p_vec"), k, exclude_same_id=same, metric=metric).collect()
    d = chebyshev(queries, p) if metric is chebyshev else np.abs(queries[:, None] - p[None]).sum(2) if metric == "l1" else ((queries[:, None] - p[None]) ** 2).sum(2)
    if same:
        np.fill_diagonal(d, np.inf)
    want = {(i, r + 1): (j, d[i, j]) for i in range(len(d)) for r, j in enumerate(np.lexsort((np.arange(len(p)), d[i]))[:k])}
    assert len(got) == len(want)
    for row in got:
        j, dist = want[row.q_id, row.rank]
        assert row.p_id == j and abs(row.d2 - dist) < 1e-9


def test_clusters_give_exact_ranges(spark, monkeypatch):
    monkeypatch.setattr(sp, "CLUSTER", 30)
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.normal(c, 0.4, (50, 5)) for c in rng.normal(0, 3, (5, 5))])
    got = sp.eps_vectors(vectors(spark, p, "q_id", "q_vec"), vectors(spark, p, "p_id", "p_vec"), 0.9, exclude_same_id=True)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert {(r.q_id, r.p_id) for r in got.collect()} == set(zip(*(x.tolist() for x in np.nonzero(d <= 0.9))))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    empty = vectors(spark, p[:0], "p_id", "p_vec")
    assert sp.knn(vectors(spark, p[:3], "q_id", "q_vec"), empty, 2).count() == 0 == sp.eps_vectors(vectors(spark, p[:3], "q_id", "q_vec"), empty, 1.0).count()


@pytest.mark.parametrize("small", [0, 50, 20_000])
def test_levels_of_cells_give_the_nearest(spark, monkeypatch, small):
    monkeypatch.setattr(sp, "SMALL_LEVEL", small)
    rng = np.random.default_rng(1)
    p, at = rng.normal(0, 10, (1000, 2)), rng.uniform(-60, 60, (200, 2))
    frame = lambda x, i: spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], f"{i} long, x double, y double")
    got = {r.q_id: r.p_id for r in sp.nearest(frame(at, "q_id"), frame(p, "p_id"), 0.4, ("x", "y")).collect()}
    assert [got[i] for i in range(200)] == ((at[:, None] - p[None]) ** 2).sum(2).argmin(1).tolist()
    assert sp.nearest(frame(at, "q_id"), frame(p[:0], "p_id"), 0.4, ("x", "y")).count() == 0


def test_lines_meet_the_boxes_they_cross(spark):
    rng = np.random.default_rng(5)
    low = rng.uniform(-20, 20, (300, 3))
    high = low + rng.uniform(0, 3, (300, 3))
    o, d = rng.uniform(-20, 20, (40, 3)), rng.normal(0, 1, (40, 3))
    d[:5, 0] = 0  # lines in a plane across the first axis
    items = spark.createDataFrame([(k, *a.tolist(), *b.tolist(), *a.tolist()) for k, (a, b) in enumerate(zip(low, high))], "item_id long, " + ", ".join(f"{e}_{n} double" for e in ("lo", "hi", "rep") for n in "xyz"))
    lines = spark.createDataFrame([(k, *a.tolist(), *b.tolist()) for k, (a, b) in enumerate(zip(o, d))], "q_id long, " + ", ".join(f"{e}_{n} double" for e in "od" for n in "xyz"))
    got = {(r.q_id, r.item_id) for r in sp.line_candidates(lines, items, 1.0).collect()}
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = (low[None] - o[:, None]) / d[:, None], (high[None] - o[:, None]) / d[:, None]
    inside = (o[:, None] >= low[None]) & (o[:, None] <= high[None])
    enter = np.where(d[:, None] == 0, np.where(inside, -np.inf, np.inf), np.minimum(a, b)).max(2)
    leave = np.where(d[:, None] == 0, np.where(inside, np.inf, -np.inf), np.maximum(a, b)).min(2)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(enter <= leave)))) and len(got) > 10


def test_folds_number_items_in_their_order(spark):
    rows = {r.i: r.fold for r in st.folds(spark.range(1003).toDF("i").repartition(7), "i", 4, 1003, 2).collect()}
    order = sorted(range(1003), key=lambda i: (((i + 2) * 1103515245 + 12345) % 2**31, i))
    assert [rows[i] for i in order] == [k // 250 if k < 1000 else None for k in range(1003)]


def shapes_of(spark, x, names="xyz"):
    rows = [(i, p, *x[i, p].tolist()) for i in range(x.shape[0]) for p in range(x.shape[1])]
    return spark.createDataFrame(rows, "item_id long, point_id long, " + ", ".join(f"{n} double" for n in names))


def pca_of(x, rank):
    flat = x.reshape(len(x), -1)
    _, s, vt = np.linalg.svd(flat - flat.mean(0), full_matrices=False)
    return flat.mean(0), s[:rank] ** 2 / (len(x) - 1), vt[:rank].T


@pytest.mark.parametrize("items,points,names", [(8, 30, "xyz"), (60, 5, "xyz"), (40, 6, "xy"), (9, 12, "v")])
def test_pca_on_either_side(spark, items, points, names):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (items, points, len(names))) * np.linspace(1, 3, points)[:, None]
    shapes = shapes_of(spark, x, names)
    ref = shapes.groupBy("point_id").agg(*[F.avg(n).alias(n) for n in names])
    m = pdm.pca_model(ref, shapes, rank=4, names=tuple(names))
    mean, variance, basis = pca_of(x, 4)
    assert np.allclose(m.variance, variance) and m.names == tuple(names)
    rows = sorted((r.point_id, r.component, r["mean"], r.basis) for r in m.points.collect())
    b = np.array([r[3] for r in rows])
    assert np.allclose(np.abs((b * basis).sum(0)), 1, atol=1e-6) and np.allclose([r[2] for r in rows], 0, atol=1e-9)
    errors = {r.item_id: r.error for r in pdm.projection_errors(m, shapes).collect()}
    flat = x.reshape(items, -1) - mean
    left = (flat - flat @ basis @ basis.T).reshape(items, points, -1)
    assert np.allclose([errors[i] for i in range(items)], np.sqrt((left**2).sum(2)).mean(1), atol=1e-3)
    assert abs(pdm.generalization(m, shapes) - np.mean(list(errors.values()))) < 1e-12
    draws = [(mean + basis @ (np.sqrt(variance) * np.random.default_rng(2 + k).standard_normal(4) * np.sign((b * basis).sum(0)))).reshape(points, -1) for k in range(3)]
    want = np.mean([min(np.sqrt(((s - y) ** 2).sum(1)).mean() for y in x) for s in draws])
    assert abs(pdm.specificity(m, shapes, 3, 2) - want) < 1e-6
    with pytest.raises(ValueError):
        pdm.pca_model(ref, shapes.filter("NOT (item_id = 1 AND point_id = 2)"), names=tuple(names))


def test_tall_svd(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(0, 1, (400, 3)) @ rng.normal(0, 1, (3, 20)) * 5 + rng.normal(0, 0.1, (400, 20))
    s, v = linalg.tall_random_svd(vectors(spark, a, "k", "v"), "v", 3, power=6)
    _, want, vt = np.linalg.svd(a)
    assert np.allclose(s, want[:3], rtol=1e-6) and np.allclose(np.abs((v * vt[:3].T).sum(0)), 1, atol=1e-6)
    assert len(linalg.tall_random_svd(vectors(spark, a[:0], "k", "v"), "v", 3)[0]) == 0


def test_regression_over_a_table(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 10, 300)
    y = np.sin(x) + rng.normal(0, 0.1, 300)
    low = gp.nystrom(kernels.diagonal(kernels.gaussian(2.0, 2.0), 1), np.linspace(0, 10, 40)[:, None], 10)
    table = spark.createDataFrame([(k, float(a), float(b) if k else None) for k, (a, b) in enumerate(zip(x, y))], "k long, x double, y double")
    got = {r.k: r["mean"] for r in gp.table_regression(low, table, ["x"], "y", 0.01, "k").collect()}
    want = low.posterior(x[1:, None], y[1:, None], 0.01).mean(x[:, None]).ravel()
    assert np.allclose([got[k] for k in range(300)], want, atol=1e-6) and np.abs(want - np.sin(x)).mean() < 0.1


# --- registered queries


@pytest.fixture(scope="module")
def embeddings(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").toPandas()
    return np.stack(rows.embedding.to_numpy()).astype(float)


def as_shapes(e):
    return np.concatenate([e, np.zeros((len(e), 2))], axis=1).reshape(len(e), 22, 3)


def table(df, key, columns):
    return df.toPandas().sort_values(key)[list(columns)].to_numpy(float)


@needs_data
def test_pca_model_query(spark, embeddings):
    x = as_shapes(embeddings)
    mean, variance, basis = pca_of(x, 5)
    m = pdm.pca_model(q._reference(q._shapes(spark, DATA)), q._shapes(spark, DATA), rank=5)
    rows = sorted((r.point_id, r.component, r.basis) for r in m.points.collect())
    sign = np.sign((np.array([r[2] for r in rows]) * basis).sum(0))
    want = mean + basis @ (np.sqrt(variance) * sign * [1, -1, 0, 0, 0])
    assert np.allclose(table(q.QUERIES["pca_model"](spark, DATA), "point_id", "xyz").ravel(), want, atol=1e-3)


@needs_data
def test_pdm_posterior_query(spark, embeddings):
    x = as_shapes(embeddings)
    mean, variance, basis = pca_of(x, 5)
    rows = basis[:15] * np.sqrt(variance)
    a = np.linalg.solve(rows.T @ rows / 0.01 + np.eye(5), rows.T @ (x[3].ravel() - mean)[:15] / 0.01)
    got = table(q.QUERIES["pdm_posterior"](spark, DATA), "point_id", "xyz").ravel()
    assert np.allclose(got, mean + basis @ (np.sqrt(variance) * a), atol=1e-3)


@needs_data
def test_gpa_query(spark, embeddings):
    x = as_shapes(embeddings)
    mean = x[0]
    for _ in range(3):
        out = []
        for s in x:
            a, b = s - s.mean(0), mean - mean.mean(0)
            u, _, vt = np.linalg.svd(b.T @ a)
            turn = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
            out.append(a @ turn.T + mean.mean(0))
        mean = np.mean(out, axis=0)
    assert np.allclose(table(q.QUERIES["gpa"](spark, DATA), "point_id", "xyz"), mean, atol=1e-3)


@needs_data
def test_cross_validation_query(spark, embeddings):
    x = as_shapes(embeddings)
    n = len(x)
    order = sorted(range(n), key=lambda i: ((i * 1103515245 + 12345) % 2**31, i))
    want = []
    for fold in range(3):
        test = order[fold * (n // 3) : (fold + 1) * (n // 3)]
        mean, _, basis = pca_of(np.delete(x, test, axis=0), 5)
        flat = x[test].reshape(len(test), -1) - mean
        want.append(np.sqrt((((flat - flat @ basis @ basis.T).reshape(len(test), 22, 3)) ** 2).sum(2)).mean())
    got = q.QUERIES["cross_validation"](spark, DATA).toPandas().sort_values("fold").error
    assert np.allclose(got, want, rtol=1e-3)


@needs_data
def test_random_svd_query(spark, embeddings):
    got = q.QUERIES["random_svd"](spark, DATA).toPandas().sort_values("k").s
    assert np.allclose(got, np.linalg.svd(embeddings, compute_uv=False)[:10], rtol=5e-3)


@needs_data
def test_gp_queries(spark):
    e = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", (F.hour("ts") + F.minute("ts") / 60.0).alias("x"), "value").orderBy("event_id").toPandas()
    x, y = e[["x"]].to_numpy(float), e[["value"]].to_numpy(float)
    low = gp.nystrom(kernels.diagonal(kernels.gaussian(3.0, 20.0), 1), np.linspace(0, 24, 60)[:, None], 12)
    assert np.allclose(table(q.QUERIES["gp_regression"](spark, DATA), "event_id", ["mean"]), low.posterior(x, y, 25.0).mean(x), atol=1e-4)
    # eigenfunctions on the sample points: the sum over them is the process's draw with ones
    k = kernels.diagonal(kernels.gaussian(4.0), 1)
    samples = np.linspace(0, 24, 60)[:, None]
    values, u = np.linalg.eigh(k.block(samples, samples))
    top = np.argsort(values)[::-1][:8]
    nearby = k.block(x, samples) @ (u[:, top] * np.sqrt(60) / values[top]) * np.sqrt(values[top] / 60)
    got = table(q.QUERIES["nystrom"](spark, DATA), "event_id", ["value"]).ravel()
    signs = np.linalg.lstsq(nearby, got, rcond=None)[0]
    assert np.allclose(np.abs(signs), 1, atol=1e-2) and np.allclose(nearby @ signs, got, atol=1e-4)


@needs_data
def test_cholesky_query(spark):
    p = q.part_mesh(spark, DATA).points.orderBy("point_id").toPandas()[["x", "y", "z"]].to_numpy(float)
    k = np.exp(-((p[:, None] - p[None]) ** 2).sum(2) / 64)
    rest, factor = np.diag(k).copy(), np.zeros((len(p), 0))
    for _ in range(5):
        i = int(np.argmax(rest))
        column = (k[:, i] - factor @ factor[i]) / np.sqrt(rest[i])
        factor = np.concatenate([factor, column[:, None]], axis=1)
        rest = np.maximum(rest - column**2, 0)
        rest[i] = 0
    rows = q.QUERIES["pivoted_cholesky"](spark, DATA).orderBy("point_id").collect()
    assert np.allclose([r.l for r in rows], factor, atol=1e-6)


@needs_data
def test_rigid_query_recovers_the_motion(spark):
    got = q.QUERIES["rigid3d"](spark, DATA).toPandas().sort_values("k").value.to_numpy()
    assert np.allclose(got[:6], [1, 2, 3, 0.3, -0.2, 0.5], atol=1e-4) and translation_after_rotation is not None


@needs_data
def test_sample_surface_query(spark):
    rows = q.QUERIES["sample_surface"](spark, DATA).toPandas()
    assert abs(len(rows) - 5000) < 150 and np.allclose(rows[["u", "v", "w"]].sum(1), 1) and (rows[["u", "v", "w"]] >= 0).all().all()
    area = q.part_mesh(spark, DATA).measures().toPandas().set_index("cell_id").measure
    share = rows.groupby("cell_id").size().reindex(area.index, fill_value=0)
    assert np.abs(share - area / area.sum() * 5000).max() <= 1 + 1e-9
    assert np.allclose(rows[["u", "v", "w"]].mean(), 1 / 3, atol=0.02)


@needs_data
def test_chain_and_registration_queries(spark):
    chain = q.QUERIES["mh_chain"](spark, DATA).toPandas()
    value = np.stack(chain.state.to_numpy())[:, 0] if "state" in chain else chain[[c for c in chain.columns if chain[c].dtype == float][0]].to_numpy()
    assert abs(value.mean() - 1.0) < 0.5 and abs(value.std() - 3.5) < 0.6
    steps = q.QUERIES["registration_fit"](spark, DATA).toPandas().sort_values("iteration")
    assert np.allclose(np.abs(steps[["tx", "ty"]].iloc[-1]), [0.3, 0.2], atol=1e-3) and steps.value.iloc[-1] < 1e-6


@needs_data
def test_bspline_query_goes_through_the_voxels(spark):
    part = spark.read.parquet(f"{DATA}/part.parquet").orderBy("p_partkey").toPandas().p_size.to_numpy(float)
    fine = table(q.QUERIES["bspline_image"](spark, DATA), "q_id", ["value"]).reshape(-1, 79)
    assert np.allclose(fine[::2, ::2], part.reshape(-1, 40), atol=1e-6)
    image = part.reshape(-1, 40)
    n, m = image.shape

    def matrix(n):  # value of the cubic B-spline of each coefficient at each grid point, mirrored edges
        b = np.zeros((n, n))
        for i in range(n):
            for j, w in ((i - 1, 1 / 6), (i, 2 / 3), (i + 1, 1 / 6)):
                b[i, abs(j) if j < n else 2 * n - 2 - j] += w
        return b

    c = np.linalg.solve(matrix(n), image) @ np.linalg.inv(matrix(m)).T
    half = (c[:, 10:14] @ np.array([1, 23, 23, 1]) / 48)
    rows = matrix(n) @ half
    assert np.allclose(fine[::2, 23], rows, atol=1e-6)
