"""Dense algebra for the small side of models, pivoted decompositions and optimisers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.storage import saved


def pivoted_cholesky(diagonal: np.ndarray, column: Callable[[int], np.ndarray], tolerance: float = 1e-6, relative: bool = True, most: int | None = None) -> tuple[np.ndarray, list[int]]:
    """L with L Lt close to the matrix, and the pivots; column(i) gives column i of the matrix.

    Stops when the trace of what is left is at most the tolerance (times the trace if relative), or after `most` columns.
    """
    rest = diagonal.astype(float).copy()
    limit = tolerance * (rest.sum() if relative else 1.0)
    most = len(rest) if most is None else min(most, len(rest))
    found, pivots = np.zeros((len(rest), most)), []
    for k in range(most):
        p = int(np.argmax(rest))
        if rest.sum() <= limit or rest[p] <= 0:
            return found[:, :k], pivots
        pivots.append(p)
        found[:, k] = (column(p) - found[:, :k] @ found[p, :k]) / np.sqrt(rest[p])
        rest = np.maximum(rest - found[:, k] ** 2, 0)
        rest[p] = 0
    return found, pivots


def approximate_eig(matrix: np.ndarray, tolerance: float = 1e-6, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvectors and eigenvalues of a positive matrix by way of its pivoted Cholesky factor."""
    factor, _ = pivoted_cholesky(np.diag(matrix), lambda i: matrix[:, i], tolerance, most=most)
    return eig_of_factor(factor)


def eig_of_factor(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(U, values) with U diag(values) Ut = factor factort; the largest part of each vector is positive."""
    values, v = np.linalg.eigh(factor.T @ factor)
    order = np.argsort(values)[::-1]
    order = order[values[order] > max(values.max(initial=0) * 1e-14, 0)]
    u = factor @ v[:, order] / np.sqrt(values[order])
    return fix_signs(u), values[order]


def fix_signs(u: np.ndarray) -> np.ndarray:
    if u.size == 0:
        return u
    top = u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])]
    return u * np.where(top < 0, -1, 1)


def random_svd(a: np.ndarray, k: int, seed: int = 0, power: int = 5, extra: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Randomised SVD of a square matrix: subspace iteration on k + extra random vectors."""
    if a.shape[0] != a.shape[1]:
        raise ValueError("a square matrix is needed")
    q = np.linalg.qr(a @ np.random.default_rng(seed).standard_normal((a.shape[1], min(k + extra, a.shape[1]))))[0]
    for _ in range(power):
        q = np.linalg.qr(a @ np.linalg.qr(a.T @ q)[0])[0]
    u, s, vt = np.linalg.svd(q.T @ a, full_matrices=False)
    return (q @ u)[:, :k], s[:k], vt[:k]


def tall_random_svd(rows: DataFrame, column: str, k: int, seed: int = 0, power: int = 3, extra: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors) of the matrix whose rows are an array column, however many rows there are.

    Subspace iteration on k + extra random vectors of the width: a step is one pass that sums A^t A q over the rows, so the driver
    holds width x (k + extra) numbers; null rows are left out.
    """
    some = rows.select(F.col(column).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    first = some.first()
    if first is None:
        return np.zeros(0), np.zeros((0, 0))
    d = len(first.v)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(k + extra, d))))[0]

    def step(q: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(q.shape)
            for pdf in batches:
                if len(pdf):
                    a = np.stack(pdf.v.to_numpy())
                    total += a.T @ (a @ q)
            yield pd.DataFrame({"k": np.arange(d), "v": list(total)})

        parts = some.mapInPandas(run, "k int, v array<double>").groupBy("k").agg(*[F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(q.shape[1])]).toPandas().sort_values("k")
        return parts[[f"v{j}" for j in range(q.shape[1])]].to_numpy()

    for _ in range(power):
        q = np.linalg.qr(step(q))[0]
    values, turn = np.linalg.eigh(q.T @ step(q))
    order = np.argsort(values)[::-1][:k]
    return np.sqrt(np.maximum(values[order], 0)), fix_signs(q @ turn[:, order])


def tall_pivoted_cholesky(points: DataFrame, kernel, names: list[str], most: int, tolerance: float = 1e-6, key: str = "point_id") -> DataFrame:
    """(point_id, l array<double>): pivoted Cholesky of the kernel matrix of many points, one pass over them a pivot.

    The rows stay in a table; the driver sees the pivot point and its row, of at most `most` numbers.
    """
    from shapelake.functions.vector import Vec

    p = Vec.of(*names)
    state = points.select(key, *names, F.array().cast("array<double>").alias("l"), kernel.column(p, p).cast("double").alias("rest")).transform(saved)
    first = state.agg(F.sum("rest")).first()[0] or 0.0
    for _ in range(most):
        top = state.agg(F.max_by(F.struct(key, *names, "l", "rest"), F.struct("rest", (-F.col(key)).alias("i"))).alias("p"), F.sum("rest").alias("t")).first()
        if top.p is None or top.t <= tolerance * first or top.p.rest <= 0:
            break
        done = F.lit(0.0)
        for j, v in enumerate(top.p.l):
            done = done + F.get("l", F.lit(j)) * v
        new = (kernel.column(p, Vec.of(*[top.p[n] for n in names])) - done) / float(np.sqrt(top.p.rest))
        state = state.withColumn("__n", new).select(key, *names, F.concat("l", F.array("__n")).alias("l"), F.when(F.col(key) == top.p[key], 0.0).otherwise(F.greatest(F.col("rest") - F.col("__n") * F.col("__n"), F.lit(0.0))).alias("rest")).transform(saved)
    return state.select(key, "l")


@dataclass(frozen=True)
class Step:
    iteration: int
    parameters: np.ndarray
    value: float


Cost = Callable[[np.ndarray], tuple[float, np.ndarray]]


def lbfgs(cost: Cost, start: np.ndarray, iterations: int = 100, memory: int = 10, tolerance: float = 1e-5) -> Iterator[Step]:
    """States of limited-memory BFGS with a backtracking line search; cost gives value and gradient."""
    x = np.asarray(start, float)
    f, g = cost(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    yield Step(0, x, f)
    for k in range(1, iterations + 1):
        if np.linalg.norm(g) <= tolerance * max(1.0, np.linalg.norm(x)):
            return
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (y @ s)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas)):
            q += (a - y @ q / (y @ s)) * s
        step = 1.0 if pairs else min(1.0, 1.0 / np.linalg.norm(g))
        slope = -g @ q
        while step > 1e-12:
            new = x - step * q
            f_new, g_new = cost(new)
            if f_new <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            return
        if (new - x) @ (g_new - g) > 1e-12:
            pairs = [*pairs, (new - x, g_new - g)][-memory:]
        done = abs(f - f_new) <= 1e-14 * max(1.0, abs(f))
        x, f, g = new, f_new, g_new
        yield Step(k, x, f)
        if done:
            return


def gradient_descent(cost: Cost, start: np.ndarray, iterations: int = 100, step: float = 0.1, search: str = "fixed") -> Iterator[Step]:
    """States of gradient descent; search: fixed, golden (golden section, 8 evaluations) or robbins-monro (step / k)."""
    x = np.asarray(start, float)
    ratio = (np.sqrt(5) - 1) / 2
    for k in range(iterations):
        f, g = cost(x)
        yield Step(k, x, f)
        size = step
        if search == "golden":
            a, b = 0.0, step
            c, d = b - ratio * (b - a), a + ratio * (b - a)
            fc, fd = cost(x - c * g)[0], cost(x - d * g)[0]
            for _ in range(6):
                if fc < fd:
                    b, d, fd = d, c, fc
                    c = b - ratio * (b - a)
                    fc = cost(x - c * g)[0]
                else:
                    a, c, fc = c, d, fd
                    d = a + ratio * (b - a)
                    fd = cost(x - d * g)[0]
            size = (a + b) / 2
        elif search == "robbins-monro":
            size = step / (k + 1)
        x = x - size * g
    yield Step(iterations, x, cost(x)[0])
