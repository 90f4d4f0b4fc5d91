"""Registration: closed-form landmark fits, and image registration by distributed sums of losses and gradients."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.functions.transform import Space, Transformation, euler_angles, translation
from shapelake.plans.linalg import Step, gradient_descent, lbfgs
from shapelake.plans.pdm import fit_rotation


def match_landmarks(source: DataFrame, target: DataFrame, names: Sequence[str], key: str = "id") -> DataFrame:
    """id, a_x.., b_x..: landmarks with the same id, the first of each by coordinates."""
    first = lambda df, p: df.groupBy(key).agg(F.min(F.struct(*names)).alias("m")).select(key, *[F.col(f"m.{n}").alias(f"{p}_{n}") for n in names])
    return first(target, "b").join(first(source, "a"), key)


def landmark_fit(pairs: DataFrame, names: Sequence[str], similarity: bool = False) -> Transformation:
    """Least-squares rigid or similarity transformation of a_ to b_ coordinates; needs at least as many pairs as dimensions.

    One pass of moments over the pairs, then an SVD of the small covariance matrix; reflections flip the last axis.
    """
    a, b = [f"a_{n}" for n in names], [f"b_{n}" for n in names]
    m = pairs.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in a + b], *[F.covar_pop(x, y).alias(f"{x}{y}") for x in a for y in b], *[F.var_pop(x).alias(f"v_{x}") for x in a]).first()
    if m.n < len(names):
        raise ValueError(f"{m.n} landmark pairs are too few in {len(names)} dimensions")
    cov = np.array([[m[f"{x}{y}"] for y in b] for x in a])
    mean_a, mean_b = np.array([m[f"m_{x}"] for x in a]), np.array([m[f"m_{y}"] for y in b])
    turn, _ = fit_rotation(cov, mean_a, mean_b)
    scale = np.trace(turn @ cov) / sum(m[f"v_{x}"] for x in a) if similarity else 1.0
    linear = scale * turn
    shift = mean_b - linear @ mean_a
    return Transformation(linear, shift, (*shift.tolist(), *([float(scale)] if similarity else []), *euler_angles(turn)))


Image = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class PointwiseMetric:
    """Mean over a table of sample points of a loss of moving(t(x)) - fixed(x); undefined (NaN) samples add 0.

    fixed is a column of the samples; moving gives values and gradients (n,), (n, d) for points (n, d).
    """

    samples: DataFrame
    names: tuple[str, ...]
    fixed: str
    moving: Image
    space: Space
    loss: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]

    def value_and_derivative(self, parameters: np.ndarray) -> tuple[float, np.ndarray]:
        t = self.space(tuple(parameters))
        h, n_par = 1e-6, len(parameters)
        shifted = [(self.space(tuple(parameters + h * e)), self.space(tuple(parameters - h * e))) for e in np.eye(n_par)]
        names, fixed, moving, loss = list(self.names), self.fixed, self.moving, self.loss

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros(1 + n_par), 0
            for pdf in batches:
                x = pdf[names].to_numpy(float)
                value, gradient = moving(t.numpy(x))
                f, df = loss(value - pdf[fixed].to_numpy(float))
                ok = np.isfinite(f)
                total[0] += f[ok].sum()
                for k, (up, down) in enumerate(shifted):
                    move = (up.numpy(x) - down.numpy(x)) / (2 * h)
                    total[1 + k] += (df * (gradient * move).sum(axis=1))[ok].sum()
                n += len(pdf)
            yield pd.DataFrame({"k": np.arange(len(total) + 1), "v": np.append(total, n)})

        sums = self.samples.select(*names, fixed).mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k").v.to_numpy()
        return float(sums[0] / sums[-1]), sums[1:-1] / sums[-1]


def squared_loss(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return r * r, 2 * r


def huber_loss(delta: float = 1.345) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Without an absolute value in the test, as defined: large negative residuals stay quadratic."""
    return lambda r: (np.where(r < delta, r * r / 2, delta * (r - delta / 2)), np.where(r < delta, r, delta))


def l2_regulariser(parameters: np.ndarray) -> tuple[float, np.ndarray]:
    return float(parameters @ parameters), 2 * parameters


def registration(metric: PointwiseMetric, start: Sequence[float], weight: float = 0.0, optimizer: str = "lbfgs", iterations: int = 50, **options) -> Iterator[Step]:
    """States of the registration; each is one job over the samples."""

    def cost(p: np.ndarray) -> tuple[float, np.ndarray]:
        f, g = metric.value_and_derivative(p)
        r, dr = l2_regulariser(p)
        return f + weight * r, g + weight * dr

    run = lbfgs if optimizer == "lbfgs" else gradient_descent
    return run(cost, np.array(start, float), iterations, **options)


def gp_transformation_space(low_rank) -> Space:
    """x -> x + u_a(x) with u_a an instance of a low-rank process; positions as NumPy arrays."""

    class Deformation(Transformation):
        def numpy(self, points: np.ndarray) -> np.ndarray:
            return points + low_rank.instance(np.array(self.parameters), points)

        def parameter_jacobian(self, point: np.ndarray, h: float = 1e-6) -> np.ndarray:
            """Exact: the basis at the point, scaled by the standard deviations."""
            return low_rank.q(np.atleast_2d(point))

    build = lambda p: Deformation(np.eye(low_rank.dim), np.zeros(low_rank.dim), tuple(p), build)
    return Space(low_rank.rank, build, (0.0,) * low_rank.rank)


def centre(points: DataFrame, names: Sequence[str]) -> Transformation:
    """Moves the points' mean to the origin."""
    m = points.agg(*[F.avg(n).alias(n) for n in names]).first()
    return translation(*[-m[n] for n in names])


@dataclass(frozen=True)
class MutualInformation:
    """Negated mutual information of fixed and moving values over sample points, with derivatives by central differences.

    Values are scaled by the number of bins first, as the range of a histogram is max + 1 - min.
    """

    samples: DataFrame
    names: tuple[str, ...]
    fixed: str
    moving: Image
    space: Space
    bins: int = 30

    def values(self, parameters: Sequence[np.ndarray]) -> np.ndarray:
        """Of several sets of parameters, in one job over the samples."""
        from shapelake.operators.stats import joint_histogram, mutual_information

        moves, names, fixed, moving = [self.space(tuple(p)) for p in parameters], list(self.names), self.fixed, self.moving

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                f = pdf[fixed].to_numpy(float)
                for k, t in enumerate(moves):
                    yield pd.DataFrame({"k": np.full(len(f), k), "f": f, "g": moving(t.numpy(pdf[names].to_numpy(float)))[0]})

        rows = self.samples.select(*names, fixed).mapInPandas(run, "k int, f double, g double").filter("NOT isnan(g)")
        scaled = rows.select("k", (F.col("f") * self.bins).alias("fv"), (F.col("g") * self.bins).alias("gv"))
        found = {r.k: r.neg_mi for r in mutual_information(joint_histogram(scaled, "fv", "gv", self.bins, ("k",)), ("k",)).collect()}
        return np.array([found.get(k) or 0.0 for k in range(len(moves))])

    def value(self, parameters: np.ndarray) -> float:
        return float(self.values([parameters])[0])

    def value_and_derivative(self, parameters: np.ndarray, h: float = 1e-3) -> tuple[float, np.ndarray]:
        steps = [s * h * e for e in np.eye(len(parameters)) for s in (1, -1)]
        at, *rest = self.values([np.asarray(parameters, float) + s for s in (np.zeros(len(parameters)), *steps)])
        return float(at), (np.array(rest[::2]) - np.array(rest[1::2])) / (2 * h)
