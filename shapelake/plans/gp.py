"""Gaussian processes: small training sets are solved on the driver, predictions run over tables of any size."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.plans.kernels import MatrixKernel
from shapelake.plans.linalg import eig_of_factor, fix_signs, pivoted_cholesky


@dataclass(frozen=True)
class Mvn:
    """Multivariate normal distribution."""

    mean: np.ndarray
    cov: np.ndarray

    @staticmethod
    def from_axes(mean: np.ndarray, axes: Sequence[tuple[np.ndarray, float]]) -> Mvn:
        u = np.stack([a / np.linalg.norm(a) for a, _ in axes], axis=1)
        return Mvn(np.asarray(mean, float), u @ np.diag([v for _, v in axes]) @ u.T)

    @staticmethod
    def from_moments(row, names: Sequence[str]) -> Mvn:
        """Of a row of operators.stats.moments."""
        cov = np.array([[row[f"cov_{min((a, b), key=names.index)}_{max((a, b), key=names.index)}"] for b in names] for a in names])
        return Mvn(np.array([row[f"mean_{a}"] for a in names]), cov)

    @property
    def dim(self) -> int:
        return len(self.mean)

    def root(self) -> np.ndarray:
        """Cholesky factor; jitter from 1e-10 doubles until it works."""
        jitter = 0.0
        while True:
            try:
                return np.linalg.cholesky(self.cov + jitter * np.eye(self.dim))
            except np.linalg.LinAlgError:
                jitter = max(2 * jitter, 1e-10)

    def mahalanobis(self, x: np.ndarray) -> float:
        d = np.asarray(x) - self.mean
        return float(np.sqrt(max(d @ np.linalg.pinv(self.cov) @ d, 0)))

    def pdf(self, x: np.ndarray) -> float:
        """Adds 1e-10 to the determinant; logpdf does not."""
        return math.exp(-0.5 * self.mahalanobis(x) ** 2) / math.sqrt((2 * math.pi) ** self.dim * (np.linalg.det(self.cov) + 1e-10))

    def logpdf(self, x: np.ndarray) -> float:
        return -0.5 * (self.dim * math.log(2 * math.pi) + np.linalg.slogdet(self.cov)[1] + self.mahalanobis(x) ** 2)

    def sample(self, n: int, seed: int = 0) -> np.ndarray:
        return self.mean + np.random.default_rng(seed).standard_normal((n, self.dim)) @ self.root().T

    def principal_components(self) -> list[tuple[np.ndarray, float]]:
        values, u = np.linalg.eigh(self.cov)
        u = fix_signs(u)
        return [(u[:, k], float(values[k])) for k in np.argsort(values)[::-1]]

    def marginal(self, at: Sequence[int]) -> Mvn:
        return Mvn(self.mean[list(at)], self.cov[np.ix_(at, at)])

    def conditional(self, observed: dict[int, float]) -> Mvn:
        o = sorted(observed)
        r = [k for k in range(self.dim) if k not in observed]
        gain = self.cov[np.ix_(r, o)] @ np.linalg.inv(self.cov[np.ix_(o, o)])
        return Mvn(self.mean[r] + gain @ (np.array([observed[k] for k in o]) - self.mean[o]), self.cov[np.ix_(r, r)] - gain @ self.cov[np.ix_(o, r)])


#: The older name of the same distribution.
NDimensionalNormal = Mvn

Mean = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class GaussianProcess:
    """mean: (n, d) points -> (n, k) values; kernel with k x k blocks."""

    mean: Mean
    kernel: MatrixKernel

    @staticmethod
    def zero_mean(kernel: MatrixKernel) -> GaussianProcess:
        return GaussianProcess(lambda x: np.zeros((len(x), kernel.dim)), kernel)

    def marginal(self, points: np.ndarray) -> Mvn:
        return Mvn(self.mean(points).ravel(), self.kernel.block(points, points))

    def sample_at(self, points: np.ndarray, seed: int = 0) -> np.ndarray:
        return self.marginal(points).sample(1, seed).reshape(len(points), -1)

    def posterior(self, points: np.ndarray, values: np.ndarray, noise: float | np.ndarray) -> GaussianProcess:
        """Regression on values (n, k) with noise variance or covariance (n k x n k); NaN values are left out."""
        k = self.kernel.dim
        y = (values - self.mean(points)).ravel()
        cov = noise * np.eye(len(y)) if np.isscalar(noise) else np.asarray(noise)
        use = ~np.isnan(y)
        inverse = np.linalg.inv((self.kernel.block(points, points) + cov)[np.ix_(use, use)])
        alpha = inverse @ y[use]
        cross = lambda x: self.kernel.block(x, points)[:, use]
        mean = lambda x: self.mean(x) + (cross(x) @ alpha).reshape(-1, k)
        return GaussianProcess(mean, MatrixKernel(k, lambda x, z: self.kernel.block(x, z) - cross(x) @ inverse @ cross(z).T))

    def marginal_likelihood(self, points: np.ndarray, values: np.ndarray, noise: float) -> float:
        y = (values - self.mean(points)).ravel()
        cov = self.kernel.block(points, points) + noise * np.eye(len(y))
        return float(-0.5 * y @ np.linalg.solve(cov, y) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * len(y) * math.log(2 * math.pi))

    def predict(self, table: DataFrame, names: Sequence[str], key: str, out: Sequence[str]) -> DataFrame:
        """key and the mean at each row's point, in Arrow batches."""
        mean = self.mean
        names, out = list(names), list(out)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                result = pd.DataFrame(mean(pdf[names].to_numpy(float)), columns=out)
                result.insert(0, key, pdf[key].to_numpy())
                yield result

        return table.select(key, *names).mapInPandas(run, f"{key} long, " + ", ".join(f"{o} double" for o in out))


@dataclass(frozen=True)
class LowRank:
    """mean + sum_i sqrt(variance_i) a_i basis_i, as functions of points: basis gives (n k, rank)."""

    mean: Mean
    variance: np.ndarray
    basis: Mean
    dim: int

    @property
    def rank(self) -> int:
        return len(self.variance)

    def q(self, points: np.ndarray) -> np.ndarray:
        return self.basis(points) * np.sqrt(self.variance)

    def instance(self, a: np.ndarray, points: np.ndarray) -> np.ndarray:
        return self.mean(points) + (self.q(points)[:, : len(a)] @ a).reshape(len(points), -1)

    def sample(self, points: np.ndarray, seed: int = 0) -> np.ndarray:
        return self.instance(np.random.default_rng(seed).standard_normal(self.rank), points)

    def truncate(self, rank: int) -> LowRank:
        return LowRank(self.mean, self.variance[:rank], lambda x: self.basis(x)[:, :rank], self.dim)

    def covariance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.q(x) @ self.q(y).T

    def coefficients(self, points: np.ndarray, values: np.ndarray, noise: float = 1e-5) -> np.ndarray:
        """Regression with a small noise, so approximate; NaN values are missing."""
        return regression(self.q(points), (values - self.mean(points)).ravel(), noise)[0]

    def project(self, points: np.ndarray, values: np.ndarray) -> np.ndarray:
        return self.instance(self.coefficients(points, values), points)

    def pdf(self, a: np.ndarray) -> float:
        return math.exp(self.logpdf(a))

    def logpdf(self, a: np.ndarray) -> float:
        return float(-0.5 * (a @ a + len(a) * math.log(2 * math.pi)))

    def posterior(self, points: np.ndarray, values: np.ndarray, noise: float) -> LowRank:
        q = self.q(points)
        a, cov = regression(q, (values - self.mean(points)).ravel(), noise)
        d = np.sqrt(self.variance)
        values_, u = np.linalg.eigh(d[:, None] * cov * d[None, :])
        order = np.argsort(values_)[::-1]
        u, new = u[:, order], np.maximum(values_[order], 0)
        mean = lambda x: self.instance(a, x)
        return LowRank(mean, new, lambda x: self.basis(x) @ u, self.dim)

    def marginal_likelihood(self, points: np.ndarray, values: np.ndarray, noise: float) -> float:
        """By the Woodbury identity: only rank x rank systems."""
        q, y = self.q(points), (values - self.mean(points)).ravel()
        m = np.eye(self.rank) + q.T @ q / noise
        fit = y @ y / noise - (q.T @ y) @ np.linalg.solve(m, q.T @ y) / noise**2
        return float(-0.5 * fit - 0.5 * (np.linalg.slogdet(m)[1] + len(y) * math.log(noise)) - 0.5 * len(y) * math.log(2 * math.pi))


def regression(q: np.ndarray, y: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the coefficients given y = q a + noise; NaN in y is missing."""
    use = ~np.isnan(y)
    q, y = q[use], y[use]
    cov = np.linalg.inv(q.T @ q / noise + np.eye(q.shape[1]))
    return cov @ (q.T @ y) / noise, cov


def distributed_regression(rows: DataFrame, basis: str, residual: str, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """As `regression`, for a table with a column of basis rows (array of length r) and one of residuals.

    Batches add their r x r and r sums; the driver gets one row of r (r + 1) numbers for each task's total after a
    partial aggregation by position.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            pdf = pdf[pdf[residual].notna()]
            if len(pdf):
                q = np.stack(pdf[basis].to_numpy())
                part = np.concatenate([q.T @ q, (q.T @ pdf[residual].to_numpy())[:, None]], axis=1)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"k": np.arange(total.size), "v": total.ravel()})

    sums = rows.select(basis, residual).mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")
    r = int((math.isqrt(1 + 4 * len(sums)) - 1) // 2)
    m = sums.v.to_numpy().reshape(r, r + 1)
    cov = np.linalg.inv(m[:, :r] / noise + np.eye(r))
    return cov @ m[:, r] / noise, cov


def table_regression(process: LowRank, table: DataFrame, coordinates: Sequence[str], value: str, noise: float, key: str) -> DataFrame:
    """(key, mean): the process conditioned on the values of all rows of a table, at the same rows; scalar processes.

    Rows with a NULL or NaN value teach nothing but get a mean, those without coordinates get none. Rows turn into rows of the basis batch by
    batch; the driver holds systems of the rank alone.
    """
    if process.dim != 1:
        raise ValueError("a process of scalar values is needed")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[list(coordinates)].to_numpy(float)
            yield pd.DataFrame({"q": list(process.q(x)) if len(x) else [], "y": pdf[value].to_numpy(float) - process.mean(x).ravel() if len(x) else []})

    known = table.select(*[F.col(c).cast("double").alias(c) for c in coordinates], F.col(value).cast("double").alias(value)).dropna()
    a, _ = distributed_regression(known.mapInPandas(rows, "q array<double>, y double"), "q", "y", noise)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[list(coordinates)].to_numpy(float)
            yield pd.DataFrame({key: pdf[key], "mean": process.instance(a, x).ravel() if len(x) else np.zeros(0)})

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, *[F.col(c).cast("double").alias(c) for c in coordinates]).dropna().mapInPandas(predict, f"{key} {kind}, mean double")


def nystrom(kernel: MatrixKernel, samples: np.ndarray, rank: int, mean: Mean | None = None, tolerance: float = 1e-5, least: float = 1e-8) -> LowRank:
    """Low-rank process from the eigenfunctions on sample points: variances are eigenvalues over the number of samples."""
    k, n = kernel.block(samples, samples), len(samples)
    factor, _ = pivoted_cholesky(np.diag(k), lambda i: k[:, i], tolerance)
    u, values = eig_of_factor(factor)
    variance = values / n
    keep = np.flatnonzero(variance >= least)[:rank]
    w = u[:, keep] * math.sqrt(n) / values[keep]
    return LowRank(mean or (lambda x: np.zeros((len(x), kernel.dim))), variance[keep], lambda x: kernel.block(x, samples) @ w, kernel.dim)


def cholesky_process(kernel: MatrixKernel, domain: np.ndarray, tolerance: float = 1e-2, most: int | None = None, mean: Mean | None = None) -> LowRank:
    """Low-rank process from a pivoted Cholesky factor over the points of a domain; extended to others by the kernel."""
    k = kernel.block(domain, domain)
    factor, pivots = pivoted_cholesky(np.diag(k), lambda i: k[:, i], tolerance, most=most)
    u, values = eig_of_factor(factor)
    back = np.linalg.pinv(factor.T @ factor) @ factor.T @ u
    at = np.array(pivots)
    inner = np.linalg.solve(factor[at], np.eye(len(at)))

    def basis(x: np.ndarray) -> np.ndarray:
        return kernel.block(x, domain)[:, at] @ inner.T @ back

    return LowRank(mean or (lambda x: np.zeros((len(x), kernel.dim))), values, basis, kernel.dim)
