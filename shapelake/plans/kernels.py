"""Positive-definite kernels, as Column expressions and as NumPy blocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from shapelake.functions.vector import Vec


@dataclass(frozen=True)
class Kernel:
    """k(x, y): `column` on coordinate columns, `block` on arrays (n, d) and (m, d) giving (n, m)."""

    column: Callable[[Vec, Vec], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def __add__(self, o: Kernel) -> Kernel:
        return Kernel(lambda x, y: self.column(x, y) + o.column(x, y), lambda x, y: self.block(x, y) + o.block(x, y))

    def __mul__(self, o: Kernel | float) -> Kernel:
        if isinstance(o, Kernel):
            return Kernel(lambda x, y: self.column(x, y) * o.column(x, y), lambda x, y: self.block(x, y) * o.block(x, y))
        return Kernel(lambda x, y: self.column(x, y) * float(o), lambda x, y: self.block(x, y) * float(o))

    __rmul__ = __mul__

    def compose(self, column: Callable[[Vec], Vec], block: Callable[[np.ndarray], np.ndarray]) -> Kernel:
        return Kernel(lambda x, y: self.column(column(x), column(y)), lambda x, y: self.block(block(x), block(y)))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)


def gaussian(sigma: float, scale: float = 1.0) -> Kernel:
    """scale^2 exp(-|x - y|^2 / sigma^2): the exponent has no factor of two."""
    return Kernel(lambda x, y: F.exp(-(x - y).norm2() / (sigma * sigma)) * (scale * scale), lambda x, y: scale * scale * np.exp(-squared(x, y) / sigma**2))


def multiscale(k: Kernel, low: int, high: int) -> Kernel:
    """Sum over low <= i < high of 2^(-2i) k(2^i x, 2^i y)."""
    total = None
    for i in range(low, high):
        part = k.compose(lambda v, s=2.0**i: v * s, lambda a, s=2.0**i: a * s) * 2.0 ** (-2 * i)
        total = part if total is None else total + part
    if total is None:
        raise ValueError("no scale between the bounds")
    return total


def bspline_value(x: np.ndarray, order: int) -> np.ndarray:
    a = np.abs(x)
    if order == 0:
        return np.where(a < 0.5, 1.0, np.where(a == 0.5, 0.5, 0.0))
    if order == 1:
        return np.maximum(1 - a, 0)
    if order == 2:
        return np.where(a < 0.5, 0.75 - a * a, np.where(a < 1.5, 0.5 * (1.5 - a) ** 2, 0.0))
    if order == 3:
        return np.where(a < 1, 2 / 3 - a * a + a**3 / 2, np.where(a < 2, (2 - a) ** 3 / 6, 0.0))
    raise ValueError(f"B-splines of order {order} are not available")


def bspline_kernel(order: int, scale: int) -> Kernel:
    """Product over axes of sum_k b(2^j x - k) b(2^j y - k)."""
    c = 2.0**scale

    def block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), len(y)))
        for axis in range(x.shape[1]):
            u, v = x[:, axis] * c, y[:, axis] * c
            reach = (order + 1) / 2
            k = np.arange(np.floor(min(u.min(), v.min()) - reach), np.ceil(max(u.max(), v.max()) + reach) + 1)
            out *= bspline_value(u[:, None] - k, order) @ bspline_value(v[:, None] - k, order).T
        return out

    def column(x: Vec, y: Vec) -> Column:
        raise NotImplementedError("evaluate B-spline kernels in blocks")

    return Kernel(column, block)


@dataclass(frozen=True)
class MatrixKernel:
    """k(x, y) in R^{d x d}; blocks are (n d, m d), point-major."""

    dim: int
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def _same(self, o: MatrixKernel) -> None:
        if self.dim != o.dim:
            raise ValueError("output dimensions differ")

    def __add__(self, o: MatrixKernel) -> MatrixKernel:
        self._same(o)
        return MatrixKernel(self.dim, lambda x, y: self.block(x, y) + o.block(x, y))

    def __mul__(self, o: MatrixKernel | float) -> MatrixKernel:
        if isinstance(o, MatrixKernel):
            self._same(o)
            return MatrixKernel(self.dim, lambda x, y: self.block(x, y) * o.block(x, y))
        return MatrixKernel(self.dim, lambda x, y: self.block(x, y) * float(o))

    def compose(self, f: Callable[[np.ndarray], np.ndarray]) -> MatrixKernel:
        return MatrixKernel(self.dim, lambda x, y: self.block(f(x), f(y)))


def diagonal(kernels: Kernel | Sequence[Kernel], dim: int | None = None) -> MatrixKernel:
    """One scalar kernel on every axis, or one for each."""
    if isinstance(kernels, Kernel):
        return MatrixKernel(dim, lambda x, y: np.kron(kernels.block(x, y), np.eye(dim)))
    ks = list(kernels)

    def block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(ks), len(y), len(ks)))
        for i, k in enumerate(ks):
            out[:, i, :, i] = k.block(x, y)
        return out.reshape(len(x) * len(ks), len(y) * len(ks))

    return MatrixKernel(len(ks), block)


def sample_covariance(points: np.ndarray, displacements: np.ndarray) -> MatrixKernel:
    """Unbiased covariance of sample displacements (item, point, d), looked up at the nearest of the points."""
    n, d = len(displacements), displacements.shape[2]
    centred = displacements - displacements.mean(axis=0)

    def block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = (centred[:, squared(v, points).argmin(axis=1)].reshape(n, -1) for v in (x, y))
        return a.T @ b / (n - 1)

    return MatrixKernel(d, block)
