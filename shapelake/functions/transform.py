"""Parametric transformations of points: column expressions, with inverses, parameters and NumPy Jacobians."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.functions.vector import Mat, Vec


def rotation_matrix(angles: Sequence[float]) -> np.ndarray:
    """2-D from one angle; 3-D from three Euler angles, turned about x, then y, then z."""
    if len(angles) == 1:
        c, s = math.cos(angles[0]), math.sin(angles[0])
        return np.array([[c, -s], [s, c]])
    (cz, sz), (cy, sy), (cx, sx) = ((math.cos(a), math.sin(a)) for a in angles)
    rz = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    ry = np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]])
    rx = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    return rz @ ry @ rx


def euler_angles(m: np.ndarray) -> tuple[float, ...]:
    """The angles that give the rotation matrix; at the poles the first is 0."""
    m = np.asarray(m)
    if m.shape == (2, 2):
        return (math.atan2(m[1, 0], m[0, 0]),)
    if abs(abs(m[2, 0]) - 1) > 1e-12:
        y = -math.asin(max(-1.0, min(1.0, m[2, 0])))
        return (math.atan2(m[1, 0], m[0, 0]), y, math.atan2(m[2, 1], m[2, 2]))
    if m[2, 0] < 0:
        return (0.0, math.pi / 2, math.atan2(m[0, 1], m[0, 2]))
    return (0.0, -math.pi / 2, math.atan2(-m[0, 1], -m[0, 2]))


@dataclass(frozen=True)
class Transformation:
    """x -> linear @ x + shift. `parameters` and `rebuild` tie it to its space."""

    linear: np.ndarray
    shift: np.ndarray
    parameters: tuple[float, ...] = ()
    rebuild: Callable[[Sequence[float]], "Transformation"] | None = field(default=None, compare=False)

    @property
    def dim(self) -> int:
        return len(self.shift)

    def __call__(self, p: Vec) -> Vec:
        return Mat.of(self.linear.tolist()).apply(p) + Vec.of(*self.shift.tolist())

    def on(self, points: DataFrame, names: Sequence[str]) -> DataFrame:
        """The points with their coordinate columns moved."""
        moved = self(Vec.of(*names))
        return points.withColumns(dict(zip(names, moved.parts)))

    def numpy(self, points: np.ndarray) -> np.ndarray:
        return points @ self.linear.T + self.shift

    def and_then(self, outer: Transformation) -> Transformation:
        return outer.compose(self)

    def compose(self, inner: Transformation) -> Transformation:
        """x -> self(inner(x)), with the parameters of both."""
        n = len(self.parameters)
        rebuild = (lambda p: self.rebuild(p[:n]).compose(inner.rebuild(p[n:]))) if self.rebuild and inner.rebuild else None
        return Transformation(self.linear @ inner.linear, self.linear @ inner.shift + self.shift, self.parameters + inner.parameters, rebuild)

    def inverse(self) -> Transformation:
        inv = np.linalg.inv(self.linear)
        return Transformation(inv, -inv @ self.shift)

    def position_jacobian(self, point: np.ndarray) -> np.ndarray:
        return self.linear

    def parameter_jacobian(self, point: np.ndarray, h: float = 1e-6) -> np.ndarray:
        """d x n matrix of central differences in the parameters."""
        columns = []
        for k in range(len(self.parameters)):
            step = np.zeros(len(self.parameters))
            step[k] = h
            up, down = (self.rebuild(np.add(self.parameters, s)).numpy(point) for s in (step, -step))
            columns.append((up - down) / (2 * h))
        return np.stack(columns, axis=-1)


def translation(*t: float) -> Transformation:
    return Transformation(np.eye(len(t)), np.array(t, float), tuple(map(float, t)), lambda p: translation(*p))


def rotation(angles: Sequence[float], center: Sequence[float]) -> Transformation:
    m, c = rotation_matrix(angles), np.array(center, float)
    return Transformation(m, c - m @ c, tuple(map(float, angles)), lambda p: rotation(p, center))


def scaling(s: float, dim: int) -> Transformation:
    return Transformation(np.eye(dim) * s, np.zeros(dim), (float(s),), lambda p: scaling(p[0], dim))


def translation_after_rotation(t: Sequence[float], angles: Sequence[float], center: Sequence[float]) -> Transformation:
    return translation(*t).compose(rotation(angles, center))


def rotation_after_translation(angles: Sequence[float], center: Sequence[float], t: Sequence[float]) -> Transformation:
    return rotation(angles, center).compose(translation(*t))


def scaling_after_rotation(s: float, angles: Sequence[float], center: Sequence[float]) -> Transformation:
    return scaling(s, len(center)).compose(rotation(angles, center))


def rotation_after_scaling(angles: Sequence[float], center: Sequence[float], s: float) -> Transformation:
    return rotation(angles, center).compose(scaling(s, len(center)))


def similarity(t: Sequence[float], s: float, angles: Sequence[float], center: Sequence[float]) -> Transformation:
    """Translation after scaling after rotation."""
    return translation(*t).compose(scaling_after_rotation(s, angles, center))


def inverse_similarity(angles: Sequence[float], center: Sequence[float], s: float, t: Sequence[float]) -> Transformation:
    """Rotation after scaling after translation."""
    return rotation(angles, center).compose(scaling(s, len(center)).compose(translation(*t)))


@dataclass(frozen=True)
class Space:
    """A family of transformations with a number of parameters and an identity."""

    size: int
    build: Callable[[Sequence[float]], Transformation]
    identity: tuple[float, ...]

    def __call__(self, parameters: Sequence[float]) -> Transformation:
        if len(parameters) != self.size:
            raise ValueError(f"{self.size} parameters are needed, not {len(parameters)}")
        return self.build(parameters)

    def product(self, inner: Space) -> Space:
        return Space(self.size + inner.size, lambda p: self(p[: self.size]).compose(inner(p[self.size :])), self.identity + inner.identity)


def translation_space(dim: int) -> Space:
    return Space(dim, lambda p: translation(*p), (0.0,) * dim)


def rotation_space(center: Sequence[float]) -> Space:
    n = 1 if len(center) == 2 else 3
    return Space(n, lambda p: rotation(p, center), (0.0,) * n)


def scaling_space(dim: int) -> Space:
    return Space(1, lambda p: scaling(p[0], dim), (1.0,))


def rigid_space(center: Sequence[float]) -> Space:
    return translation_space(len(center)).product(rotation_space(center))


def similarity_space(center: Sequence[float]) -> Space:
    return translation_space(len(center)).product(scaling_space(len(center)).product(rotation_space(center)))


def warp(points: DataFrame, displacements: DataFrame, names: Sequence[str], key: str = "point_id") -> DataFrame:
    """Points plus the displacement of the same key (displacement columns are named like the coordinates)."""
    moved = displacements.select(key, *[F.col(n).alias(f"__{n}") for n in names])
    return points.join(moved, key).withColumns({n: F.col(n) + F.col(f"__{n}") for n in names}).drop(*[f"__{n}" for n in names])
