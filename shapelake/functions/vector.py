"""Vectors and small matrices whose components are Columns, so that all arithmetic stays inside code generation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def as_column(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class Vec:
    """A point or vector of one or more components."""

    parts: tuple[Column, ...]

    @staticmethod
    def of(*parts: Number | str) -> Vec:
        return Vec(tuple(F.col(p) if isinstance(p, str) else as_column(p) for p in parts))

    @staticmethod
    def from_array(array: Column, dim: int) -> Vec:
        return Vec(tuple(F.get(array, F.lit(k)) for k in range(dim)))

    @staticmethod
    def from_struct(struct: Column, names: Sequence[str] = ("x", "y", "z")) -> Vec:
        return Vec(tuple(struct[n] for n in names))

    @staticmethod
    def zeros(dim: int) -> Vec:
        return Vec.of(*[0.0] * dim)

    @staticmethod
    def polar(r: Number, phi: Number) -> Vec:
        r, phi = as_column(r), as_column(phi)
        return Vec((r * F.cos(phi), r * F.sin(phi)))

    @staticmethod
    def spherical(r: Number, theta: Number, phi: Number) -> Vec:
        """theta is the angle from the z axis, phi the one in the x-y plane."""
        r, theta, phi = as_column(r), as_column(theta), as_column(phi)
        return Vec((r * F.sin(theta) * F.cos(phi), r * F.sin(theta) * F.sin(phi), r * F.cos(theta)))

    @property
    def dim(self) -> int:
        return len(self.parts)

    def __getitem__(self, k: int) -> Column:
        return self.parts[k]

    def zip(self, other: Vec, f: Callable[[Column, Column], Column]) -> Vec:
        if self.dim != other.dim:
            raise ValueError(f"dimensions {self.dim} and {other.dim}")
        return Vec(tuple(f(a, b) for a, b in zip(self.parts, other.parts)))

    def map(self, f: Callable[[Column], Column]) -> Vec:
        return Vec(tuple(f(a) for a in self.parts))

    def map_with_index(self, f: Callable[[Column, int], Column]) -> Vec:
        return Vec(tuple(f(a, k) for k, a in enumerate(self.parts)))

    def __add__(self, other: Vec) -> Vec:
        return self.zip(other, lambda a, b: a + b)

    def __sub__(self, other: Vec) -> Vec:
        return self.zip(other, lambda a, b: a - b)

    def __neg__(self) -> Vec:
        return self.map(lambda a: -a)

    def __mul__(self, s: Number) -> Vec:
        return self.map(lambda a: a * as_column(s))

    __rmul__ = __mul__

    def __truediv__(self, s: Number) -> Vec:
        return self.map(lambda a: a / as_column(s))

    def elementwise(self, other: Vec) -> Vec:
        return self.zip(other, lambda a, b: a * b)

    def dot(self, other: Vec) -> Column:
        total = self[0] * other[0]
        for a, b in zip(self.parts[1:], other.parts[1:]):
            total = total + a * b
        return total

    def norm2(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.norm2())

    def normalized(self) -> Vec:
        """Unit vector; NULL components for a zero vector."""
        n = self.norm()
        return self.map(lambda a: F.when(n > 0, a / n))

    def cross(self, o: Vec) -> Vec:
        a, b = self.parts, o.parts
        return Vec((a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]))

    def outer(self, other: Vec) -> Mat:
        return Mat(tuple(tuple(a * b for b in other.parts) for a in self.parts))

    def columns(self, *names: str) -> list[Column]:
        return [p.alias(n) for p, n in zip(self.parts, names, strict=True)]

    def array(self) -> Column:
        return F.array(*self.parts)

    def struct(self, names: Sequence[str] = ("x", "y", "z")) -> Column:
        return F.struct(*self.columns(*names[: self.dim]))


@dataclass(frozen=True)
class Mat:
    """A square matrix by rows. Stored arrays are column-major (`from_array`, `array`)."""

    rows: tuple[tuple[Column, ...], ...]

    @staticmethod
    def of(rows: Sequence[Sequence[Number]]) -> Mat:
        return Mat(tuple(tuple(as_column(x) for x in r) for r in rows))

    @staticmethod
    def fill(dim: int, value: Number) -> Mat:
        return Mat.of([[value] * dim] * dim)

    @staticmethod
    def eye(dim: int) -> Mat:
        return Mat.of([[float(i == j) for j in range(dim)] for i in range(dim)])

    @staticmethod
    def diag(v: Vec) -> Mat:
        return Mat(tuple(tuple(v[i] if i == j else F.lit(0.0) for j in range(v.dim)) for i in range(v.dim)))

    @staticmethod
    def from_array(array: Column, dim: int) -> Mat:
        return Mat(tuple(tuple(F.get(array, F.lit(j * dim + i)) for j in range(dim)) for i in range(dim)))

    @property
    def dim(self) -> int:
        return len(self.rows)

    def zip(self, o: Mat, f: Callable[[Column, Column], Column]) -> Mat:
        return Mat(tuple(tuple(f(a, b) for a, b in zip(r, s)) for r, s in zip(self.rows, o.rows)))

    def __add__(self, o: Mat) -> Mat:
        return self.zip(o, lambda a, b: a + b)

    def __sub__(self, o: Mat) -> Mat:
        return self.zip(o, lambda a, b: a - b)

    def elementwise(self, o: Mat) -> Mat:
        return self.zip(o, lambda a, b: a * b)

    def scale(self, s: Number) -> Mat:
        return Mat(tuple(tuple(a * as_column(s) for a in r) for r in self.rows))

    @property
    def t(self) -> Mat:
        return Mat(tuple(zip(*self.rows)))

    def apply(self, v: Vec) -> Vec:
        return Vec(tuple(Vec(r).dot(v) for r in self.rows))

    def __matmul__(self, o: Mat) -> Mat:
        return Mat(tuple(tuple(Vec(r).dot(Vec(c)) for c in o.t.rows) for r in self.rows))

    def det(self) -> Column:
        m = self.rows
        if self.dim == 1:
            return m[0][0]
        total = None
        for j in range(self.dim):
            minor = Mat(tuple(tuple(x for k, x in enumerate(r) if k != j) for r in m[1:])).det() * m[0][j]
            total = minor if total is None else total + minor if j % 2 == 0 else total - minor
        return total

    def inv(self) -> Mat:
        """Inverse by cofactors; NULL entries where singular."""
        n, m, d = self.dim, self.rows, self.det()
        cof = [[None] * n for _ in range(n)]
        for i in range(n):
            for j in range(n):
                rest = tuple(tuple(x for k, x in enumerate(r) if k != j) for h, r in enumerate(m) if h != i)
                minor = Mat(rest).det() if rest else F.lit(1.0)
                cof[j][i] = F.when(d != 0, minor * (1.0 if (i + j) % 2 == 0 else -1.0) / d)
        return Mat(tuple(map(tuple, cof)))

    def array(self) -> Column:
        return F.array(*[self.rows[i][j] for j in range(self.dim) for i in range(self.dim)])


def squared_distance(a: Column, b: Column) -> Column:
    """Of two arrays of doubles of the same length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
