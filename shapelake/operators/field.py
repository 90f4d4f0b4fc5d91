"""Domains as predicates and fields as partial functions of a point, both column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelake.functions.vector import Number, Vec, as_column


@dataclass(frozen=True)
class Domain:
    """Where something is defined."""

    contains: Callable[[Vec], Column]

    def intersection(self, other: Domain) -> Domain:
        return Domain(lambda p: self.contains(p) & other.contains(p))

    def union(self, other: Domain) -> Domain:
        return Domain(lambda p: self.contains(p) | other.contains(p))

    def warp(self, inverse: Callable[[Vec], Vec]) -> Domain:
        return Domain(lambda p: self.contains(inverse(p)))

    def filter(self, points: DataFrame, names: Sequence[str]) -> DataFrame:
        return points.filter(self.contains(Vec.of(*names)))


EVERYWHERE = Domain(lambda p: F.lit(True))


@dataclass(frozen=True)
class Box(Domain):
    """A closed axis-aligned box; written as comparisons with literals, so it reaches the Parquet reader."""

    origin: tuple[float, ...] = ()
    opposite: tuple[float, ...] = ()

    @staticmethod
    def of(origin: Sequence[float], opposite: Sequence[float]) -> Box:
        def contains(p: Vec) -> Column:
            inside = F.lit(True)
            for x, a, b in zip(p.parts, origin, opposite, strict=True):
                inside = inside & x.between(float(a), float(b))
            return inside

        return Box(contains, tuple(map(float, origin)), tuple(map(float, opposite)))

    @property
    def extent(self) -> tuple[float, ...]:
        return tuple(b - a for a, b in zip(self.origin, self.opposite))

    @property
    def volume(self) -> float:
        v = 1.0
        for e in self.extent:
            v *= e
        return v


def half_space(origin: Sequence[float], normal: Sequence[float]) -> Domain:
    """(p - o) . n >= 0."""
    return Domain(lambda p: (p - Vec.of(*origin)).dot(Vec.of(*normal)) >= 0)


@dataclass(frozen=True)
class Field:
    """A function with a domain; outside it the value is NULL."""

    function: Callable[[Vec], Column]
    domain: Domain = EVERYWHERE

    def __call__(self, p: Vec) -> Column:
        return F.when(self.domain.contains(p), self.function(p))

    lift_values = __call__

    def strict(self, p: Vec) -> Column:
        """Raises where undefined, when the rows are computed."""
        return F.when(self.domain.contains(p), self.function(p)).otherwise(F.raise_error(F.lit("point outside of the field's domain")))

    def and_then(self, f: Callable[[Column], Column]) -> Field:
        return Field(lambda p: f(self.function(p)), self.domain)

    def compose(self, t: Callable[[Vec], Vec]) -> Field:
        """x -> self(t(x)), defined where t(x) is in the domain."""
        return Field(lambda p: self.function(t(p)), Domain(lambda p: self.domain.contains(t(p))))

    def _with(self, other: Field, op: Callable[[Column, Column], Column]) -> Field:
        return Field(lambda p: op(self.function(p), other.function(p)), self.domain.intersection(other.domain))

    def __add__(self, other: Field) -> Field:
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other: Field) -> Field:
        return self._with(other, lambda a, b: a - b)

    def times(self, other: Field) -> Field:
        return self._with(other, lambda a, b: a * b)

    def __mul__(self, s: Number) -> Field:
        return self.and_then(lambda v: v * as_column(s))

    def discretize(self, points: DataFrame, names: Sequence[str], outside: Number | None = None, out: str = "value") -> DataFrame:
        value = self(Vec.of(*names))
        return points.withColumn(out, value if outside is None else F.coalesce(value, as_column(outside)))


@dataclass(frozen=True)
class DifferentiableField(Field):
    gradient: Callable[[Vec], Vec] | None = None

    def differentiate(self, p: Vec) -> Vec:
        inside = self.domain.contains(p)
        return self.gradient(p).map(lambda g: F.when(inside, g))

    def compose_linear(self, t: Callable[[Vec], Vec], jacobian_t: Callable[[Vec], Vec]) -> DifferentiableField:
        """Chain rule for a transformation: jacobian_t applies its transposed Jacobian to the gradient."""
        inner = self.compose(t)
        return DifferentiableField(inner.function, inner.domain, lambda p: jacobian_t(self.gradient(t(p))))


def vectorize(field: DataFrame, parts: Sequence[str], key: str = "point_id") -> DataFrame:
    """(k, value) with k = key * d + component."""
    d = len(parts)
    return field.select(key, F.posexplode(F.array(*parts)).alias("c", "value")).select((F.col(key) * d + F.col("c")).alias("k"), "value")


def unvectorize(flat: DataFrame, parts: Sequence[str], key: str = "point_id") -> DataFrame:
    d = len(parts)
    rows = flat.select(F.floor(F.col("k") / d).alias(key), (F.col("k") % d).alias("c"), "value")
    return rows.groupBy(key).agg(*[F.max(F.when(F.col("c") == i, F.col("value"))).alias(n) for i, n in enumerate(parts)])
