"""Scalar conversions, blending, B-splines and image filter kernels as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The scalar kinds, with bits and signedness, and the Spark type that holds them.
INTEGER_KINDS = {
    "byte": (8, True, "tinyint"), "short": (16, True, "smallint"), "int": (32, True, "int"), "long": (64, True, "bigint"),
    "ubyte": (8, False, "smallint"), "ushort": (16, False, "int"), "uint": (32, False, "bigint"),
}
REAL_KINDS = {"float": "float", "double": "double"}


def convert(value: Column, kind: str) -> Column:
    """Value as the scalar kind. Integers wrap around like two's complement; reals are cut towards zero first."""
    if kind in REAL_KINDS:
        return value.cast(REAL_KINDS[kind])
    bits, signed, spark = INTEGER_KINDS[kind]
    whole = value.cast("bigint")
    if bits == 64:
        return whole
    wrapped = F.pmod(whole, F.lit(1 << bits))
    if signed:
        wrapped = F.when(wrapped >= 1 << (bits - 1), wrapped - (1 << bits)).otherwise(wrapped)
    return wrapped.cast(spark)


def blend(a: Column, b: Column, weight_of_a: Column, kind: str = "double") -> Column:
    """a * l + b * (1 - l); integer kinds are rounded half up each time."""
    mixed = a * weight_of_a + b * (F.lit(1.0) - weight_of_a)
    return F.floor(mixed + 0.5).cast(INTEGER_KINDS[kind][2]) if kind in INTEGER_KINDS else mixed


def blend3(v: list[Column], w: list[Column], kind: str = "double") -> Column:
    """Barycentric blend of three values by two nested blends, which for integer kinds round twice."""
    rest = w[1] + w[2]
    inner = F.when(rest > 0, blend(v[1], v[2], w[1] / rest, kind)).otherwise(v[1])
    return blend(v[0], inner, w[0], kind)


def bspline(x: Column, order: int) -> Column:
    """Centred B-spline of order 0 to 3; order 0 is one half at its edges."""
    a = F.abs(x)
    if order == 0:
        return F.when(a < 0.5, 1.0).when(a == 0.5, 0.5).otherwise(0.0)
    if order == 1:
        return F.when(a < 1, 1 - a).otherwise(0.0)
    if order == 2:
        return F.when(a < 0.5, 0.75 - a * a).when(a < 1.5, 0.5 * (1.5 - a) * (1.5 - a)).otherwise(0.0)
    if order == 3:
        return F.when(a < 1, 2.0 / 3 - a * a + 0.5 * a * a * a).when(a < 2, (2 - a) * (2 - a) * (2 - a) / 6.0).otherwise(0.0)
    raise ValueError(f"B-splines of order {order} are not available")


def bspline_derivative(x: Column, order: int) -> Column:
    return bspline(x + 0.5, order - 1) - bspline(x - 0.5, order - 1)


def gaussian_filter(parts: list[Column], sigma: float) -> Column:
    """Normalised Gaussian, 0 beyond 3 sigma on any axis."""
    total = F.lit(0.0)
    inside = F.lit(True)
    for p in parts:
        total = total + p * p
        inside = inside & (F.abs(p) <= 3 * sigma)
    height = (2 * 3.141592653589793 * sigma * sigma) ** (-len(parts) / 2)
    return F.when(inside, F.exp(-total / (2 * sigma * sigma)) * height).otherwise(0.0)


def box_filter(parts: list[Column], width: float) -> Column:
    inside = F.lit(True)
    for p in parts:
        inside = inside & (F.abs(p) < width / 2)
    return F.when(inside, (1.0 / width) ** len(parts)).otherwise(0.0)
