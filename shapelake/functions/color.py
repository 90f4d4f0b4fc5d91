"""Colours with Column channels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from shapelake.functions.vector import Number, Vec, as_column

#: Weights of red, green and blue in the luminance.
LUMINANCE = (0.3, 0.59, 0.11)


@dataclass(frozen=True)
class RGB(Vec):
    @staticmethod
    def of(*parts: Number | str) -> RGB:
        return RGB(Vec.of(*parts).parts)

    def gray(self) -> Column:
        return (self[0] + self[1] + self[2]) / 3

    def sum(self) -> Column:
        return self[0] + self[1] + self[2]

    def luminance(self) -> Column:
        return self[0] * LUMINANCE[0] + self[1] * LUMINANCE[1] + self[2] * LUMINANCE[2]

    def in_bounds(self) -> Column:
        inside = F.lit(True)
        for p in self.parts:
            inside = inside & p.between(0, 1)
        return inside

    def clamped(self) -> RGB:
        return type(self)(tuple(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) for p in self.parts))

    def blend(self, other: RGB, weight: Number) -> RGB:
        w = as_column(weight)
        return type(self)(tuple(a * w + b * (F.lit(1.0) - w) for a, b in zip(self.parts, other.parts)))

    def multiply(self, other: RGB) -> RGB:
        return type(self)(self.elementwise(other).parts)

    def opaque(self) -> RGBA:
        return RGBA((*self.parts, F.lit(1.0)))


@dataclass(frozen=True)
class RGBA(RGB):
    @staticmethod
    def of(*parts: Number | str) -> RGBA:
        return RGBA(Vec.of(*parts).parts)

    def over(self, below: RGBA) -> RGBA:
        """Alpha compositing; colours are not divided by the resulting alpha."""
        a, b = self[3], below[3]
        rest = (F.lit(1.0) - a) * b
        return RGBA((*(self[k] * a + below[k] * rest for k in range(3)), a + rest))

    def no_alpha(self) -> RGB:
        return RGB(self.parts[:3])

    def if_opaque(self) -> RGB:
        """The colour where alpha is 1, else NULL."""
        return RGB(tuple(F.when(self[3] == 1.0, p) for p in self.parts[:3]))
