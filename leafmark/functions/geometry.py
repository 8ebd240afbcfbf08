"""Rectangles as four columns <prefix>x0, y0, x1, y1, y downward.  All are column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rect:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Rect:
        return cls(*(F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")))

    def intersects(self, other: Rect, tolerance: float = 0.0) -> Column:
        """Strictly: rectangles that only touch don't; the tolerance shrinks."""
        t = F.lit(float(tolerance))
        return (self.x0 < other.x1 - t) & (other.x0 < self.x1 - t) & (self.y0 < other.y1 - t) & (other.y0 < self.y1 - t)

    def contains(self, other: Rect, tolerance: float = 0.0) -> Column:
        """Closed: edges may be shared; the tolerance grows."""
        t = F.lit(float(tolerance))
        return (self.x0 - t <= other.x0) & (self.y0 - t <= other.y0) & (self.x1 + t >= other.x1) & (self.y1 + t >= other.y1)

    def union(self, other: Rect) -> Rect:
        return Rect(F.least(self.x0, other.x0), F.least(self.y0, other.y0), F.greatest(self.x1, other.x1), F.greatest(self.y1, other.y1))

    def gap(self, other: Rect) -> Column:
        """The larger of the distances along x and y; negative or 0: not separated."""
        dx = F.greatest(other.x0 - self.x1, self.x0 - other.x1)
        dy = F.greatest(other.y0 - self.y1, self.y0 - other.y1)
        return F.greatest(dx, dy)

    def area(self) -> Column:
        return (self.x1 - self.x0) * (self.y1 - self.y0)

    def overlap(self, other: Rect) -> Column:
        """The area that both cover."""
        w = F.least(self.x1, other.x1) - F.greatest(self.x0, other.x0)
        h = F.least(self.y1, other.y1) - F.greatest(self.y0, other.y0)
        return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def union_of(prefix: str = "") -> list[Column]:
    """Aggregates: the smallest rectangle around all rows."""
    return [F.min(prefix + "x0").alias("x0"), F.min(prefix + "y0").alias("y0"), F.max(prefix + "x1").alias("x1"), F.max(prefix + "y1").alias("y1")]


def rgb(components: Column) -> Column:
    """Components as RGB: one is gray, four are CMYK (ink and black add up, at most to 1); of any others the first three."""
    black = F.get(components, 3)
    return (
        F.when(F.size(components) == 1, F.array_repeat(F.get(components, 0), 3))
        .when(F.size(components) == 4, F.transform(F.slice(components, 1, 3), lambda ink: F.lit(1.0) - F.least(F.lit(1.0), ink + black)))
        .otherwise(F.slice(components, 1, 3))
    )
