"""Tree crowns as circles: areas, overlap, growth, and what they add to a yard's cover."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unknown import clamp, known, ratio

GROWTH = 2.5


def crown_area(radius: Column) -> Column:
    """No radius above zero means no crown: 0, the one place where unknown is not NULL."""
    r = known(radius)
    return F.coalesce(F.when(r > 0, F.pi() * r * r), F.lit(0.0))


def lens_area(x1: Column, y1: Column, r1: Column, x2: Column, y2: Column, r2: Column) -> Column:
    """Area common to two circles."""
    d = F.hypot(x2 - x1, y2 - y1)
    small = F.least(r1, r2)
    segment = lambda r, s: r * r * (lambda a: a - F.sin(2 * a) / 2)(F.acos(ratio(d * d + r * r - s * s, 2 * d * r)))
    return F.when(d >= r1 + r2, 0.0).when(d <= F.abs(r1 - r2), F.pi() * small * small).otherwise(segment(r1, r2) + segment(r2, r1))


def radius_at(radius: Column, maturity: Column, year: Column) -> Column:
    grown = (1 - F.exp(-GROWTH * year / F.nullif(maturity, F.lit(0.0)))) / (1 - exp(-GROWTH))
    return F.when(year <= 0, 0.0).when(maturity <= 0, radius).otherwise(radius * F.least(F.lit(1.0), grown))


def percent_after(existing: Column, added: Column, yard: Column) -> Column:
    return F.when(yard > 0, clamp(ratio(100 * (existing + added), yard), 0, 100))


def effective_added(union: Column, covered_share: Column) -> Column:
    """New crowns over ground that is covered already add nothing; an unknown share takes nothing off."""
    return F.coalesce(union * clamp(1 - known(covered_share), 0, 1), union)
