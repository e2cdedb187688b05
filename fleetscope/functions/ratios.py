"""Ratios that never raise on a zero or missing denominator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def percent2(part: str | Column, whole: str | Column) -> Column:
    """``part / whole`` in percent, two decimals, half up; null without a denominator."""
    scaled = F.try_divide(_col(part).cast("double") * 10000, _col(whole).cast("double"))
    return F.floor(scaled + 0.5).cast("double") / 100


def ratio2(part: str | Column, whole: str | Column) -> Column:
    """``part / whole``, two decimals, half up; null without a denominator."""
    return F.floor(F.try_divide(_col(part).cast("double") * 100, _col(whole).cast("double")) + 0.5).cast("double") / 100


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))
