"""Ratios. A ratio whose divisor is 0 or null is null; what the source gives no formula for is the textbook's."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def percent(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b * 100)


def growth_pct(value: Column, order: WindowSpec) -> Column:
    """Against the period before, only if that is above 0."""
    before = F.lag(value).over(order)
    return F.when(before > 0, (value - before) / before * 100)


def debt_to_equity(debt: Column, equity: Column) -> Column:
    return ratio(debt, equity)


def health(debt: Column, equity: Column) -> Column:
    de = debt_to_equity(debt, equity)
    return F.when(de.isNull(), "N/A").when(de < 1, "Healthy Solvency").otherwise("Elevated Leverage")


def roce(ebit: Column, equity: Column, debt: Column) -> Column:
    return percent(ebit, equity + debt)


def cagr(first: Column, last: Column, years: int) -> Column:
    """Compound yearly growth in percent; null unless both ends are above 0."""
    return F.when((first > 0) & (last > 0), (F.pow(last / first, F.lit(1.0 / years)) - 1) * 100)
