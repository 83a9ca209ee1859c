"""Expressions over a book row: bid_px, bid_sz, ask_px, ask_sz arrays of nano-dollars and sizes, best_bid, best_ask."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickforge.contract import COMPARE_EPS, LEVELS, NANO


def total(values: Column, levels: int | None = None) -> Column:
    values = values if levels is None else F.slice(values, 1, levels)
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def ratio(x: Column, y: Column, empty: Column | float = 0.0) -> Column:
    """x / y, or `empty` where y is 0."""
    return F.when(y == 0, F.lit(empty) if not isinstance(empty, Column) else empty).otherwise(x / F.nullif(y, F.lit(0)))


def dollars(nanos: Column) -> Column:
    return nanos / float(NANO)


def mid(levels: int = LEVELS) -> Column:
    """Null if a side is missing."""
    return (F.col("best_bid") + F.col("best_ask")) / 2.0 / float(NANO)


def spread() -> Column:
    return dollars(F.col("best_ask") - F.col("best_bid"))


def microprice() -> Column:
    """Quotes weighted by the other side's size; the mid without sizes."""
    b, a = F.col("bid_sz")[0], F.col("ask_sz")[0]
    return F.when(a + b > 0, (dollars(F.col("best_bid")) * a + dollars(F.col("best_ask")) * b) / (a + b)).otherwise(mid())


def imbalance(levels: int | None = None) -> Column:
    b, a = total(F.col("bid_sz"), levels), total(F.col("ask_sz"), levels)
    return ratio(b - a, b + a)


def vwap(side: str, levels: int) -> Column:
    both = F.zip_with(F.slice(f"{side}_px", 1, levels), F.slice(f"{side}_sz", 1, levels), lambda p, s: p / float(NANO) * s)
    return ratio(F.aggregate(both, F.lit(0.0), lambda a, x: a + x), total(F.col(f"{side}_sz"), levels))


def active_levels(side: str) -> Column:
    return F.size(F.filter(F.col(f"{side}_sz"), lambda x: x > 0))


def valid() -> Column:
    return F.coalesce(F.col("best_bid") < F.col("best_ask"), F.lit(False))


def crossed() -> Column:
    return F.coalesce(F.col("best_bid") > F.col("best_ask"), F.lit(False))


def locked() -> Column:
    return F.coalesce(F.col("best_bid") == F.col("best_ask"), F.lit(False))


def guarded(x: Column, y: Column, empty: float = 0.0) -> Column:
    """x / y, or `empty` where y is within the comparison tolerance of 0."""
    return F.when(F.abs(y) <= COMPARE_EPS, empty).otherwise(x / F.when(F.abs(y) > COMPARE_EPS, y))
