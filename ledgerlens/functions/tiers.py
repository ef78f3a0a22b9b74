"""Banding of numbers into named tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds are lower limits, inclusive, highest first.
BALANCE_TIERS = ((10000.0, "whale"), (1000.0, "large"), (10.0, "medium"), (0.1, "small"))
ACTIVITY_LEVELS = ((10.0, "high"), (1.0, "medium"))
RISK_CATEGORIES = ((0.9, "critical"), (0.7, "high"), (0.4, "medium"))
VALUE_TIERS = ((100.0, "whale"), (10.0, "very_large"), (1.0, "large"), (0.1, "medium"), (0.001, "small"))
VOLUME_TIERS = ((100000.0, "whale (>100K)"), (10000.0, "large (10K-100K)"), (1000.0, "medium (1K-10K)"))
RISK_ORDER = ("critical", "high", "medium", "low")
HIGH_RISK = ("high", "critical")
SUSPICIOUS_FROM = 0.7


def tier(value: Column, bounds: Sequence[tuple[float, str]], lowest: str) -> Column:
    """Label of the first bound the value reaches; `lowest` for the rest and for NULL."""
    first, *rest = bounds
    banded = F.when(value >= first[0], first[1])
    for bound, label in rest:
        banded = banded.when(value >= bound, label)
    return banded.otherwise(lowest)


def value_tier(value: Column) -> Column:
    return F.when(value.isNull() | (value == 0), "zero").otherwise(tier(value, VALUE_TIERS, "micro"))


def balance_tier(balance: Column) -> Column:
    return tier(balance, BALANCE_TIERS, "dust")


def activity_level(per_day: Column) -> Column:
    return tier(per_day, ACTIVITY_LEVELS, "low")


def risk_category(score: Column) -> Column:
    return tier(score, RISK_CATEGORIES, "low")


def volume_tier(value: Column) -> Column:
    return tier(value, VOLUME_TIERS, "small (<1K)")


def severity(category: Column) -> Column:
    """1 for the most severe category, 4 for the least."""
    return F.array_position(F.array(*[F.lit(c) for c in RISK_ORDER]), category).cast("int")
