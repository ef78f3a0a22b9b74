"""Imputation, scaling, outlier removal and description of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.ledger import all_of
from ledgerlens.functions.stats import (
    attach,
    exact_quantiles,
    quantile_row,
    sample_kurtosis,
    sample_skewness,
    tidy,
    usable,
)

SEED = 42
TEST_SHARE = 0.2


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _columns_with_gaps(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that hold a missing value; one aggregation, one small row to the driver."""
    gaps = df.agg(*[F.max(usable(F.col(c)).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if gaps[c]]


def impute(df: DataFrame, columns: Sequence[str] | None = None, *, strategy: str = "median") -> DataFrame:
    """Fill missing numbers with the column's mean, median or zero.

    Only columns that have gaps are ranked for their median. Filled columns become double.
    """
    columns = list(columns or numeric_columns(df))
    gaps = _columns_with_gaps(df, columns)
    if not gaps:
        return df
    if strategy == "zero":
        filled = {c: F.coalesce(usable(F.col(c)), F.lit(0.0)) for c in gaps}
    else:
        if strategy == "mean":
            stats = df.agg(*[F.avg(usable(F.col(c))).alias(f"{c}_fill") for c in gaps])
        else:
            stats = quantile_row(df, gaps, {"fill": 0.5})
        filled = {c: F.coalesce(usable(F.col(c)), F.col(f"_fill.{c}_fill")) for c in gaps}
        return attach(df, stats, "_fill").select(
            *[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns]
        )
    return df.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def finite_or_zero(c: Column) -> Column:
    value = F.coalesce(usable(c), F.lit(0.0))
    return F.when(F.abs(value) == float("inf"), 0.0).otherwise(value)


def scale_parameters(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """One row with `<column>_center` and `<column>_spread`; a zero spread becomes 1."""
    if method == "standard":
        stats = df.agg(
            *[F.avg(c).alias(f"{c}_center") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}_raw") for c in columns],
        )
    elif method == "minmax":
        stats = df.agg(
            *[F.min(c).cast("double").alias(f"{c}_center") for c in columns],
            *[(F.max(c) - F.min(c)).cast("double").alias(f"{c}_raw") for c in columns],
        )
    elif method == "robust":
        q = quantile_row(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
        stats = q.select(
            *[F.col(f"{c}_q50").alias(f"{c}_center") for c in columns],
            *[(F.col(f"{c}_q75") - F.col(f"{c}_q25")).alias(f"{c}_raw") for c in columns],
        )
    else:
        raise ValueError(f"unknown scaling method: {method}")
    return stats.select(
        *[F.col(f"{c}_center") for c in columns],
        *[F.when(F.col(f"{c}_raw") == 0, 1.0).otherwise(F.col(f"{c}_raw")).alias(f"{c}_spread") for c in columns],
    )


def apply_scaling(df: DataFrame, columns: Sequence[str], parameters: DataFrame) -> DataFrame:
    scaled = {c: (F.col(c) - F.col(f"_scale.{c}_center")) / F.col(f"_scale.{c}_spread") for c in columns}
    return attach(df, parameters, "_scale").select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def scale(df: DataFrame, columns: Sequence[str], *, method: str = "standard") -> tuple[DataFrame, DataFrame]:
    """Scaled frame and the one-row parameter frame."""
    parameters = scale_parameters(df, columns, method)
    return apply_scaling(df, columns, parameters), parameters


def clean_features(df: DataFrame, columns: Sequence[str], key: str = "wallet_address") -> DataFrame:
    """Key and available feature columns as doubles: gaps to median, infinities to 0."""
    available = [c for c in columns if c in df.columns]
    filled = impute(df.select(key, *available), available, strategy="median")
    return filled.select(key, *[finite_or_zero(F.col(c)).alias(c) for c in available])


def prepare_features(
    df: DataFrame, columns: Sequence[str], *, key: str = "wallet_address", parameters: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Model input: cleaned and standardised features, and the scaling parameters used (fitted when not given)."""
    cleaned = clean_features(df, columns, key)
    used = [c for c in cleaned.columns if c != key]
    fitted = scale_parameters(cleaned, used) if parameters is None else parameters
    return apply_scaling(cleaned, used, fitted), fitted


def remove_outliers(
    df: DataFrame, columns: Sequence[str], *, method: str = "iqr", threshold: float = 3.0
) -> DataFrame:
    """Rows inside the limits of every column; limits come from the full input."""
    if method == "iqr":
        limits = quantile_row(df, columns, {"q25": 0.25, "q75": 0.75})
        kept = []
        for c in columns:
            low, high = F.col(f"_limits.{c}_q25"), F.col(f"_limits.{c}_q75")
            reach = (high - low) * threshold
            kept.append((F.col(c) >= low - reach) & (F.col(c) <= high + reach))
    elif method == "zscore":
        limits = df.agg(
            *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_samp(c).alias(f"{c}_std") for c in columns]
        )
        kept = [
            F.abs(F.col(c) - F.col(f"_limits.{c}_mean")) <= F.col(f"_limits.{c}_std") * threshold for c in columns
        ]
    else:
        raise ValueError(f"unknown outlier method: {method}")
    return attach(df, limits, "_limits").filter(all_of(kept)).drop("_limits")


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, mean, std, extremes, quartiles and bias-corrected shape statistics."""
    columns = list(columns or numeric_columns(df))
    value = F.col("value")
    moments = (
        tidy(df, columns, keep_missing=True)
        .groupBy("feature")
        .agg(
            F.count("*").alias("count"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            sample_skewness(value).alias("skew"),
            sample_kurtosis(value).alias("kurtosis"),
        )
    )
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])

    def at(p: float, name: str) -> Column:
        return F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name)

    wide = quartiles.groupBy("feature").agg(at(0.5, "median"), at(0.25, "q25"), at(0.75, "q75"))
    return moments.join(wide, "feature").select(
        "feature", "count", "mean", "std", "min", "max", "median", "q25", "q75", "skew", "kurtosis"
    )


def split_bucket(key: Column, seed: int = SEED) -> Column:
    """Stable number from 0 to 9999 per key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10000))


def train_test_split(
    df: DataFrame, *, key: str = "wallet_address", test_share: float = TEST_SHARE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Disjoint train and test rows; a key always lands on the same side."""
    test = split_bucket(F.col(key), seed) < int(round(test_share * 10000))
    return df.filter(~test), df.filter(test)
