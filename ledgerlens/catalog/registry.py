"""Named queries: how to build each one, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.catalog.views import Views, with_ctes

Build = Callable[[Views], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Build
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, build: Build, sql: str | None = None, ctes: dict[str, str] | None = None) -> None:
    if name in REGISTRY:
        raise ValueError(f"query {name} is registered twice")
    REGISTRY[name] = Entry(build, None if sql is None else with_ctes(sql, ctes))


def plain(df: DataFrame, *drop: str) -> DataFrame:
    """Columns in types every engine prints alike: whole numbers as bigint, wei and lists as text."""
    columns = []
    for field in df.drop(*drop).schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.DecimalType):
            c = c.cast("string")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(kind, T.FloatType):
            c = c.cast("double")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c, ",")
        elif isinstance(kind, T.TimestampType):
            c = c.cast("timestamp_ntz")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round sums of fractions, whose last digits depend on the order of addition."""
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def to_digits(names: Sequence[str], digits: int) -> dict[str, int]:
    return dict.fromkeys(names, digits)


def sql_columns(columns: Sequence[str], digits: dict[str, int] | None = None, text: Sequence[str] = ()) -> str:
    """Select list with the same rounding and text casts as `rounded` and `plain`."""
    parts = []
    for c in columns:
        if digits and c in digits:
            parts.append(f"round({c}, {digits[c]}) AS {c}")
        elif c in text:
            parts.append(f"CAST({c} AS VARCHAR) AS {c}")
        else:
            parts.append(c)
    return ", ".join(parts)
