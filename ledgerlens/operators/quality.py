"""Data-quality checks. Each check returns the violating rows or values; the report counts them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import ledger as L
from ledgerlens.operators.staging import TRANSACTION_TYPES, WALLET_TYPES

# Fixed values.
ADDRESS_PATTERN = "^0x[a-f0-9]{40}$"
BALANCE_TIERS = ("whale", "large", "medium", "small", "dust")
VALUE_TIERS = ("zero", "micro", "small", "medium", "large", "very_large", "whale")


def check_valid_address(df: DataFrame, column: str) -> DataFrame:
    """Present addresses that are not 0x and 40 lower-case hexadecimal digits."""
    c = F.col(column)
    return df.filter(c.isNotNull() & ((F.length(c) != 42) | ~c.rlike(ADDRESS_PATTERN))).select(
        c.alias("invalid_address")
    )


def check_non_negative(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) < 0).select(F.col(column).alias("negative_value"))


def check_not_future(df: DataFrame, column: str, as_of: Column | DataFrame | str | None = None) -> DataFrame:
    now = F.current_timestamp() if as_of is None else L.point_in_time(as_of, df, column)
    return df.filter(F.col(column) > now).select(F.col(column).alias("future_timestamp"))


def check_unique(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    keys = [columns] if isinstance(columns, str) else list(columns)
    present = df.dropna(subset=keys) if len(keys) == 1 else df
    return present.groupBy(*keys).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def duplicate_surplus(df: DataFrame, column: str) -> DataFrame:
    """One row: rows minus distinct keys."""
    return df.agg((F.count("*") - F.count_distinct(column)).alias("duplicate_count"))


def check_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def check_accepted_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Present values outside the list, with their number of rows."""
    outside = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values))
    return outside.groupBy(F.col(column).alias("unexpected_value")).agg(F.count("*").alias("occurrences"))


def check_relationship(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Present keys without a parent row, with their number of rows."""
    keys = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("orphan_key")).agg(
        F.count("*").alias("occurrences")
    )
    return keys.join(parent.select(F.col(parent_column).alias("orphan_key")), "orphan_key", "left_anti")


def has_new_data(raw: DataFrame, date: dt.date | str | Column) -> DataFrame:
    """One row: number of rows ingested on a day, and whether there are any."""
    day = date if isinstance(date, Column) else F.lit(date).cast("date")
    return raw.filter(F.to_date("ingested_at") == day).agg(F.count("*").alias("record_count")).withColumn(
        "has_new_data", F.col("record_count") > 0
    )


def quality_report(checks: Mapping[str, DataFrame]) -> DataFrame:
    """(check, violations, passed) for frames of violations."""
    report = None
    for name, violations in checks.items():
        row = violations.agg(F.lit(name).alias("check_name"), F.count("*").alias("violations"))
        report = row if report is None else report.unionByName(row)
    return report.withColumn("passed", F.col("violations") == 0)


def staging_checks(staged: DataFrame, as_of: Column | DataFrame | str | None = None) -> dict[str, DataFrame]:
    """The three checks run after staging."""
    return {
        "null_transaction_hash": check_not_null(staged, "transaction_hash"),
        "future_timestamp": check_not_future(staged, "transaction_timestamp", as_of),
        "duplicate_transaction_id": check_unique(staged, "transaction_id"),
    }


# Which columns must be present, unique, and from a list.
REQUIRED = {
    "raw_transactions": ("transaction_hash", "block_number", "from_address", "transaction_timestamp", "ingested_at"),
    "raw_wallets": ("wallet_address", "ingested_at"),
    "stg_transactions": ("transaction_id", "transaction_hash", "block_number", "from_address"),
    "stg_wallets": ("wallet_id", "wallet_address"),
    "dim_time": ("time_key", "full_date"),
    "dim_wallet": ("wallet_key", "wallet_address"),
    "fact_transactions": ("transaction_key", "transaction_hash", "time_key", "from_wallet_key"),
}
UNIQUE = {
    "raw_wallets": ("wallet_address",),
    "stg_transactions": ("transaction_id",),
    "stg_wallets": ("wallet_id",),
    "dim_time": ("time_key", "full_date"),
    "dim_wallet": ("wallet_key",),
    "fact_transactions": ("transaction_key",),
}
ACCEPTED = {
    ("stg_transactions", "transaction_type"): TRANSACTION_TYPES,
    ("stg_wallets", "wallet_type"): WALLET_TYPES,
    ("dim_wallet", "balance_tier"): BALANCE_TIERS,
    ("fact_transactions", "value_tier"): VALUE_TIERS,
}


@dataclass(frozen=True)
class ColumnTest:
    """One test of a column: not_null, unique, accepted_values (of `values`) or relationship (to `parent`)."""

    table: str
    column: str
    kind: str
    values: tuple[str, ...] = ()
    parent: tuple[str, str] | None = None

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column}.{self.kind}"


COLUMN_TESTS = (
    *(ColumnTest(table, c, "not_null") for table, columns in REQUIRED.items() for c in columns),
    *(ColumnTest(table, c, "unique") for table, columns in UNIQUE.items() for c in columns),
    *(ColumnTest(table, c, "accepted_values", tuple(values)) for (table, c), values in ACCEPTED.items()),
    ColumnTest("fact_transactions", "time_key", "relationship", parent=("dim_time", "time_key")),
)


def table_checks(
    *,
    raw_transactions: DataFrame,
    raw_wallets: DataFrame,
    staged: DataFrame,
    staged_wallets: DataFrame,
    fact: DataFrame,
    dim_time: DataFrame,
    dim_wallet: DataFrame,
) -> dict[str, DataFrame]:
    """The violations of all 33 column tests, a frame for each; `column_tests` counts them in one scan per table."""
    tables = {
        "raw_transactions": raw_transactions,
        "raw_wallets": raw_wallets,
        "stg_transactions": staged,
        "stg_wallets": staged_wallets,
        "dim_time": dim_time,
        "dim_wallet": dim_wallet,
        "fact_transactions": fact,
    }

    def violations(test: ColumnTest) -> DataFrame:
        df = tables[test.table]
        if test.kind == "not_null":
            return check_not_null(df, test.column)
        if test.kind == "unique":
            return check_unique(df, test.column)
        if test.kind == "accepted_values":
            return check_accepted_values(df, test.column, test.values)
        parent, key = test.parent
        return check_relationship(df, test.column, tables[parent], key)

    return {test.name: violations(test) for test in COLUMN_TESTS}


def _evidence(test: ColumnTest, table: str) -> Column:
    """What a row of a table adds to a test: a key to group by, or nothing (NULL)."""
    column = F.col(test.column if test.table == table else test.parent[1])
    hit = {
        "not_null": column.isNull(),
        "unique": column.isNotNull(),
        "accepted_values": column.isNotNull() & ~column.isin(*test.values),
        "relationship": column.isNotNull(),
    }[test.kind]
    return F.when(
        hit,
        F.struct(
            F.lit(test.name).alias("check_name"),
            column.cast("string").alias("key"),
            F.lit(test.table == table).alias("child"),
        ),
    )


def column_tests(tables: Mapping[str, DataFrame], tests: Sequence[ColumnTest] = COLUMN_TESTS) -> DataFrame:
    """(check_name, violations, passed) of all tests; each table is scanned once, and one shuffle serves all tests.

    Rows become (test, key) pairs: the missing value, the value outside the list, or the key that must be unique or have
    a parent row. They are counted by pair, in the map tasks first, so that a frequent value does not meet in one task.
    Violations are rows for not_null, repeated keys for unique, distinct values for the other two; tests without any
    have 0. A NULL key needs no parent row.
    """
    pairs = None
    for table, df in tables.items():
        told = [t for t in tests if t.table == table or (t.parent and t.parent[0] == table)]
        if not told:
            continue
        found = F.explode(F.array_compact(F.array(*[_evidence(t, table) for t in told]))).alias("found")
        rows = df.select(found).select("found.*")
        pairs = rows if pairs is None else pairs.unionByName(rows)
    counted = pairs.groupBy("check_name", "key").agg(
        F.count_if("child").alias("n"), F.count_if(~F.col("child")).alias("parents")
    )
    kind = F.substring_index("check_name", ".", -1)
    found = (
        F.when(kind == "not_null", F.col("n"))
        .when(kind == "unique", (F.col("n") > 1).cast("bigint"))
        .otherwise(((F.col("n") > 0) & (F.col("parents") == 0)).cast("bigint"))
    )
    violations = counted.groupBy("check_name").agg(F.sum(found).alias("violations"))
    names = pairs.sparkSession.createDataFrame([(t.name,) for t in tests], "check_name string")
    report = names.join(violations, "check_name", "left").select(
        "check_name", F.coalesce("violations", F.lit(0)).alias("violations")
    )
    return report.withColumn("passed", F.col("violations") == 0)


def column_report(df: DataFrame, table: str, required: Sequence[str], accepted: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(check, violations, passed) of all row-level checks of one table in a single scan."""
    measures = [F.count_if(F.col(c).isNull()).alias(f"{table}|{c}|not_null") for c in required]
    for c, values in (accepted or {}).items():
        measures.append(F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*values)).alias(f"{table}|{c}|accepted_values"))
    row = df.agg(*measures)
    long = row.unpivot([], row.columns, "check_name", "violations")
    return long.select(
        F.replace("check_name", F.lit("|"), F.lit(".")).alias("check_name"),
        "violations",
        (F.col("violations") == 0).alias("passed"),
    )
