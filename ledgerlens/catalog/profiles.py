"""Profiling and data-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.catalog.layers import DIM_TIME, SPINE, _dim_time
from ledgerlens.catalog.registry import plain, register, rounded
from ledgerlens.catalog.views import Views, eth
from ledgerlens.functions import ledger as L
from ledgerlens.operators import profiling, quality
from ledgerlens.session import write_and_read

GWEI = "CAST(gas_price AS DOUBLE) / 1e9"

register(
    "profile_overview",
    lambda v: rounded(profiling.profile_overview(v.raw_transactions), {"avg_gas_price_gwei": 6}),
    f"""
    SELECT count(*) AS total_transactions, count(DISTINCT from_address) AS unique_senders,
      count(DISTINCT to_address) AS unique_receivers, min(transaction_timestamp) AS earliest_tx,
      max(transaction_timestamp) AS latest_tx, {eth('sum(value_wei)')} AS total_value_eth,
      {eth('sum(value_wei)')} / count(value_wei) AS avg_value_eth,
      CAST(sum(gas_used) AS DOUBLE) / count(gas_used) AS avg_gas_used,
      round(avg({GWEI}), 6) AS avg_gas_price_gwei FROM raw_transactions""",
)
register("profile_sample", lambda v: plain(profiling.profile_sample(v.raw_transactions)))


def described(source: str, columns: dict[str, str], rows: str = "count(*)") -> str:
    """SQL description of several numeric expressions of one table."""
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS feature, {rows} AS count, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std,
          min({x}) AS min, max({x}) AS max, quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.25) AS q25,
          quantile_cont({x}, 0.75) AS q75, round(skewness({x}), 6) AS skew, round(kurtosis({x}), 6) AS kurtosis
        FROM {source}"""
        for name, x in columns.items()
    )


SHAPE = {"mean": 6, "std": 6, "skew": 6, "kurtosis": 6}
register(
    "profile_values",
    lambda v: rounded(profiling.profile_values(v.raw_transactions), SHAPE),
    described(
        "raw_transactions",
        {"value_eth": "value_eth", "gas_used": "CAST(gas_used AS DOUBLE)", "gas_price_gwei": f"({GWEI})"},
    ),
)
register(
    "value_percentiles",
    lambda v: rounded(profiling.value_percentiles(v.raw_transactions), {"value_eth": 9}),
    " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS probability, round(quantile_cont(value_eth, {p}), 9) AS value_eth FROM raw_transactions"
        for p in profiling.VALUE_PERCENTILES
    ),
)


def histogram_sql(source: str, bins: int = 50) -> str:
    """SQL histogram of column x of a table expression; bin edges rounded."""
    return f"""
      SELECT bin, round(low + bin * width, 6) AS lower, round(low + (bin + 1) * width, 6) AS upper, count(*) AS count
      FROM (SELECT CAST(CASE WHEN high > low THEN least(floor((x - low) / ((high - low) / {bins})), {bins - 1}) ELSE 0 END
              AS BIGINT) AS bin, low, (high - low) / {bins} AS width
            FROM {source}, (SELECT min(x) AS low, max(x) AS high FROM {source}))
      GROUP BY bin, low, width"""


EDGES = {"lower": 6, "upper": 6}
register(
    "log_value_histogram",
    lambda v: rounded(plain(profiling.log_value_histogram(v.raw_transactions)), EDGES | {"log_median": 6}),
    f"""SELECT h.*, round(log10(m), 6) AS log_median FROM ({histogram_sql('logs')}) h,
    (SELECT quantile_cont(value_eth, 0.5) AS m FROM raw_transactions WHERE value_eth > 0)""",
    {"logs": "SELECT log10(value_eth + 1e-10) AS x FROM raw_transactions WHERE value_eth > 0"},
)
register(
    "zero_share",
    lambda v: profiling.zero_share(v.raw_transactions),
    """
    SELECT count(*) FILTER (WHERE value_eth = 0) AS zero_value, count(*) FILTER (WHERE value_eth > 0) AS non_zero_value
    FROM raw_transactions""",
)
register(
    "gas_histogram",
    lambda v: rounded(plain(profiling.gas_histogram(v.raw_transactions)), EDGES),
    histogram_sql("gas_rows"),
    {"gas_rows": "SELECT CAST(gas_used AS DOUBLE) AS x FROM raw_transactions"},
)
register(
    "gas_price_trimmed_histogram",
    lambda v: rounded(plain(profiling.gas_price_trimmed_histogram(v.raw_transactions)), EDGES),
    histogram_sql("price_rows"),
    {
        "price_rows": f"SELECT {GWEI} AS x FROM raw_transactions "
        f"WHERE {GWEI} < (SELECT quantile_cont({GWEI}, 0.99) FROM raw_transactions)"
    },
)
register(
    "profile_daily",
    lambda v: rounded(profiling.profile_daily(v.raw_transactions), {"avg_gas_gwei": 6}),
    f"""
    SELECT transaction_timestamp::DATE AS tx_date, count(*) AS tx_count, {eth('sum(value_wei)')} AS total_value,
      {eth('sum(value_wei)')} / count(value_wei) AS avg_value, count(DISTINCT from_address) AS unique_senders,
      round(avg({GWEI}), 6) AS avg_gas_gwei FROM raw_transactions GROUP BY 1""",
)
register(
    "profile_hour_of_day",
    lambda v: plain(profiling.profile_hour_of_day(v.raw_transactions)),
    f"""
    SELECT hour(transaction_timestamp) AS hour_of_day, count(*) AS tx_count, {eth('sum(value_wei)')} AS total_value
    FROM raw_transactions GROUP BY 1""",
)
register(
    "profile_day_of_week",
    lambda v: plain(profiling.profile_day_of_week(v.raw_transactions)),
    f"""
    SELECT dayofweek(transaction_timestamp) + 1 AS day_of_week, count(*) AS tx_count,
      {eth('sum(value_wei)')} AS total_value, strftime(any_value(transaction_timestamp), '%a') AS day_name
    FROM raw_transactions GROUP BY 1""",
)


def _known(v: Views) -> DataFrame:
    """Raw transfers with blank receivers as missing."""
    return v.raw_transactions.withColumn("to_address", L.address_or_null(F.col("to_address")))


SIDES = {
    "raw_sides": """
        SELECT from_address AS wallet, 'out' AS side, value_wei FROM raw_transactions WHERE from_address IS NOT NULL
        UNION ALL SELECT to_address, 'in', value_wei FROM raw_transactions WHERE to_address <> ''""",
    "ranked_wallets": f"""
        SELECT wallet, count(*) AS total_tx, {eth('sum(value_wei)')} AS total_value,
          count(*) FILTER (WHERE side = 'out') AS sent_tx, count(*) FILTER (WHERE side = 'in') AS received_tx
        FROM raw_sides GROUP BY wallet ORDER BY total_tx DESC, wallet LIMIT 20""",
}
register("top_wallets", lambda v: profiling.top_wallets(_known(v)), "SELECT * FROM ranked_wallets", SIDES)
register(
    "eda_summary",
    lambda v: rounded(profiling.eda_summary(_known(v), v.scores), {"zero_value_pct": 6, "high_risk_pct": 6, "avg_fraud_score": 6}),
    f"""
    SELECT count(*) AS total_transactions, {eth('sum(value_wei)')} AS total_value_eth,
      count(*) FILTER (WHERE value_eth = 0) AS zero_value_transactions,
      round(count(*) FILTER (WHERE value_eth = 0)::DOUBLE * 100 / count(*), 6) AS zero_value_pct,
      CAST(sum(gas_used) AS DOUBLE) / count(gas_used) AS avg_gas_used,
      min(transaction_timestamp)::DATE AS first_date, max(transaction_timestamp)::DATE AS last_date,
      quantile_cont(value_eth, 0.5) AS median_value_eth,
      (SELECT wallet FROM ranked_wallets ORDER BY total_tx DESC, wallet LIMIT 1) AS most_active_wallet,
      (SELECT max(total_tx) FROM ranked_wallets) AS most_active_tx,
      (SELECT count(*) FROM scores) AS wallets_scored,
      (SELECT count(*) FROM scores WHERE risk_category IN ('high', 'critical')) AS high_risk_wallets,
      (SELECT round(count(*) FILTER (WHERE risk_category IN ('high', 'critical'))::DOUBLE * 100 / count(*), 6)
       FROM scores) AS high_risk_pct,
      (SELECT round(avg(fraud_score), 6) FROM scores) AS avg_fraud_score
    FROM raw_transactions""",
    SIDES,
)

# --- data quality ------------------------------------------------------------------------------------------------
register(
    "check_valid_address",
    lambda v: quality.check_valid_address(v.raw_transactions, "contract_address"),
    """
    SELECT contract_address AS invalid_address FROM raw_transactions WHERE contract_address IS NOT NULL
      AND (length(contract_address) <> 42 OR NOT regexp_matches(contract_address, '^0x[a-f0-9]{40}$'))""",
)
register(
    "check_non_negative",
    lambda v: quality.check_non_negative(v.table("customer"), "c_acctbal"),
    "SELECT c_acctbal AS negative_value FROM customer WHERE c_acctbal < 0",
)
register(
    "check_not_future",
    lambda v: quality.check_not_future(v.staged, "staged_at", v.now),
    "SELECT staged_at AS future_timestamp FROM staged, moment WHERE staged_at > as_of",
)
register(
    "check_unique",
    lambda v: quality.check_unique(v.raw_transactions, "transaction_hash"),
    """
    SELECT transaction_hash, count(*) AS occurrences FROM raw_transactions
    GROUP BY transaction_hash HAVING count(*) > 1""",
)
register(
    "duplicate_surplus",
    lambda v: quality.duplicate_surplus(v.raw_transactions, "transaction_hash"),
    "SELECT count(*) - count(DISTINCT transaction_hash) AS duplicate_count FROM raw_transactions",
)
register(
    "check_not_null",
    lambda v: quality.check_not_null(v.raw_transactions, "to_address").select("transaction_hash", "block_number"),
    "SELECT transaction_hash, block_number FROM raw_transactions WHERE to_address IS NULL",
)
register(
    "check_accepted_values",
    lambda v: quality.check_accepted_values(v.fact, "value_tier", ["zero", "micro", "small"]),
    """
    SELECT value_tier AS unexpected_value, count(*) AS occurrences FROM fact
    WHERE value_tier NOT IN ('zero', 'micro', 'small') GROUP BY value_tier""",
)
register(
    "check_relationship",
    lambda v: quality.check_relationship(v.fact, "from_wallet_key", v.scores, "wallet_address"),
    """
    SELECT from_wallet_key AS orphan_key, count(*) AS occurrences FROM fact
    WHERE from_wallet_key NOT IN (SELECT wallet_address FROM scores) GROUP BY 1""",
)
register(
    "has_new_data",
    lambda v: quality.has_new_data(v.raw_transactions, F.to_date(v.now)),
    """
    SELECT count(*) AS record_count, count(*) > 0 AS has_new_data FROM raw_transactions, moment
    WHERE ingested_at::DATE = as_of::DATE""",
)
register(
    "quality_report",
    lambda v: quality.quality_report(quality.staging_checks(v.staged, v.now)),
    """
    SELECT *, violations = 0 AS passed FROM (
      SELECT 'null_transaction_hash' AS check_name, count(*) AS violations FROM staged WHERE transaction_hash IS NULL
      UNION ALL SELECT 'future_timestamp', count(*) FROM staged, moment WHERE transaction_timestamp > as_of
      UNION ALL SELECT 'duplicate_transaction_id', count(*) FROM (
        SELECT transaction_id FROM staged GROUP BY transaction_id HAVING count(*) > 1))""",
)


# Faults put into the tables, so that every kind of test finds some: column expressions for both engines.
FAULTS = {
    "raw_transactions": {
        "transaction_hash": "CASE WHEN block_number % 101 = 0 THEN NULL ELSE transaction_hash END",
        "from_address": "CASE WHEN block_number % 97 = 0 THEN NULL ELSE from_address END",
    },
    "raw_wallets": {"wallet_address": "CASE WHEN wallet_no % 9 = 0 THEN NULL WHEN wallet_no % 9 < 4 THEN '0x' || "
                    "CAST(wallet_no % 5 AS STRING) ELSE wallet_address END"},
    "stg_transactions": {
        "transaction_id": "CASE WHEN block_number % 89 = 0 THEN 'again' || CAST(block_number % 7 AS STRING) "
                          "ELSE transaction_id END",
        "transaction_type": "CASE WHEN block_number % 83 = 0 THEN 'odd' || CAST(block_number % 3 AS STRING) "
                            "WHEN block_number % 83 = 1 THEN NULL ELSE transaction_type END",
    },
    "stg_wallets": {
        "wallet_id": "CASE WHEN total_transactions % 11 = 0 THEN NULL ELSE wallet_id END",
        "wallet_type": "CASE WHEN total_transactions % 13 = 0 THEN 'odd' ELSE wallet_type END",
    },
    "dim_time": {"time_key": "CASE WHEN time_key % 100 = 15 THEN time_key - 1 WHEN time_key % 100 = 20 THEN NULL "
                 "ELSE time_key END"},
    "dim_wallet": {
        "wallet_key": "CASE WHEN total_transactions % 11 = 0 THEN 'one' ELSE wallet_key END",
        "balance_tier": "CASE WHEN total_transactions % 13 = 0 THEN '' ELSE balance_tier END",
    },
    "fact_transactions": {
        "transaction_key": "CASE WHEN block_number % 79 = 0 THEN NULL ELSE transaction_key END",
        "value_tier": "CASE WHEN block_number % 73 = 0 THEN 'odd' || CAST(block_number % 4 AS STRING) ELSE value_tier END",
    },
}


# what the tests read of staged transfers and, through the fact's expressions, of facts
TESTED_STAGED = (
    "transaction_id", "transaction_hash", "block_number", "from_address", "transaction_type", "transaction_date", "value_eth",
    "data_quality_issues", "data_quality_score",
)
TESTED_FACT = (
    "transaction_key", "transaction_hash", "block_number", "time_key", "from_wallet_key", "transaction_date", "value_tier",
)
# the same of raw wallets, and through them of staged wallets and of the dimension
TESTED_RAW_WALLETS = (
    "wallet_address", "wallet_no", "ingested_at", "total_transactions_in", "total_transactions_out", "is_contract", "balance_eth",
)
TESTED_STAGED_WALLETS = ("wallet_id", "wallet_address", "wallet_type", "total_transactions")
TESTED_DIM = ("wallet_key", "wallet_address", "balance_tier", "total_transactions")


def _stored_columns(df: DataFrame, columns: tuple[str, ...], name: str) -> tuple[DataFrame, DataFrame]:
    """The columns as a written table, and the same rows in the shape of `df`, for expressions over them: its other columns
    are NULL there, so only what is made from stored columns may be read of the results."""
    stored = write_and_read(df.select(*columns), name)
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in columns]
    return stored, stored.select("*", *others)


def _ledger_tables(v: Views) -> dict[str, DataFrame]:
    """The columns that are tested. The newest copies are picked once and wallets are made once; both are stored."""
    staged, shaped = _stored_columns(v.staged, TESTED_STAGED, "tested-transfers")
    fact = v.fact_of(shaped).select(*TESTED_FACT)
    raw_wallets, shaped_wallets = _stored_columns(v.raw_wallets, TESTED_RAW_WALLETS, "tested-wallets")
    staged_wallets = v.staged_wallets_of(shaped_wallets)
    return {
        "raw_transactions": v.raw_transactions,
        "raw_wallets": raw_wallets,
        "stg_transactions": staged,
        "stg_wallets": staged_wallets.select(*TESTED_STAGED_WALLETS),
        "dim_time": _dim_time(v, fact),
        "dim_wallet": v.dim_of(staged_wallets).select(*TESTED_DIM),
        "fact_transactions": fact,
    }


def _faulty(v: Views) -> DataFrame:
    tables = {
        name: df.withColumns({c: F.expr(x) for c, x in FAULTS[name].items()}) for name, df in _ledger_tables(v).items()
    }
    return quality.column_tests(tables)


# What the tests are, stated for the SQL on its own: table, its SQL name, required, unique, listed values.
TESTED = (
    ("raw_transactions", "raw_transactions", "transaction_hash block_number from_address transaction_timestamp ingested_at",
     "", {}),
    ("raw_wallets", "raw_wallets", "wallet_address ingested_at", "wallet_address", {}),
    ("stg_transactions", "staged", "transaction_id transaction_hash block_number from_address", "transaction_id",
     {"transaction_type": "contract_creation contract_call value_transfer other"}),
    ("stg_wallets", "staged_wallets", "wallet_id wallet_address", "wallet_id",
     {"wallet_type": "contract receive_only send_only high_activity medium_activity low_activity minimal_activity"}),
    ("dim_time", "days", "time_key full_date", "time_key full_date", {}),
    ("dim_wallet", "dim", "wallet_key wallet_address", "wallet_key", {"balance_tier": "whale large medium small dust"}),
    ("fact_transactions", "fact", "transaction_key transaction_hash time_key from_wallet_key", "transaction_key",
     {"value_tier": "zero micro small medium large very_large whale"}),
)


def _tested_sql(faults: dict[str, dict[str, str]]) -> tuple[str, dict[str, str]]:
    ctes, parts = {"days": DIM_TIME}, []
    for table, source, required, unique, listed in TESTED:
        changed = ", ".join(f"{x} AS {c}" for c, x in faults.get(table, {}).items())
        seen = f"seen_{table}"
        ctes[seen] = f"SELECT * REPLACE ({changed}) FROM {source}" if changed else f"SELECT * FROM {source}"
        for c in required.split():
            parts.append(f"SELECT '{table}.{c}.not_null' AS check_name, count(*) - count({c}) AS violations FROM {seen}")
        for c in unique.split():
            parts.append(
                f"SELECT '{table}.{c}.unique', count(*) FROM "
                f"(SELECT {c} FROM {seen} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)"
            )
        for c, values in listed.items():
            names = ", ".join(f"'{value}'" for value in values.split())
            parts.append(f"SELECT '{table}.{c}.accepted_values', count(DISTINCT {c}) FROM {seen} WHERE {c} NOT IN ({names})")
    parts.append(
        "SELECT 'fact_transactions.time_key.relationship', count(DISTINCT f.time_key) FROM seen_fact_transactions f "
        "ANTI JOIN seen_dim_time d ON f.time_key = d.time_key WHERE f.time_key IS NOT NULL"
    )
    return "SELECT *, violations = 0 AS passed FROM (" + " UNION ALL ".join(parts) + ")", {**SPINE, **ctes}


register("quality_report_tables", lambda v: quality.column_tests(_ledger_tables(v)), *_tested_sql({}))
register("quality_report_faults", _faulty, *_tested_sql(FAULTS))
register(
    "column_report",
    lambda v: quality.column_report(
        v.raw_transactions, "raw_transactions", ["transaction_hash", "to_address", "contract_address", "is_error"]
    ),
    """
    SELECT *, violations = 0 AS passed FROM (
      SELECT 'raw_transactions.transaction_hash.not_null' AS check_name,
        count(*) FILTER (WHERE transaction_hash IS NULL) AS violations FROM raw_transactions
      UNION ALL SELECT 'raw_transactions.to_address.not_null', count(*) FILTER (WHERE to_address IS NULL)
      FROM raw_transactions
      UNION ALL SELECT 'raw_transactions.contract_address.not_null', count(*) FILTER (WHERE contract_address IS NULL)
      FROM raw_transactions
      UNION ALL SELECT 'raw_transactions.is_error.not_null', count(*) FILTER (WHERE is_error IS NULL)
      FROM raw_transactions)""",
)
