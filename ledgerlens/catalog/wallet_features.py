"""Feature queries."""

from __future__ import annotations

from ledgerlens.catalog.registry import plain, register, rounded, sql_columns
from ledgerlens.catalog.views import eth
from ledgerlens.operators import features, staging

INEXACT = {"std_value": 6, "avg_gas_used": 6}
BASIC = ("wallet_address", *features._BASIC_ORDER)

register(
    "wallet_edges",
    lambda v: plain(staging.wallet_edges(v.staged, "value_wei", "transaction_timestamp")),
    """
    SELECT wallet_address, counterparty, direction, CAST(value_wei AS VARCHAR) AS value_wei,
      ts AS transaction_timestamp FROM edges""",
)
register(
    "basic_features",
    lambda v: rounded(plain(features.basic_features(v.stored_staged)), INEXACT),
    f"SELECT {sql_columns(BASIC, digits=INEXACT)} FROM basic",
)
BEHAVIORAL = ("wallet_address", *features.BEHAVIORAL_FEATURES, "self_tx_total")
register(
    "behavioral_features",
    lambda v: plain(features.behavioral_features(v.stored_staged)),
    f"SELECT {', '.join(BEHAVIORAL)} FROM behavioral",
)
TEMPORAL = ("wallet_address", *features.TEMPORAL_FEATURES)
register(
    "temporal_features",
    lambda v: plain(features.temporal_features(v.staged)),
    f"SELECT {', '.join(TEMPORAL)} FROM temporal",
)
WINDOWS = ", ".join(
    f"count(*) FILTER (WHERE ts >= as_of - INTERVAL {d} DAY) AS tx_count_{d}d, "
    + eth(f"sum(CASE WHEN ts >= as_of - INTERVAL {d} DAY THEN value_wei ELSE 0 END)")
    + f" AS value_{d}d"
    for d in features.WINDOW_DAYS
)
register(
    "window_features",
    lambda v: plain(features.window_features(v.staged)),
    f"""
    SELECT wallet_address, {WINDOWS}
    FROM edges, (SELECT max(transaction_timestamp) AS as_of FROM staged) GROUP BY wallet_address""",
)
ALL = ("wallet_address", "first_tx_time", "last_tx_time", *features.FEATURE_COLUMNS)
register(
    "all_features",
    lambda v: rounded(plain(v.features, "feature_timestamp", "feature_version"), INEXACT),
    f"SELECT {sql_columns(ALL, digits=INEXACT)} FROM wallet_features",
)
NOTEBOOK = ["avg_gas_price_gwei" if c == "avg_gas_price" else c for c in features.BASIC_FEATURES]
register(
    "feature_variant_notebook",
    lambda v: rounded(plain(features.feature_variant_notebook(v.stored_staged)), INEXACT),
    f"""
    SELECT {sql_columns(('wallet_address', *NOTEBOOK), digits=INEXACT)}
    FROM (SELECT *, avg_gas_price / 1e9 AS avg_gas_price_gwei FROM basic)""",
)
