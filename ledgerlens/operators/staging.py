"""Raw tables to staged tables: newest copy, cleaned fields, classification, quality."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import ledger as L
from ledgerlens.functions.tiers import tier

# Label of each missing field.
ISSUE_LABELS = (
    ("transaction_hash", "missing_hash"),
    ("from_address", "missing_from_address"),
    ("transaction_timestamp", "missing_timestamp"),
    ("value_wei", "missing_value"),
    ("block_number", "missing_block"),
)
OVERFLOW = "value_overflow"
TRANSACTION_TYPES = ("contract_creation", "contract_call", "value_transfer", "other")
WALLET_TYPES = (
    "contract", "receive_only", "send_only", "high_activity", "medium_activity", "low_activity", "minimal_activity",
)
ACTIVITY_TYPES = ((1001, "high_activity"), (101, "medium_activity"), (11, "low_activity"))
STORED_INPUT_LENGTH = 1000
PACKED = ("transaction_hash", "block_hash", "from_address", "to_address", "contract_address")


def dedup_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, first in `order`.

    Spark keeps only the best row per key in every map task before shuffling (rank limit), so a key with a large share
    of all rows does not become one large sort. The leading numeric hash makes the sort compare numbers: text keys with
    a common prefix, such as hashes and addresses, would be compared character by character.
    """
    hashed = df.withColumn("_key", F.xxhash64(*keys))
    ranked = hashed.withColumn("_rank", F.row_number().over(Window.partitionBy("_key", *keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank", "_key")


def newest_first(df: DataFrame, time_column: str = "ingested_at", ties: Sequence[str] = ("record_hash",)) -> list[Column]:
    return [F.col(time_column).desc_nulls_last()] + [F.col(t).asc() for t in ties if t in df.columns]


def quality_score_tx(hash_: Column, sender: Column, time: Column) -> Column:
    return F.when(hash_.isNull(), 0.0).when(sender.isNull() | time.isNull(), 0.5).otherwise(1.0)


def quality_issues_tx(df: DataFrame) -> Column:
    """Array with one label per missing field; an amount that is there but over 38 digits is value_overflow, not missing."""
    labels = {field: F.when(df[field].isNull(), label) for field, label in ISSUE_LABELS}
    if "value_text" in df.columns:
        labels["value_wei"] = F.when(value_overflows(df), OVERFLOW).otherwise(labels["value_wei"])
    return F.array_compact(F.array(*labels.values()))


def value_overflows(df: DataFrame) -> Column:
    """Whether value_wei is NULL because the amount has over 38 digits; known from value_text."""
    if "value_text" not in df.columns:
        return F.lit(False)
    return df["value_wei"].isNull() & L.amount_overflows(df["value_text"])


def quality_score_wallet(wallet: Column, first_seen: Column, count_in: Column, count_out: Column) -> Column:
    idle = first_seen.isNull() & (count_in == 0) & (count_out == 0)
    return F.when(wallet.isNull(), 0.0).when(idle, 0.5).otherwise(1.0)


def quality_score_weighted(
    has_key: Column, has_timestamps: Column, has_required: Column, fields: Sequence[Column]
) -> Column:
    """0.4 key + 0.2 timestamps + 0.2 required fields + 0.2 share of filled fields."""
    filled = sum((F.when(f.isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    completeness = F.try_divide(filled, F.lit(len(fields)))
    return (
        has_key.cast("int") * 0.4
        + has_timestamps.cast("int") * 0.2
        + has_required.cast("int") * 0.2
        + completeness * 0.2
    )


def ingested_within(raw: DataFrame, days: int, as_of: Column | DataFrame | str | None = None) -> DataFrame:
    """Rows ingested in the last `days` days."""
    today = F.to_date(L.point_in_time(as_of, raw, "ingested_at"))
    return raw.filter(F.to_date("ingested_at") >= F.date_sub(today, days))


def stage_transactions(
    raw: DataFrame,
    *,
    staged_at: Column | None = None,
    lookback_days: int | None = None,
    as_of: Column | DataFrame | str | None = None,
    deal: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Newest copy of each transaction, cleaned, dated, priced and classified.

    Input data is shortened before the newest copy is picked; everything else that follows from a row alone is derived
    after it. So the shuffle carries no column twice and no long text, hashes and addresses as bytes, and only what a later
    step reads: a query that needs no input data never moves it. `deal` moves the newest copies once more, by columns of
    theirs or `transaction_date`, still before anything is derived.
    """
    source = raw if lookback_days is None else ingested_within(raw, lookback_days, as_of)
    keyed = source.withColumn("transaction_hash", L.clean_text(F.col("transaction_hash"))).filter(
        "transaction_hash IS NOT NULL"
    )
    shortened = _shorten_input(keyed)
    packed = shortened.withColumns({name: L.pack_text(L.clean_text(F.col(name))) for name in PACKED})
    newest = dedup_latest(packed, ["transaction_hash"], newest_first(packed))
    known = newest.filter(F.col("block_number").cast("bigint").isNotNull())
    if deal is not None:
        known = deal(known.withColumn("transaction_date", F.to_date("transaction_timestamp"))).drop("transaction_date")
    latest = known.withColumns({name: L.unpack_text(F.col(name)) for name in PACKED})
    return _clean_transactions(latest, F.current_timestamp() if staged_at is None else staged_at)


def _shorten_input(keyed: DataFrame) -> DataFrame:
    """Input data as it is stored, with what depends on all of it beside it."""
    c = F.col
    has_input = c("input_data").isNotNull() & (c("input_data") != "0x")
    return keyed.select(
        *[name for name in keyed.columns if name not in ("input_data", "method_id")],
        # the stored copy is shortened by definition; its full length is kept beside it
        F.when(has_input, F.left("input_data", F.lit(STORED_INPUT_LENGTH))).alias("input_data"),
        F.coalesce(F.length("input_data"), F.lit(0)).cast("bigint").alias("_input_length"),
        F.coalesce(has_input & (F.length("input_data") > 10), F.lit(False)).alias("_call"),
        F.when(F.length("input_data") >= 10, F.left("input_data", F.lit(10))).alias("method_id"),
    )


def _clean_transactions(latest: DataFrame, staged_at: Column) -> DataFrame:
    c = F.col
    creation = L.is_blank(c("to_address")) & c("contract_address").isNotNull()
    failed = F.coalesce(c("is_error"), F.lit(False))
    return latest.select(
        F.concat_ws("-", c("transaction_hash"), c("block_number").cast("string")).alias("transaction_id"),
        "transaction_hash",
        c("block_number").cast("bigint").alias("block_number"),
        L.clean_text(c("block_hash")).alias("block_hash"),
        "transaction_timestamp",
        F.to_date("transaction_timestamp").alias("transaction_date"),
        F.hour("transaction_timestamp").cast("bigint").alias("transaction_hour"),
        F.dayofweek("transaction_timestamp").cast("bigint").alias("day_of_week"),
        L.clean_text(c("from_address")).alias("from_address"),
        L.address_or_null(c("to_address")).alias("to_address"),
        c("value_wei").cast(L.WEI).alias("value_wei"),
        c("value_eth").cast("double").alias("value_eth"),
        F.lit(None).cast("double").alias("value_usd"),
        c("gas").cast("bigint").alias("gas_limit"),
        c("gas_price").cast(L.WEI).alias("gas_price_wei"),
        c("gas_used").cast("bigint").alias("gas_used"),
        F.try_multiply(c("gas_price").try_cast("decimal(28,0)"), c("gas_used").try_cast("decimal(19,0)"))
        .cast(L.WEI)
        .alias("gas_fee_wei"),
        (c("gas_used").cast("double") * c("gas_price").cast("double") / F.lit(L.WEI_PER_ETH)).alias("gas_fee_eth"),
        c("nonce").cast("bigint").alias("nonce"),
        c("transaction_index").cast("bigint").alias("transaction_index"),
        "input_data",
        c("_input_length").alias("input_data_length"),
        L.address_or_null(c("contract_address")).alias("contract_address"),
        creation.alias("is_contract_creation"),
        c("_call").alias("is_contract_interaction"),
        "method_id",
        (~failed).alias("is_successful"),
        failed.alias("is_error"),
        F.when(creation, TRANSACTION_TYPES[0])
        .when(c("_call"), TRANSACTION_TYPES[1])
        .when((c("value_wei") > 0) | value_overflows(latest), TRANSACTION_TYPES[2])
        .otherwise(TRANSACTION_TYPES[3])
        .alias("transaction_type"),
        quality_score_tx(c("transaction_hash"), c("from_address"), c("transaction_timestamp")).alias(
            "data_quality_score"
        ),
        quality_issues_tx(latest).alias("data_quality_issues"),
        "source",
        "ingested_at",
        staged_at.alias("staged_at"),
    )


# Columns of the slim daily variant.
RECENT_COLUMNS = (
    "transaction_id", "transaction_hash", "block_number", "block_hash", "transaction_timestamp", "transaction_date",
    "transaction_hour", "from_address", "to_address", "value_wei", "value_eth", "gas_limit", "gas_price_wei",
    "gas_used", "transaction_type", "is_successful", "source", "ingested_at", "staged_at",
)


def stage_transactions_recent(raw: DataFrame, *, lookback_days: int = 2, **options) -> DataFrame:
    """Slim variant over rows ingested in the last days."""
    return stage_transactions(raw, lookback_days=lookback_days, **options).select(*RECENT_COLUMNS)


def stage_wallets(raw: DataFrame, *, variant: str = "full", staged_at: Column | None = None) -> DataFrame:
    """Newest copy of each wallet with totals, rates, type and quality.

    `variant="dag"` keeps four wallet types and counts wallets without any transfer as receive_only.
    """
    c = F.col
    keyed = raw.withColumn("wallet_address", L.address_or_null(c("wallet_address"))).filter(
        "wallet_address IS NOT NULL"
    )
    latest = dedup_latest(keyed, ["wallet_address"], newest_first(keyed))

    count_in = F.coalesce("total_transactions_in", F.lit(0)).cast("bigint")
    count_out = F.coalesce("total_transactions_out", F.lit(0)).cast("bigint")
    wei_in = F.coalesce(c("total_value_in_wei"), L.zero_wei())
    wei_out = F.coalesce(c("total_value_out_wei"), L.zero_wei())
    eth_in, eth_out = L.wei_to_ether(wei_in), L.wei_to_ether(wei_out)
    total = count_in + count_out
    span = F.datediff(F.to_date("last_seen_timestamp"), F.to_date("first_seen_timestamp"))
    contract = F.coalesce(c("is_contract"), F.lit(False))
    if variant == "dag":
        kind = (
            F.when(contract, "contract")
            .when(count_out == 0, "receive_only")
            .when(count_in == 0, "send_only")
            .otherwise("active")
        )
    else:
        kind = (
            F.when(contract, "contract")
            .when((count_out == 0) & (count_in > 0), "receive_only")
            .when((count_in == 0) & (count_out > 0), "send_only")
            .otherwise(tier(total, ACTIVITY_TYPES, "minimal_activity"))
        )
    return latest.select(
        c("wallet_address").alias("wallet_id"),
        "wallet_address",
        c("first_seen_timestamp").alias("first_seen_at"),
        c("last_seen_timestamp").alias("last_seen_at"),
        F.to_date("first_seen_timestamp").alias("first_seen_date"),
        F.to_date("last_seen_timestamp").alias("last_seen_date"),
        c("balance_wei").cast(L.WEI).alias("balance_wei"),
        c("balance_eth").cast("double").alias("balance_eth"),
        total.alias("total_transactions"),
        count_in.alias("total_transactions_in"),
        count_out.alias("total_transactions_out"),
        wei_in.alias("total_value_in_wei"),
        wei_out.alias("total_value_out_wei"),
        (wei_in - wei_out).cast(L.WEI).alias("net_value_wei"),
        eth_in.alias("total_value_in_eth"),
        eth_out.alias("total_value_out_eth"),
        (eth_in - eth_out).alias("net_value_eth"),
        F.coalesce("unique_counterparties", F.lit(0)).cast("bigint").alias("unique_counterparties"),
        F.coalesce(F.try_divide(eth_in + eth_out, total), F.lit(0.0)).alias("avg_transaction_value_eth"),
        F.lit(None).cast("double").alias("max_transaction_value_eth"),
        F.coalesce(span + 1, F.lit(0)).cast("bigint").alias("activity_days"),
        F.when(span > 0, total / span).otherwise(total.cast("double")).alias("transactions_per_day"),
        F.try_divide(count_in.cast("double"), count_out).alias("in_out_ratio"),
        kind.alias("wallet_type"),
        contract.alias("is_contract"),
        F.lit(False).alias("is_exchange"),
        quality_score_wallet(
            c("wallet_address"), c("first_seen_timestamp"), c("total_transactions_in"), c("total_transactions_out")
        ).alias("data_quality_score"),
        "source",
        "ingested_at",
        (F.current_timestamp() if staged_at is None else staged_at).alias("staged_at"),
    )


def wallet_edges(tx: DataFrame, *carry: str) -> DataFrame:
    """One row per transfer side: (wallet, counterparty, direction) plus carried columns, in a single scan."""
    carried = [F.col(c) for c in carry]

    def side(wallet: str, counterparty: str, direction: str) -> Column:
        return F.struct(
            F.col(wallet).alias("wallet_address"),
            F.col(counterparty).alias("counterparty"),
            F.lit(direction).alias("direction"),
        )

    sides = F.array(side("from_address", "to_address", "out"), side("to_address", "from_address", "in"))
    return (
        tx.select(F.explode(sides).alias("side"), *carried)
        .select("side.*", *carry)
        .filter("wallet_address IS NOT NULL")
    )


def extract_wallets(tx: DataFrame, *, limit: int | None = None, min_transactions: int = 1) -> DataFrame:
    """Per wallet: first/last seen, transfers and wei in both directions, distinct counterparties."""
    known = (F.col("wallet_address") != "")
    edges = wallet_edges(tx, "value_wei", "transaction_timestamp").filter(known)
    incoming = F.col("direction") == "in"
    # grouping by pair first keeps the distinct count and the sums in one pass and splits a busy wallet over many tasks
    pairs = edges.groupBy("wallet_address", "counterparty").agg(
        F.min("transaction_timestamp").alias("first_seen"),
        F.max("transaction_timestamp").alias("last_seen"),
        F.count_if(incoming).alias("n_in"),
        F.count_if(~incoming).alias("n_out"),
        F.sum(F.when(incoming, F.col("value_wei")).otherwise(L.zero_wei())).alias("wei_in"),
        F.sum(F.when(~incoming, F.col("value_wei")).otherwise(L.zero_wei())).alias("wei_out"),
    )
    wallets = (
        pairs.groupBy("wallet_address")
        .agg(
            F.min("first_seen").alias("first_seen_timestamp"),
            F.max("last_seen").alias("last_seen_timestamp"),
            F.sum("n_in").alias("total_transactions_in"),
            F.sum("n_out").alias("total_transactions_out"),
            L.wei_sum(F.col("wei_in")).alias("total_value_in_wei"),
            L.wei_sum(F.col("wei_out")).alias("total_value_out_wei"),
            F.count("counterparty").alias("unique_counterparties"),
        )
        .filter(F.col("total_transactions_in") + F.col("total_transactions_out") >= min_transactions)
    )
    if limit is None:
        return wallets
    activity = (F.col("total_transactions_in") + F.col("total_transactions_out")).desc()
    return wallets.orderBy(activity, F.col("wallet_address")).limit(limit)


def wallet_stub_rows(addresses: DataFrame, existing: DataFrame) -> DataFrame:
    """Zero-statistics rows for listed addresses that the wallet table does not hold yet."""
    wanted = addresses.select(L.normalize_address(F.col("wallet_address")).alias("wallet_address")).distinct()
    zero = F.lit(0).cast("bigint")
    return wanted.join(existing.select("wallet_address"), "wallet_address", "left_anti").select(
        "wallet_address",
        F.lit(None).cast("timestamp").alias("first_seen_timestamp"),
        F.lit(None).cast("timestamp").alias("last_seen_timestamp"),
        zero.alias("total_transactions_in"),
        zero.alias("total_transactions_out"),
        L.zero_wei().alias("total_value_in_wei"),
        L.zero_wei().alias("total_value_out_wei"),
        zero.alias("unique_counterparties"),
    )


def enrich_balances(wallets: DataFrame, balances: DataFrame) -> DataFrame:
    """Attach balances (wallet_address, balance_wei); NULL where none is known."""
    known = balances.select(
        L.normalize_address(F.col("wallet_address")).alias("wallet_address"),
        F.col("balance_wei").cast(L.WEI).alias("balance_wei"),
        L.wei_to_ether(F.col("balance_wei")).alias("balance_eth"),
    )
    return wallets.join(known, "wallet_address", "left")
