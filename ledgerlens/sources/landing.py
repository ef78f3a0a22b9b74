"""Landed JSON pages to typed raw rows, and the filters that decide which rows to load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.functions import ledger as L
from ledgerlens.functions import wide as W

# Fixed value: prefix of the source tag.
SOURCE = "etherscan"


def read_landed(spark: SparkSession, path: str, schema: str = schemas.API_TRANSACTION) -> DataFrame:
    """Newline-delimited JSON pages with a declared schema (no inference pass over the files)."""
    return spark.read.schema(schema).json(path)


def _as_column(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _raw_rows(pages: DataFrame, address: Column, internal: bool, ingested_at: Column | None) -> DataFrame:
    c = F.col
    value = L.parse_amount(c("value"))
    none_text, none_count, none_amount = (F.lit(None).cast(t) for t in ("string", "bigint", L.WEI))
    hashed = [c("hash"), c("blockNumber"), c("from"), c("to"), value]
    tag = SOURCE
    if internal:
        hashed.append(F.lit("internal"))
        tag = f"{SOURCE}_internal"

    def outer_only(expression: Column, missing: Column) -> Column:
        return missing if internal else expression

    return pages.select(
        F.lower(F.coalesce(c("hash"), F.lit(""))).alias("transaction_hash"),
        F.coalesce(L.optional_count(c("blockNumber")), F.lit(0)).cast("bigint").alias("block_number"),
        outer_only(F.nullif(F.lower("blockHash"), F.lit("")), none_text).alias("block_hash"),
        L.unix_to_timestamp(c("timeStamp")).alias("transaction_timestamp"),
        L.normalize_address(c("from")).alias("from_address"),
        F.when(c("to") != "", L.normalize_address(c("to"))).alias("to_address"),
        value.alias("value_wei"),
        L.wei_to_ether(value).alias("value_eth"),
        L.optional_count(c("gas")).alias("gas"),
        outer_only(F.nullif(L.parse_amount(c("gasPrice")), L.zero_wei()), none_amount).alias("gas_price"),
        L.optional_count(c("gasUsed")).alias("gas_used"),
        outer_only(L.optional_count(c("nonce")), none_count).alias("nonce"),
        outer_only(L.optional_count(c("transactionIndex")), none_count).alias("transaction_index"),
        F.when(c("input") != "0x", c("input")).alias("input_data"),
        F.when(c("contractAddress") != "", L.normalize_address(c("contractAddress"))).alias("contract_address"),
        F.coalesce(c("isError") == "1", F.lit(False)).alias("is_error"),
        outer_only(c("txreceipt_status"), none_text).alias("txreceipt_status"),
        outer_only(L.optional_count(c("confirmations")), none_count).alias("confirmations"),
        outer_only(c("methodId"), none_text).alias("method_id"),
        outer_only(c("functionName"), none_text).alias("function_name"),
        L.record_hash(*hashed).alias("record_hash"),
        F.concat(F.lit(f"{tag}:"), address).alias("source"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at"),
        # amounts over 38 digits exist only here
        c("value").alias("value_text"),
    )


def normalize_raw_transactions(
    pages: DataFrame, source_address: Column | str, *, ingested_at: Column | None = None
) -> DataFrame:
    """API transaction pages to the 23 typed raw columns and value_text, the amount as it came."""
    return _raw_rows(pages, _as_column(source_address), False, ingested_at)


def normalize_internal_transactions(
    pages: DataFrame, source_address: Column | str, *, ingested_at: Column | None = None
) -> DataFrame:
    """Internal-call pages to the same columns; fields of the outer transaction stay NULL."""
    return _raw_rows(pages, _as_column(source_address), True, ingested_at)


def normalize_raw_wallets(
    wallets: DataFrame,
    *,
    is_contract: Column | None = None,
    ingested_at: Column | None = None,
) -> DataFrame:
    """Wallet statistics (with balances, if attached) to the 16 typed raw columns."""
    c = F.col
    has_balance = "balance_wei" in wallets.columns
    balance = c("balance_wei").cast(L.WEI) if has_balance else F.lit(None).cast(L.WEI)
    wei_in = F.coalesce(c("total_value_in_wei").cast(L.WEI), L.zero_wei())
    wei_out = F.coalesce(c("total_value_out_wei").cast(L.WEI), L.zero_wei())

    def stamp(name: str) -> Column:
        return F.concat(F.date_format(name, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))

    def count(name: str) -> Column:
        return F.coalesce(c(name), F.lit(0)).cast("bigint")

    address = L.normalize_address(c("wallet_address"))
    return wallets.select(
        address.alias("wallet_address"),
        "first_seen_timestamp",
        "last_seen_timestamp",
        balance.alias("balance_wei"),
        L.wei_to_ether(balance).alias("balance_eth"),
        count("total_transactions_in").alias("total_transactions_in"),
        count("total_transactions_out").alias("total_transactions_out"),
        wei_in.alias("total_value_in_wei"),
        wei_out.alias("total_value_out_wei"),
        L.wei_to_ether(wei_in).alias("total_value_in_eth"),
        L.wei_to_ether(wei_out).alias("total_value_out_eth"),
        count("unique_counterparties").alias("unique_counterparties"),
        (F.lit(None).cast("boolean") if is_contract is None else is_contract).alias("is_contract"),
        L.record_hash(
            address,
            stamp("first_seen_timestamp"),
            stamp("last_seen_timestamp"),
            count("total_transactions_in"),
            count("total_transactions_out"),
        ).alias("record_hash"),
        F.lit("transaction_extraction").alias("source"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at"),
    )


def token_transfers_landing(transfers: DataFrame, contract: str | None = None) -> DataFrame:
    """Token transfer rows, typed, optionally for one token contract.

    Token amounts may use all 256 bits: `token_amount` holds them in wide form (see `functions.wide`), NULL when the
    text is no such number; `token_value` is the same in 38 digits, NULL beyond.
    """
    c = F.col
    wanted = transfers
    if contract is not None:
        wanted = transfers.filter(L.normalize_address(c("contractAddress")) == contract.lower().strip())
    return wanted.select(
        F.lower("hash").alias("transaction_hash"),
        L.optional_count(c("blockNumber")).alias("block_number"),
        L.unix_to_timestamp(c("timeStamp")).alias("transaction_timestamp"),
        L.normalize_address(c("from")).alias("from_address"),
        L.normalize_address(c("to")).alias("to_address"),
        L.normalize_address(c("contractAddress")).alias("contract_address"),
        L.parse_amount(c("value")).alias("token_value"),
        c("tokenName").alias("token_name"),
        c("tokenSymbol").alias("token_symbol"),
        L.optional_count(c("tokenDecimal")).cast("int").alias("token_decimal"),
        W.parse_wide(c("value")).alias("token_amount"),
        c("value").alias("value_text"),
    )


def token_totals(transfers: DataFrame) -> DataFrame:
    """Per token contract: transfers, exact total and largest amount as text, amounts over 38 digits, unreadable ones.

    One grouping; a contract that holds most rows is combined in the map tasks first.
    """
    amount = F.col("token_amount")
    return transfers.groupBy("contract_address").agg(
        F.count("*").alias("transfers"),
        W.wide_text(W.wide_sum(amount)).alias("total_amount"),
        W.wide_text(F.max(amount)).alias("largest_amount"),
        F.count_if(amount.isNotNull() & F.col("token_value").isNull()).alias("over_38_digits"),
        F.count_if(amount.isNull()).alias("unreadable"),
    )


def block_range_filter(
    tx: DataFrame, start_block: int = 0, end_block: int = 99_999_999, address: str | None = None
) -> DataFrame:
    """Transfers in [start_block, end_block], optionally touching one address."""
    kept = tx.filter(F.col("block_number").between(start_block, end_block))
    if address is None:
        return kept
    wanted = address.lower().strip()
    return kept.filter((F.col("from_address") == wanted) | (F.col("to_address") == wanted))


def read_address_list(spark: SparkSession, path: str) -> DataFrame:
    """Text file with one address per line."""
    lines = spark.read.text(path).select(L.normalize_address(F.col("value")).alias("wallet_address"))
    return lines.filter("wallet_address <> ''")


def address_list_filter(tx: DataFrame, addresses: DataFrame) -> DataFrame:
    """Transfers whose sender or receiver is listed.

    The list is joined, not collected; Spark broadcasts it when its measured size allows.
    """
    listed = addresses.select(L.normalize_address(F.col("wallet_address")).alias("listed")).distinct()
    as_sender = tx.join(listed, F.col("from_address") == F.col("listed"), "left_semi")
    others = tx.join(listed, F.col("from_address") == F.col("listed"), "left_anti")
    as_receiver = others.join(listed, F.col("to_address") == F.col("listed"), "left_semi")
    return as_sender.unionByName(as_receiver)


def new_rows_only(rows: DataFrame, existing: DataFrame, key: str = "transaction_hash") -> DataFrame:
    """Rows whose key the target does not hold."""
    return rows.join(existing.select(key), key, "left_anti")


def recurring_keys(rows: DataFrame, existing: DataFrame, key: str = "transaction_hash") -> DataFrame:
    """Keys of the rows that the target holds."""
    return rows.select(key).join(existing.select(key), key, "left_semi")


def new_wallets_only(wallets: DataFrame, existing: DataFrame, skip_existing: bool = True) -> DataFrame:
    return new_rows_only(wallets, existing, "wallet_address") if skip_existing else wallets


def ingestion_stats(fetched: DataFrame, existing: DataFrame, key: str = "transaction_hash") -> DataFrame:
    """One row: fetched, inserted, duplicate and broken row counts."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    tagged = fetched.join(known, key, "left")
    broken = F.col("value_wei").isNull() | F.col("transaction_timestamp").isNull()
    duplicate = F.coalesce(F.col("_known"), F.lit(False))
    return tagged.agg(
        F.count("*").alias("total_fetched"),
        F.count_if(~duplicate & ~broken).alias("total_inserted"),
        F.count_if(duplicate).alias("duplicates_skipped"),
        F.count_if(~duplicate & broken).alias("errors"),
    )
