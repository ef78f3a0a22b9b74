"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.catalog.registry import plain, register
from ledgerlens.catalog.views import Views
from ledgerlens.functions import ledger as L
from ledgerlens.functions import wide as W
from ledgerlens.operators import staging
from ledgerlens.operators.features import FEATURE_COLUMNS
from ledgerlens.session import new_path
from ledgerlens.sources import landing, tables

CUTOFF = "1998-01-01"


def pages(v: Views) -> DataFrame:
    return pages_of(v.raw_transactions)


def pages_of(raw: DataFrame) -> DataFrame:
    """Transfers in the text form of the API pages; amounts up to 63 bits in hexadecimal, larger ones in decimal."""
    c = F.col
    small = c("value_wei") < F.lit(2**62)
    hexadecimal = F.concat(F.lit("0x"), F.lower(F.hex(F.when(small, c("value_wei").cast("bigint")))))
    return raw.select(
        c("transaction_hash").alias("hash"),
        c("block_number").cast("string").alias("blockNumber"),
        c("block_hash").alias("blockHash"),
        F.unix_timestamp(c("transaction_timestamp").cast("timestamp")).cast("string").alias("timeStamp"),
        c("from_address").alias("from"),
        c("to_address").alias("to"),
        F.coalesce(hexadecimal, c("value_wei").cast("string")).alias("value"),
        c("gas").cast("string").alias("gas"),
        c("gas_price").cast("string").alias("gasPrice"),
        c("gas_used").cast("string").alias("gasUsed"),
        c("nonce").cast("string").alias("nonce"),
        c("transaction_index").cast("string").alias("transactionIndex"),
        c("input_data").alias("input"),
        c("contract_address").alias("contractAddress"),
        F.when(c("is_error"), "1").otherwise("0").alias("isError"),
        F.when(c("is_error"), "0").otherwise("1").alias("txreceipt_status"),
        c("block_number").cast("string").alias("confirmations"),
        F.substring("input_data", 1, 10).alias("methodId"),
        F.lit(None).cast("string").alias("functionName"),
        "ingested_at",
    )


def raw_sql(internal: bool) -> str:
    def outer(expression: str, kind: str) -> str:
        return f"CAST(NULL AS {kind})" if internal else expression

    suffix, tag = (", 'internal'", "etherscan_internal:") if internal else ("", "etherscan:")
    return f"""
        SELECT lower(transaction_hash) AS transaction_hash, block_number, {outer('block_hash', 'VARCHAR')} AS block_hash,
          transaction_timestamp, lower(trim(from_address)) AS from_address,
          CASE WHEN to_address <> '' THEN lower(trim(to_address)) END AS to_address,
          CAST(value_wei AS VARCHAR) AS value_wei, value_eth, gas,
          {outer('CAST(nullif(gas_price, 0) AS VARCHAR)', 'VARCHAR')} AS gas_price, gas_used,
          {outer('nonce', 'BIGINT')} AS nonce, {outer('transaction_index', 'BIGINT')} AS transaction_index,
          CASE WHEN input_data <> '0x' THEN input_data END AS input_data,
          CASE WHEN contract_address <> '' THEN lower(trim(contract_address)) END AS contract_address,
          coalesce(is_error, FALSE) AS is_error,
          {outer("CASE WHEN is_error THEN '0' ELSE '1' END", 'VARCHAR')} AS txreceipt_status,
          {outer('block_number', 'BIGINT')} AS confirmations, {outer('left(input_data, 10)', 'VARCHAR')} AS method_id,
          CAST(NULL AS VARCHAR) AS function_name,
          sha256(concat_ws('|', transaction_hash, CAST(block_number AS VARCHAR), from_address,
            coalesce(to_address, 'None'), CAST(value_wei AS VARCHAR){suffix})) AS record_hash,
          '{tag}' || from_address AS source, ingested_at,
          CASE WHEN value_wei < {2**62} THEN '0x' || lower(hex(CAST(value_wei AS BIGINT)))
               ELSE CAST(value_wei AS VARCHAR) END AS value_text
        FROM raw_transactions"""


register(
    "normalize_raw_transactions",
    lambda v: plain(landing.normalize_raw_transactions(pages(v), F.col("from"), ingested_at=F.col("ingested_at"))),
    raw_sql(False),
)
register(
    "normalize_internal_transactions",
    lambda v: plain(landing.normalize_internal_transactions(pages(v), F.col("from"), ingested_at=F.col("ingested_at"))),
    raw_sql(True),
)


def balances(v: Views) -> DataFrame:
    return v.table("customer").select(
        F.upper(F.concat(F.lit("0x"), F.lpad(F.hex("c_custkey"), 40, "0"))).alias("wallet_address"),
        (F.round(F.greatest("c_acctbal", F.lit(0.0)) * 200).cast("bigint").cast(L.WEI) * F.lit(10**16).cast(L.WEI))
        .cast(L.WEI)
        .alias("balance_wei"),
    )


def extracted(v: Views) -> DataFrame:
    return staging.extract_wallets(v.raw_transactions)


register(
    "normalize_raw_wallets",
    lambda v: plain(
        landing.normalize_raw_wallets(
            staging.enrich_balances(extracted(v), balances(v)).drop("balance_eth"),
            is_contract=F.lit(False),
            ingested_at=F.col("last_seen_timestamp"),
        )
    ),
    """
    SELECT wallet_address, first_seen_timestamp, last_seen_timestamp, CAST(balance_wei AS VARCHAR) AS balance_wei,
      balance_eth, total_transactions_in, total_transactions_out,
      CAST(total_value_in_wei AS VARCHAR) AS total_value_in_wei,
      CAST(total_value_out_wei AS VARCHAR) AS total_value_out_wei,
      CAST(total_value_in_wei AS DOUBLE) / 1e18 AS total_value_in_eth,
      CAST(total_value_out_wei AS DOUBLE) / 1e18 AS total_value_out_eth, unique_counterparties, FALSE AS is_contract,
      sha256(concat_ws('|', wallet_address, strftime(first_seen_timestamp, '%Y-%m-%d %H:%M:%S') || '+00:00',
        strftime(last_seen_timestamp, '%Y-%m-%d %H:%M:%S') || '+00:00', CAST(total_transactions_in AS VARCHAR),
        CAST(total_transactions_out AS VARCHAR))) AS record_hash,
      'transaction_extraction' AS source, last_seen_timestamp AS ingested_at
    FROM raw_wallets""",
)

CONTRACT = "0x" + "0" * 39 + "3"


# amounts of four kinds by block: plain, times 2^160 in hexadecimal, with 50 more digits, and the largest of 256 bits
MORE_DIGITS = "7" * 50
HEX_ZEROS = 40
LIMB = 10**13


def _token_amount() -> Column:
    amount = F.col("value_wei")
    text = amount.cast("string")
    shifted = F.concat(F.lit("0x"), F.hex((amount % F.lit(2**62)).cast("bigint")), F.lit("0" * HEX_ZEROS))
    kind = F.col("block_number") % 4
    return (
        F.when(kind == 1, shifted)
        .when(kind == 2, F.concat(text, F.lit(MORE_DIGITS)))
        .when(kind == 3, F.when(F.col("transaction_index") == 5, "0xbroken").otherwise("0x" + "F" * 64))
        .otherwise(text)
    )


def _token_transfers(v: Views) -> DataFrame:
    """Order lines as token transfers, landed as JSON files and read back with a declared schema."""
    c = F.col
    transfers = v.raw_transactions.select(
        c("transaction_hash").alias("hash"),
        c("block_number").cast("string").alias("blockNumber"),
        F.unix_timestamp(c("transaction_timestamp").cast("timestamp")).cast("string").alias("timeStamp"),
        c("from_address").alias("from"),
        F.coalesce("to_address", F.lit("")).alias("to"),
        F.concat(F.lit("0x"), F.lpad(c("transaction_index").cast("string"), 40, "0")).alias("contractAddress"),
        _token_amount().alias("value"),
        F.lit("Token").alias("tokenName"),
        F.lit("TKN").alias("tokenSymbol"),
        F.lit("18").alias("tokenDecimal"),
    )
    path = new_path(v.spark, "token-transfers")
    # text of 256-bit amounts takes many times the order lines' size; files follow the rows, so none is large
    transfers.write.option("compression", "gzip").json(path)
    return landing.read_landed(v.spark, path, schemas.API_TOKEN_TRANSFER)


def _limb_sql(k: int) -> str:
    """Limb k (base 10^13, lowest first) of a token amount in SQL, before any carry."""
    shift, largest = 16**HEX_ZEROS // LIMB**k % LIMB, (2**256 - 1) // LIMB**k % LIMB
    digits = f"CAST(substr(long_digits, {78 - 13 * (k + 1) + 1}, 13) AS HUGEINT)"
    plain_limb = f"CAST(substr(lpad(CAST(value_wei AS VARCHAR), 78, '0'), {78 - 13 * (k + 1) + 1}, 13) AS HUGEINT)"
    return f"""CASE block_number % 4 WHEN 1 THEN small * {shift} WHEN 2 THEN {digits}
          WHEN 3 THEN CASE WHEN transaction_index <> 5 THEN {largest}::HUGEINT END ELSE {plain_limb} END AS s{k}"""


def _carry_sql(source: str, by: str, limbs: str) -> str:
    """Carry from limb to limb as nested selects; the result has the digits t0 to t5 and what is left over in c5."""
    sql = f"SELECT {by}, {limbs}, 0::HUGEINT AS c FROM {source}"
    for k in range(6):
        kept = "".join(f", t{i}" for i in range(k)) + "".join(f", s{i}" for i in range(k + 1, 6))
        sql = f"SELECT {by}{kept}, (s{k} + c) % {LIMB} AS t{k}, (s{k} + c) // {LIMB} AS c FROM ({sql})"
    return sql


def _digits_sql(prefix: str = "") -> str:
    lower = " || ".join(f"lpad(CAST({prefix}t{k} AS VARCHAR), 13, '0')" for k in range(5, -1, -1))
    return f"lpad(CAST({prefix}c AS VARCHAR), 13, '0') || {lower}"


def _bare_sql(text: str) -> str:
    return f"CASE WHEN {text} IS NOT NULL THEN coalesce(nullif(ltrim({text}, '0'), ''), '0') END"


TOKEN_COLUMNS = (
    "transaction_hash, block_number, transaction_timestamp, from_address, to_address, contract_address"
)
TOKEN_CTES = {
    "token_limbs": f"""
        SELECT {TOKEN_COLUMNS}, {', '.join(_limb_sql(k) for k in range(6))}
        FROM (SELECT lower(transaction_hash) AS transaction_hash, block_number, transaction_timestamp, from_address,
            lower(trim(coalesce(to_address, ''))) AS to_address, transaction_index, value_wei,
            '0x' || lpad(CAST(transaction_index AS VARCHAR), 40, '0') AS contract_address,
            CAST(value_wei AS HUGEINT) % {2**62} AS small,
            lpad(CAST(value_wei AS VARCHAR) || '{MORE_DIGITS}', 78, '0') AS long_digits
          FROM raw_transactions)""",
    "token_rows": f"""
        SELECT {TOKEN_COLUMNS}, t0, t1, t2, t3, t4, t5, {_digits_sql()} AS digits
        FROM ({_carry_sql('token_limbs', TOKEN_COLUMNS, 's0, s1, s2, s3, s4, s5')})""",
    "token_sums": f"""
        SELECT contract_address, {_digits_sql()} AS digits FROM ({_carry_sql(
            "(SELECT contract_address, " + ", ".join(f"sum(t{k}) AS s{k}" for k in range(6))
            + " FROM token_rows GROUP BY contract_address)", "contract_address", "s0, s1, s2, s3, s4, s5")})""",
}


def _landed_tokens(v: Views, contract: str | None = None) -> DataFrame:
    return landing.token_transfers_landing(_token_transfers(v), contract)


register(
    "token_transfers_landing",
    lambda v: plain(_landed_tokens(v, CONTRACT).withColumn("token_amount", W.wide_text(F.col("token_amount"))), "value_text"),
    f"""
    SELECT {TOKEN_COLUMNS}, CASE WHEN length({_bare_sql('digits')}) <= 38 THEN {_bare_sql('digits')} END AS token_value,
      'Token' AS token_name, 'TKN' AS token_symbol, CAST(18 AS BIGINT) AS token_decimal,
      {_bare_sql('digits')} AS token_amount
    FROM token_rows WHERE contract_address = '{CONTRACT}'""",
    TOKEN_CTES,
)

register(
    "token_totals",
    lambda v: landing.token_totals(_landed_tokens(v)),
    f"""
    SELECT contract_address, count(*) AS transfers, {_bare_sql('any_value(s.digits)')} AS total_amount,
      {_bare_sql('max(r.digits)')} AS largest_amount,
      count(*) FILTER (WHERE length(ltrim(r.digits, '0')) > 38) AS over_38_digits,
      count(*) FILTER (WHERE r.digits IS NULL) AS unreadable
    FROM token_rows r JOIN token_sums s USING (contract_address) GROUP BY contract_address""",
    TOKEN_CTES,
)

register(
    "block_range_filter",
    lambda v: landing.block_range_filter(v.staged, 1000, 9000, "0x" + "0" * 39 + "1").select(
        "transaction_id", "block_number", "from_address", "to_address"
    ),
    f"""
    SELECT transaction_id, block_number, from_address, to_address FROM staged
    WHERE block_number BETWEEN 1000 AND 9000
      AND (from_address = '0x{'0' * 39}1' OR to_address = '0x{'0' * 39}1')""",
)


def _listed_addresses(v: Views) -> DataFrame:
    """Address list landed as a text file: suppliers in debt."""
    path = new_path(v.spark, "addresses")
    address = F.concat(F.lit(" 0X"), F.lpad(F.hex("s_suppkey"), 40, "0"), F.lit(" "))
    v.table("supplier").filter("s_acctbal < 0").select(address.alias("value")).write.text(path)
    return landing.read_address_list(v.spark, path)


register(
    "address_list_filter",
    lambda v: landing.address_list_filter(v.staged, _listed_addresses(v)).select(
        "transaction_id", "from_address", "to_address"
    ),
    """
    SELECT transaction_id, from_address, to_address FROM staged
    WHERE from_address IN (SELECT a FROM listed) OR to_address IN (SELECT a FROM listed)""",
    {"listed": "SELECT '0x' || lpad(lower(hex(s_suppkey)), 40, '0') AS a FROM supplier WHERE s_acctbal < 0"},
)


def _hashed(v: Views) -> DataFrame:
    return v.raw_transactions.withColumn("transaction_hash", L.clean_text(F.col("transaction_hash")))


def _fetched(v: Views) -> DataFrame:
    return _hashed(v).filter(F.col("ingested_at") >= F.lit(CUTOFF).cast("timestamp_ntz"))


def _existing(v: Views) -> DataFrame:
    return _hashed(v).filter(F.col("ingested_at") < F.lit(CUTOFF).cast("timestamp_ntz"))


HASHED = {"hashed": "SELECT *, lower(trim(transaction_hash)) AS h FROM raw_transactions"}
OLD_HASHES = f"(SELECT h FROM hashed WHERE ingested_at < TIMESTAMP '{CUTOFF}')"

register(
    "new_rows_only",
    lambda v: landing.new_rows_only(_fetched(v), _existing(v)).select("transaction_hash", "block_number", "ingested_at"),
    f"""
    SELECT h AS transaction_hash, block_number, ingested_at FROM hashed
    WHERE ingested_at >= TIMESTAMP '{CUTOFF}' AND h NOT IN {OLD_HASHES}""",
    HASHED,
)
register(
    "new_wallets_only",
    lambda v: landing.new_wallets_only(
        extracted(v), v.table("customer").select(
            F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("c_custkey")), 40, "0")).alias("wallet_address"), "c_acctbal"
        ).filter("c_acctbal > 5000")
    ).select("wallet_address", "unique_counterparties"),
    """
    SELECT wallet_address, unique_counterparties FROM extracted WHERE wallet_address NOT IN (
      SELECT '0x' || lpad(lower(hex(c_custkey)), 40, '0') FROM customer WHERE c_acctbal > 5000)""",
)
register(
    "ingestion_stats",
    lambda v: landing.ingestion_stats(_fetched(v), _existing(v)),
    f"""
    SELECT count(*) AS total_fetched,
      count(*) FILTER (WHERE NOT known AND NOT broken) AS total_inserted,
      count(*) FILTER (WHERE known) AS duplicates_skipped,
      count(*) FILTER (WHERE NOT known AND broken) AS errors
    FROM (SELECT h IN {OLD_HASHES} AS known, value_wei IS NULL OR transaction_timestamp IS NULL AS broken
          FROM hashed WHERE ingested_at >= TIMESTAMP '{CUTOFF}')""",
    HASHED,
)


def _checkpoint_entries(v: Views) -> DataFrame:
    key = F.concat(F.lit("last_block:"), F.col("from_address"))
    return tables.checkpoint_entries(
        v.raw_transactions, "transactions", key, F.col("block_number"), F.col("ingested_at")
    )


def _checkpoint_log(v: Views) -> DataFrame:
    path = new_path(v.spark, "checkpoints")
    tables.append_checkpoint(path, _checkpoint_entries(v))
    return v.spark.read.parquet(path)


LOG = {
    "log": "SELECT 'transactions' AS pipeline_name, 'last_block:' || from_address AS checkpoint_key, "
    "CAST(block_number AS VARCHAR) AS checkpoint_value, ingested_at AS updated_at FROM raw_transactions"
}
register("set_checkpoint", _checkpoint_log, "SELECT * FROM log", LOG)
register(
    "get_checkpoint",
    lambda v: tables.get_checkpoint(_checkpoint_entries(v), "transactions"),
    """
    SELECT pipeline_name, checkpoint_key, checkpoint_value FROM (
      SELECT *, row_number() OVER (PARTITION BY checkpoint_key ORDER BY updated_at DESC, checkpoint_value DESC) AS rn
      FROM log) WHERE rn = 1""",
    LOG,
)
register(
    "resume_start_block",
    lambda v: tables.resume_start_block(
        staging.wallet_edges(v.staged, "block_number").select(F.col("wallet_address").alias("address"), "block_number"),
        v.table("customer").select(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("c_custkey")), 40, "0")).alias("address")),
    ),
    """
    SELECT address, CAST(coalesce(last_block + 1, 0) AS BIGINT) AS start_block, last_block AS checkpoint_block
    FROM (SELECT '0x' || lpad(lower(hex(c_custkey)), 40, '0') AS address FROM customer) c
    LEFT JOIN (SELECT w, max(block_number) AS last_block FROM (
        SELECT from_address AS w, block_number FROM staged WHERE from_address IS NOT NULL
        UNION ALL SELECT to_address, block_number FROM staged WHERE to_address IS NOT NULL) GROUP BY w) s
      ON w = address""",
)
register(
    "max_value",
    lambda v: tables.max_value(v.raw_transactions, "block_number", 0),
    "SELECT coalesce(max(block_number), 0) AS max_value FROM raw_transactions",
)


def _appended(v: Views) -> DataFrame:
    path = new_path(v.spark, "raw-transactions")
    for part in (_existing(v), _fetched(v)):
        tables.append_partitioned(part, path)
    return v.spark.read.parquet(path).select("transaction_hash", "block_number", "ingested_at", "ingest_date")


register(
    "append_partitioned",
    _appended,
    "SELECT h AS transaction_hash, block_number, ingested_at, CAST(ingested_at AS DATE) AS ingest_date FROM hashed",
    HASHED,
)


def _saved(v: Views) -> DataFrame:
    path = new_path(v.spark, "wallet-scores")
    scores = v.scores.select("wallet_address", "fraud_score", "risk_category")
    tables.save_table(scores.filter("fraud_score < 0.5"), path)
    tables.save_table(scores.filter("fraud_score >= 0.5"), path, append=True)
    return v.spark.read.parquet(path)


register("save_table", _saved, "SELECT wallet_address, fraud_score, risk_category FROM scores")
register(
    "load_features",
    lambda v: plain(tables.load_features(v.features, FEATURE_COLUMNS)).select(
        "wallet_address", "tx_count", "total_value", "unique_counterparties", "night_tx_ratio", "feature_timestamp"
    ),
    """
    SELECT wallet_address, tx_count, total_value, unique_counterparties, night_tx_ratio,
      as_of AS feature_timestamp FROM wallet_features, moment""",
)


def _laid_out(v: Views) -> DataFrame:
    path = new_path(v.spark, "fact")
    tables.write_table(v.fact, path, "fact_transactions")
    return v.spark.read.parquet(path).groupBy("transaction_date").agg(
        F.count("*").alias("transactions"), F.min("from_address").alias("first_sender")
    )


register(
    "table_layout",
    _laid_out,
    """
    SELECT transaction_date, count(*) AS transactions, min(from_address) AS first_sender
    FROM fact GROUP BY transaction_date""",
)
register(
    "table_inventory",
    lambda v: tables.table_inventory(
        {"raw_transactions": v.raw_transactions, "raw_wallets": v.raw_wallets, "wallet_fraud_scores": v.scores}
    ),
    """
    SELECT 'raw_transactions' AS table_name, count(*) AS row_count FROM raw_transactions
    UNION ALL SELECT 'raw_wallets', count(*) FROM raw_wallets
    UNION ALL SELECT 'wallet_fraud_scores', count(*) FROM scores""",
)


def _labelled(v: Views) -> DataFrame:
    def labels(table: str, key: str, name: str, category: str, keep: str) -> DataFrame:
        return v.table(table).filter(keep).select(
            F.concat(F.lit("0X"), F.lpad(F.hex(key), 40, "0")).alias("wallet_address"),
            F.col(name).alias("entity_name"),
            F.lit(category).alias("entity_category"),
        )

    return tables.label_lookup(
        v.staged_wallets.select("wallet_address", "wallet_type"),
        labels("supplier", "s_suppkey", "s_name", "exchange", "s_acctbal > 8000"),
        labels("customer", "c_custkey", "c_name", "contract", "c_acctbal > 8000"),
    )


register(
    "label_lookup",
    _labelled,
    """
    SELECT w.wallet_address, wallet_type, s_name IS NOT NULL AS is_exchange,
      s_name IS NOT NULL OR c_name IS NOT NULL AS is_known_entity, coalesce(s_name, c_name) AS entity_name,
      CASE WHEN s_name IS NOT NULL THEN 'exchange' WHEN c_name IS NOT NULL THEN 'contract' END AS entity_category
    FROM staged_wallets w
    LEFT JOIN (SELECT *, '0x' || lpad(lower(hex(s_suppkey)), 40, '0') AS a FROM supplier WHERE s_acctbal > 8000) s
      ON s.a = w.wallet_address
    LEFT JOIN (SELECT *, '0x' || lpad(lower(hex(c_custkey)), 40, '0') AS a FROM customer WHERE c_acctbal > 8000) c
      ON c.a = w.wallet_address""",
)
