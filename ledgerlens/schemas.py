"""Declared table schemas (DDL strings)."""

# Names and types of the exchanged tables.
API_TRANSACTION = (
    "hash string, blockNumber string, blockHash string, timeStamp string, `from` string, `to` string, value string, "
    "gas string, gasPrice string, gasUsed string, nonce string, transactionIndex string, input string, "
    "contractAddress string, isError string, txreceipt_status string, confirmations string, methodId string, "
    "functionName string"
)

API_TOKEN_TRANSFER = (
    "hash string, blockNumber string, timeStamp string, `from` string, `to` string, contractAddress string, "
    "value string, tokenName string, tokenSymbol string, tokenDecimal string"
)

RAW_TRANSACTIONS = (
    "transaction_hash string, block_number bigint, block_hash string, transaction_timestamp timestamp, "
    "from_address string, to_address string, value_wei decimal(38,0), value_eth double, gas bigint, "
    "gas_price decimal(38,0), gas_used bigint, nonce bigint, transaction_index bigint, input_data string, "
    "contract_address string, is_error boolean, txreceipt_status string, confirmations bigint, method_id string, "
    "function_name string, record_hash string, source string, ingested_at timestamp"
)

RAW_WALLETS = (
    "wallet_address string, first_seen_timestamp timestamp, last_seen_timestamp timestamp, "
    "balance_wei decimal(38,0), balance_eth double, total_transactions_in bigint, total_transactions_out bigint, "
    "total_value_in_wei decimal(38,0), total_value_out_wei decimal(38,0), total_value_in_eth double, "
    "total_value_out_eth double, unique_counterparties bigint, is_contract boolean, record_hash string, "
    "source string, ingested_at timestamp"
)

INGESTION_CHECKPOINTS = (
    "pipeline_name string, checkpoint_key string, checkpoint_value string, updated_at timestamp"
)

ADDRESS_LABELS = "wallet_address string, entity_name string, entity_category string"

TRAINING_METADATA = (
    "model_type string, training_samples bigint, feature_count int, features_used array<string>, "
    "training_start timestamp, training_end timestamp, random_seed int, test_size double, contamination double, "
    "metric string, metric_value double"
)
