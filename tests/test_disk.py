"""What queries leave on disk: intermediate tables are compressed, and made once."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens.catalog import REGISTRY
from ledgerlens.catalog.views import Views


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """Order lines, orders and customers of a small ledger, with a few orders that come twice."""
    folder = str(tmp_path_factory.mktemp("given"))
    i = F.col("id")
    day = F.expr("timestamp_ntz '1997-01-01 00:00:00' + make_dt_interval(CAST(id % 40 AS INT))")
    lines = spark.range(400).select(
        (i % 90).alias("l_orderkey"), (i * 7 % 113).alias("l_partkey"), (i * 3 % 17).alias("l_suppkey"),
        (i % 5 + 1).cast("int").alias("l_linenumber"), (i % 50 + 1.0).alias("l_quantity"),
        (i * 13.37 + 1).alias("l_extendedprice"), (i % 11 / 100).alias("l_discount"), F.lit(0.02).alias("l_tax"),
        F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (i % 3 + 1).cast("int")).alias("l_returnflag"),
        F.when(i % 2 == 0, "F").otherwise("O").alias("l_linestatus"), day.alias("l_shipdate"),
    )
    orders = spark.range(90).select(
        i.alias("o_orderkey"), (i * 5 % 30).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
        (i * 10.0).alias("o_totalprice"), day.alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"),
    )
    customers = spark.range(30).select(
        i.alias("c_custkey"), F.concat(F.lit("c"), i.cast("string")).alias("c_name"), F.lit(1).alias("c_nationkey"),
        (i * 100.5 - 500).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"),
    )
    for name, rows in (("lineitem", lines), ("orders", orders), ("customer", customers)):
        rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture
def kept(spark, tmp_path, monkeypatch):
    """The folder in which the queries of a test leave their tables."""
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    return str(tmp_path)


def stored(kept, name):
    return [f for f in glob.glob(f"{kept}/{name}-*/**/part-*", recursive=True) if os.path.isfile(f)]


def test_landed_token_transfers_are_compressed(spark, given, kept):
    assert REGISTRY["token_totals"].build(Views(spark, given)).count() == 5
    files = stored(kept, "token-transfers")
    assert files and all(f.endswith(".json.gz") for f in files)


def test_intermediate_tables_are_zstd(spark, kept):
    table = session.write_and_read(spark.range(10).withColumn("k", F.col("id") % 2), "numbers", ("k",))
    files = stored(kept, "numbers")
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    assert table.agg(F.sum("id")).first()[0] == 45


def test_wallet_job_makes_raw_wallets_once(spark, given, kept):
    views = Views(spark, given)
    dim = REGISTRY["wallet_job"].build(views)
    wallets = dim.select("wallet_address").distinct().count()
    assert dim.filter("is_current").count() == wallets
    assert spark.read.parquet(*stored(kept, "raw-wallets")).count() == views.raw_wallets.count() == wallets


def test_tested_tables_are_made_once_and_as_in_the_views(spark, given, kept):
    from ledgerlens.catalog import profiles

    views = Views(spark, given)
    tables = profiles._ledger_tables(views)
    wholes = {
        "stg_transactions": views.staged, "fact_transactions": views.fact, "raw_wallets": views.raw_wallets,
        "stg_wallets": views.staged_wallets, "dim_wallet": views.dim, "dim_time": profiles._dim_time(views),
    }
    for name, whole in wholes.items():
        found = tables[name].drop("created_at", "updated_at")
        expected = whole.select(*found.columns)
        assert found.count() > 0 and found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()
    for test in profiles.quality.COLUMN_TESTS:
        assert test.column in tables[test.table].columns
    # nothing but raw transfers and the last moment goes back to the order lines
    for name in ("stg_transactions", "fact_transactions", "raw_wallets", "stg_wallets"):
        assert all(kept in f for f in tables[name].inputFiles())


def test_texts_are_packed_without_loss(spark):
    from ledgerlens.functions import ledger as L

    texts = ["0x00ab", "0x", "", "0xabc", "0xAB", "0X00", "0xzz", "plain", "ünï", "0x" + "0f" * 32, " 0x12", "01", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", L.pack_text(F.col("t")))
    assert rows.filter(~L.unpack_text(F.col("p")).eqNullSafe(F.col("t"))).isEmpty()
    assert rows.filter("length(t) = 66").select(F.length("p")).first()[0] == 33


def test_wallet_store_shuffles_a_transfer_once_for_both_sides(spark, given, kept, monkeypatch):
    from ledgerlens.sources import wallet_store as store

    odd = {
        "transaction_hash": F.when(F.col("block_number") % 5 == 0, F.upper("transaction_hash")).otherwise(F.col("transaction_hash")),
        "value_eth": F.when(F.col("block_number") % 3 == 0, F.col("value_eth") + 1).when(F.col("block_number") % 3 == 1, F.col("value_eth")),
    }
    fact = Views(spark, given).fact.withColumns(odd)
    monkeypatch.setattr(store, "SIDES_PER_TASK", 60)
    dealt = []
    slim = store._slim
    monkeypatch.setattr(store, "_slim", lambda *a: dealt.append(slim(*a)) or dealt[-1])
    store.build_store(fact, f"{kept}/store", rows_per_bucket=20)
    assert [d.count() for d in dealt] == [fact.count()]
    sizes = store._sizes(fact, "month")
    tasks = [r.n for r in dealt[0].groupBy("_task").agg(F.count("*").alias("n")).collect()]
    # a transfer has at most two sides; hashes deal a large month unevenly
    assert len(tasks) == store._tasks(sizes)[1] > len(sizes) and 2 * max(tasks) < 2 * 60
    found = store.open_store(spark, f"{kept}/store")
    expected = store._placed(fact, "month", 20).select(*found.columns)
    assert found.count() > fact.count() and found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()


def test_ingest_moves_whole_rows_only_where_hashes_recur(spark, tmp_path):
    from ledgerlens.streaming import ingest

    rows = spark.range(50).select(F.concat(F.lit("0x"), F.col("id").cast("string")).alias("transaction_hash"), F.col("id").alias("x"))
    known = rows.filter("x % 10 = 0 OR x > 60").select("transaction_hash")
    none = ingest.without_known(rows, known.filter("false"), f"{tmp_path}/none")
    assert none.count() == 50 and "Join" not in none._jdf.queryExecution().optimizedPlan().toString()
    left = ingest.without_known(rows, known.unionByName(known), f"{tmp_path}/some")
    assert sorted(r.x for r in left.collect()) == [x for x in range(50) if x % 10]
    assert "BroadcastHashJoin" in left._jdf.queryExecution().executedPlan().toString()
    # no hash is no key: such rows are not known
    odd = rows.withColumn("transaction_hash", F.when(F.col("x") > 5, F.col("transaction_hash")))
    kept = ingest.without_known(odd, odd.select("transaction_hash"), f"{tmp_path}/odd")
    assert kept.count() == 6 == ingest.landing.new_rows_only(odd, odd.select("transaction_hash")).count()


def test_the_full_load_moves_transfers_before_columns_are_derived(spark, given, kept, monkeypatch):
    from ledgerlens.operators import staging
    from ledgerlens.plans import daily as job
    from ledgerlens.sources import tables

    moved = []
    in_ranges = tables.in_ranges
    monkeypatch.setattr(tables, "in_ranges", lambda df, *by: moved.append(df) or in_ranges(df, *by))
    views, now = Views(spark, given), F.lit("1998-01-01").cast("timestamp_ntz")
    upper = {c: F.concat(F.lit(" "), F.upper(c)) for c in ("from_address", "block_hash")}
    raw = views.raw_transactions.withColumns(upper)
    job.run_daily(spark, raw, job.Paths(f"{kept}/warehouse"), now=now, key_buckets=2)
    assert len(moved) == 1 and not {"transaction_id", "gas_fee_wei", "transaction_type"} & set(moved[0].columns)
    found = spark.read.parquet(f"{kept}/warehouse/stg_transactions")
    for expected in (staging.stage_transactions(raw, staged_at=now), views.staged.withColumn("staged_at", now)):
        expected = expected.select(*found.columns)
        assert found.count() > 0 and found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()
