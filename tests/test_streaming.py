import os

import pytest
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.catalog import Views, streams
from ledgerlens.catalog import views as views_module
from ledgerlens.catalog.ingest import pages
from ledgerlens.session import new_path, shared_folder
from ledgerlens.sources import tables
from ledgerlens.streaming import ingest
from ledgerlens.streaming.daily import stored_days, stream_daily_metrics
from ledgerlens.streaming.ingest import read_page_stream, stream_ingest


def run(spark, landing, table, state, files_per_batch=1000):
    found = read_page_stream(spark, landing, schemas.API_TRANSACTION, files_per_batch)
    stream_ingest(found, table, state, source_address=F.col("from"), buckets=8).awaitTermination()
    return spark.read.parquet(table)


def test_stream_resumes_and_skips_known_hashes(spark, views):
    landing, table, state = (new_path(spark, n) for n in ("pages", "raw", "state"))
    all_pages = pages(views).filter("ingested_at BETWEEN '1997-12-01' AND '1998-06-01'").drop("ingested_at")
    half = all_pages.filter("cast(blockNumber as int) % 2 = 0")
    half.write.json(landing)
    first = run(spark, landing, table, state).count()
    assert first == half.select(F.lower(F.trim("hash"))).distinct().count()
    # nothing new
    assert run(spark, landing, table, state).count() == first
    # the rest, together with everything already loaded
    all_pages.write.mode("append").json(landing)
    stored = run(spark, landing, table, state)
    assert stored.count() == all_pages.select(F.lower(F.trim("hash"))).distinct().count()
    assert stored.select("transaction_hash").distinct().count() == stored.count()


def hashes_of(df):
    return sorted(r.transaction_hash for r in df.select("transaction_hash").collect())


@pytest.mark.parametrize("appended", [False, True])
def test_a_micro_batch_that_is_cut_off_is_repeated_without_doubles(spark, views, monkeypatch, appended):
    landing, table, state = (new_path(spark, n) for n in ("pages", "raw", "state"))
    few = pages(views).filter("cast(blockNumber as int) % 40 = 0").drop("ingested_at")
    few.filter("cast(blockNumber as int) % 80 = 0").coalesce(1).write.json(landing)
    run(spark, landing, table, state)
    few.coalesce(1).write.mode("append").json(landing)
    real = tables.append_partitioned

    def stopping(df, path):
        if appended:
            real(df, path)
        raise RuntimeError("cut off")

    with monkeypatch.context() as patch:
        patch.setattr(tables, "append_partitioned", stopping)
        for _ in range(2):
            with pytest.raises(Exception, match="cut off"):
                run(spark, landing, table, state)
    stored = hashes_of(run(spark, landing, table, state))
    assert stored == sorted({r[0] for r in few.select(F.lower(F.trim("hash"))).collect()})
    kept = spark.read.parquet(f"{table}_hashes")
    assert hashes_of(kept) == stored


def test_hashes_are_compacted_and_only_their_buckets_read(spark, views, monkeypatch):
    landing, table, state = (new_path(spark, n) for n in ("pages", "raw", "state"))
    few = pages(views).filter("cast(blockNumber as int) % 40 = 0").drop("ingested_at")
    few.repartition(5).write.json(landing)
    monkeypatch.setattr(ingest, "COMPACT_EVERY", 2)
    stored = run(spark, landing, table, state, files_per_batch=1)
    kept = spark.read.parquet(f"{table}_hashes")
    assert hashes_of(kept) == hashes_of(stored) == sorted({r[0] for r in few.select(F.lower(F.trim("hash"))).collect()})
    names = {r.arrival for r in kept.select("arrival").distinct().collect()}
    # batches 0 to 4; the last compaction ran before batch 3
    assert sorted(n.split("-")[-1] for n in names) == ["3", "3", "4"] and sum(n.startswith("compact") for n in names) == 1
    known = ingest.known_hashes(stored.limit(1), f"{table}_hashes", "none", 8)
    filters = known._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert "bucket" in filters and known.select("bucket").distinct().count() == 1


def test_a_table_without_hashes_gets_them(spark, views):
    landing, table, state = (new_path(spark, n) for n in ("pages", "raw", "state"))
    few = pages(views).filter("cast(blockNumber as int) % 40 = 0").drop("ingested_at")
    few.write.json(landing)
    first = hashes_of(run(spark, landing, table, state))
    spark.read.parquet(table).drop("ingest_date").write.parquet(f"{table}-old")
    assert hashes_of(run(spark, landing, f"{table}-old", f"{state}-2")) == first


def test_daily_metrics_count_rows_of_any_lateness(spark, views):
    """Newest files first, one per micro-batch; then old rows in a later run with the same checkpoint."""
    landing, table, state = (new_path(spark, n) for n in ("facts", "daily", "state"))
    columns = ("transaction_timestamp", "is_successful", "value_wei", "gas_used", "from_address", "to_address")
    fact = views.fact.select(*columns).filter("transaction_timestamp >= '1998-05-01'").localCheckpoint()
    part = F.pmod(F.xxhash64("from_address", "value_wei"), F.lit(3))

    def load(rows):
        rows.coalesce(1).write.mode("append").parquet(landing)

    def days():
        source = spark.readStream.schema(fact.schema).option("maxFilesPerTrigger", 1).parquet(landing)
        stream_daily_metrics(source, table, state).awaitTermination()
        return sorted(map(str, spark.read.parquet(table).select("metric_date", "total_transactions", "total_value_wei", "total_gas_used").collect()))

    def whole(rows):
        found = stored_days(rows.withColumn("metric_date", F.to_date("transaction_timestamp")))
        return sorted(map(str, found.select("metric_date", "total_transactions", "total_value_wei", "total_gas_used").collect()))

    load(fact.filter((part == 0) & (F.col("transaction_timestamp") >= "1998-07-01")))
    load(fact.filter(part == 1))
    assert days() == whole(fact.filter((part == 1) | (part == 0) & (F.col("transaction_timestamp") >= "1998-07-01")))
    load(fact.filter((part == 2) | (part == 0) & (F.col("transaction_timestamp") < "1998-07-01")))
    assert days() == whole(fact)
    assert days() == whole(fact)


def test_a_micro_batch_leaves_only_its_tables(spark, views):
    """Rows are many times larger in memory than stored: no copy of them stays behind."""
    shared = shared_folder(spark)

    def copies():
        folders = (shared, spark.sparkContext.getCheckpointDir())
        found = [os.path.join(at, d) for f in folders for at, dirs, _ in os.walk(f.removeprefix("file:")) for d in dirs]
        return {d for d in found if os.path.basename(d).startswith(("arrived", "rdd-"))}

    landing, table, state = (new_path(spark, n) for n in ("pages", "raw", "state"))
    few = pages(views).filter("cast(blockNumber as int) % 40 = 0").drop("ingested_at")
    few.repartition(2).write.json(landing)
    before = copies()
    assert run(spark, landing, table, state, files_per_batch=1).count() > 0
    assert copies() == before


def test_derived_transfers_are_spread_by_their_number(spark, views, monkeypatch):
    fresh = Views(spark, views.sf_dir)
    monkeypatch.setattr(views_module, "ROWS_PER_TASK", 100)
    assert fresh.table("lineitem").rdd.getNumPartitions() == -(-fresh.lines // 100)
    monkeypatch.setattr(streams, "ROWS_PER_FILE", 100)
    assert streams._files_per_batch(fresh) == -(-fresh.lines // 300)


def test_streamed_transfers_are_dealt_to_more_files_as_they_grow(spark, views, monkeypatch):
    """All rows once; a month stays within the files of one micro-batch's number."""
    monkeypatch.setattr(streams, "ROWS_PER_FILE", 800)
    fresh = Views(spark, views.sf_dir)
    files = streams._files_per_batch(fresh)
    fact = fresh.fact.select("transaction_timestamp", "value_wei", "from_address")
    dealt = streams.dealt_by_month(fact, files)
    assert files > 1 and dealt.rdd.getNumPartitions() == streams.BATCHES * files
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, fact.collect()))
    most = dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < fact.count() / 3
