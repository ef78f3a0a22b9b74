"""Tasks that read back or shuffle transfers follow the number of order lines."""

from pyspark.sql import functions as F

from ledgerlens.catalog import views
from ledgerlens.catalog.views import Views
from ledgerlens.session import write_and_read


def test_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    kept = ("spark.sql.files.minPartitionNum", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k, None) for k in kept}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        monkeypatch.setattr(views, "ROWS_PER_TASK", 500)
        lines = spark.range(20_000).select(F.col("id").alias("l_orderkey"))
        for rows, tasks in ((20_000, 40), (20, spark.sparkContext.defaultParallelism)):
            folder = f"{tmp_path}/{rows}"
            lines.limit(rows).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
            Views(spark, folder).table("lineitem")
            assert int(spark.conf.get(kept[0])) == max(tasks, spark.sparkContext.defaultParallelism)
            assert int(spark.conf.get(kept[1])) == max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
            if rows == 20_000:
                stored = write_and_read(lines.withColumn("x", F.xxhash64("l_orderkey")).coalesce(1), "spread")
                assert stored.rdd.getNumPartitions() >= 40
                assert stored.count() == 20_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
