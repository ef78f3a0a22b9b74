"""Approximate nearest neighbours by bucketed random projections (`BucketedRandomProjectionLSH`)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.grid import hash_sample
from ledgerlens.operators.metric_tree import fresh, nearest_of, squared_estimates, stack
from ledgerlens.session import write_and_read

TABLES = 20
HASHES = 4
SAMPLE_ROWS = 2048
WIDTHS = 4.0
BLOCK_ROWS = 1024
SEED = 17


def usual_distance(points: DataFrame, k: int, sample_rows: int = SAMPLE_ROWS) -> float:
    """Median distance to the k-th neighbour within a hash sample of at most twice `sample_rows` points."""
    x = stack(hash_sample(points, sample_rows)["vec"])
    if len(x) < 2:
        return 1.0
    near = np.maximum(squared_estimates(x, x)[0], 0.0)
    far = np.sqrt(np.partition(near, min(k, len(x) - 1), axis=1)[:, min(k, len(x) - 1)])
    return float(np.median(far)) or 1.0


def approximate_neighbors(
    points: DataFrame, k: int, *, tables: int = TABLES, hashes: int = HASHES, bucket_length: float | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED
) -> DataFrame:
    """(id, neighbor, neighbor_weight, distance): up to k close points of every (id, vec, weight) point.

    Points that agree in all `hashes` projections of one of the `tables` meet. The buckets are WIDTHS times as long as the
    usual distance to the k-th neighbour in a bounded sample, unless `bucket_length` is given. A bucket of more than
    `block_rows` points is cut into blocks along one more projection, and only blocks that follow each other meet: a crowded
    bucket costs time in proportion to its points. Distances are exact; some neighbours may be missing.
    """
    length = bucket_length or WIDTHS * usual_distance(points, k)
    kind = points.schema["id"].dataType.simpleString()
    rows = points.select("id", "vec", "weight", array_to_vector("vec").alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=length, numHashTables=tables * hashes, seed=seed).fit(rows)
    values = F.transform("hashes", lambda h: vector_to_array(h)[0].cast("long"))
    # one more projection, fine enough to put the points of a bucket in order
    line = BucketedRandomProjectionLSH(inputCol="features", outputCol="line", bucketLength=length / (1 << 20), numHashTables=1, seed=seed + 1).fit(rows)
    hashed = line.transform(model.transform(rows)).select("id", "vec", "weight", values.alias("v"), vector_to_array(F.col("line")[0])[0].alias("line"))
    bucket = F.explode(F.array(*[F.xxhash64(F.lit(t), F.slice("v", t * hashes + 1, hashes)) for t in range(tables)])).alias("bucket")
    placed = write_and_read(hashed.select("id", "line", bucket), "buckets")
    blocks = in_line_blocks(placed, block_rows)
    vectors = write_and_read(points.select("id", "vec", "weight"), "vectors")
    members = vectors.join(blocks, "id")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return nearest_of(left.assign(reach=np.inf, leaf=0), right.assign(leaf=0), k)[0] if len(left) and len(right) else pd.DataFrame()

    beside = F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block")
    right = members.select("id", "vec", "weight", "bucket", beside)
    schema = f"id {kind}, neighbor {kind}, neighbor_weight bigint, distance double"
    found = members.groupBy("bucket", "block").cogroup(fresh(right).groupBy("bucket", "block")).applyInPandas(meet, schema)
    one = F.struct("distance", "neighbor", "neighbor_weight")
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(one)), 1, k).alias("near"))
    return best.select("id", F.explode("near").alias("n")).select("id", "n.neighbor", "n.neighbor_weight", "n.distance")


def in_line_blocks(placed: DataFrame, block_rows: int) -> DataFrame:
    """(id, bucket, block) of buckets with two points or more; blocks are stretches of `line` of about `block_rows` points.

    Stretches follow from the range of the bucket and its number of points. A stretch that is still crowded is cut by a
    hash of the id into blocks that each meet themselves and those with the same number in crowded stretches beside it.
    """
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("line").alias("low"), F.max("line").alias("high")).filter("n > 1")
    parts = F.ceil(F.col("n") / block_rows)
    share = F.coalesce(F.try_divide(F.col("line") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    rows = placed.join(sizes, "bucket").select("id", "bucket", F.least(F.floor(share * parts), parts - 1).cast("long").alias("stretch"))
    crowd = rows.groupBy("bucket", "stretch").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("blocks"))
    dealt = rows.join(crowd, ["bucket", "stretch"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    return dealt.select("id", "bucket", F.when(F.col("blocks") == 1, F.col("stretch")).otherwise(F.col("stretch") + (F.col("own") + 1) * (1 << 40)).alias("block"))
