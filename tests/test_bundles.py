"""Blocks of one cell travel in bundles: results of any block size are the same, and rows are sent a few times only."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import metric_tree as M
from ledgerlens.operators import neighbors as N


@pytest.fixture(scope="module")
def points(spark):
    """Vectors close together in one cell, some of them far, some of them twice."""
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(size=(260, 6)) * 0.3, rng.normal(size=(40, 6)) * 4]
    x[290:] = x[:10]
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>").cache()


def test_bundles_send_a_row_a_few_times(spark):
    rows = spark.range(2000).select("id", F.lit(0).alias("cell"))

    def seen(l, r):
        return pd.DataFrame({"id": l["id"], "met": len(r), "most": max(len(l), len(r))})

    pairs = N.compare_blocks(rows, rows, seen, "id long, met long, most long", block_rows=10).cache()
    # every row meets every other, in blocks
    assert pairs.groupBy("id").agg(F.sum("met").alias("n")).agg(F.min("n"), F.max("n"), F.count("*")).first() == (2000, 2000, 2000)
    assert pairs.agg(F.max("most")).first()[0] <= 10
    merged = N.compare_blocks(rows, rows, seen, "id long, met long, most long", 10, lambda f: f.groupby("id", as_index=False).agg({"met": "sum", "most": "max"}))
    # one row for each bundle of the other side: 25 of 80 rows, not 200 of 10
    assert merged.count() == 2000 * 25


def test_block_size_changes_no_result(points):
    for block in (7, 64):
        assert sorted(map(tuple, N.dbscan(points, eps=0.7, min_samples=4, block_rows=block).collect())) == sorted(
            map(tuple, N.dbscan(points, eps=0.7, min_samples=4).collect())
        )
        few, many = ({(r[0], r[1], r[2], round(r[3], 9)) for r in N.eps_join(points, 0.7, block_rows=b).collect()} for b in (block, 2048))
        assert few == many and few


def test_within_is_exact_at_the_edge_and_for_odd_values():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(700, 5))
    b = np.r_[a[:300] + np.array([0.5, 0, 0, 0, 0]), rng.normal(size=(400, 5)) * 50, a[:3] * np.nan, a[:2] + 1e9]
    expected = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=-1)) <= 0.5
    assert expected.any() and (M.within(a, b, 0.5) == expected).all()
    assert M.within(a[:0], b, 0.5).shape == (0, len(b))
