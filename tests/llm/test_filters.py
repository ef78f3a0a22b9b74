"""Filters that keep rows without a partner out of a shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.common import Filter, filter_bits, hash_filter, may_hold, stored
from ledgerlens.llm.repeats import anchor_rows, numbered
from ledgerlens.llm.substring_dedup import word_units


@pytest.mark.parametrize("rows, most_bits", [(0, 1 << 28), (3, 1 << 28), (60_000, 1 << 28), (60_000, 1 << 12)])
def test_filter_holds_all_and_little_else(spark, rows, most_bits):
    ids = stored(spark.range(rows).select(F.xxhash64("id").alias("h")), "ids")
    known = hash_filter(ids, "h", most_bits)
    assert len(known.value) * 8 == filter_bits(rows, most_bits)
    assert may_hold(Filter(known.value), np.array([r.h for r in ids.collect()], np.int64).view(np.uint64)).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 10_000).astype(np.uint64)
    if most_bits > 1 << 20:
        assert may_hold(Filter(known.value), others).mean() < 0.03


def test_anchors_without_a_partner_stay_where_they_are_made(spark):
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(40)] + [(40, " ".join(f"w0x{k}" for k in range(60)))]
    units = word_units(13, 5)
    rows = numbered(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text")
    counted = anchor_rows(rows, units, True).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    grams = stored(counted.select("gram"), "grams")
    made = anchor_rows(rows, units, False, hash_filter(grams, "gram"))
    assert made.join(grams, "gram").count() == 2 * grams.count()
    assert made.count() <= 2 * grams.count() + 5 < anchor_rows(rows, units, False).count()
