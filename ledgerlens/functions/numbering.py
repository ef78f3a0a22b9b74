"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import write_and_read

ROW_BITS = 33


def with_row_numbers(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add the place (from 0) of each row in the given order.

    Rows are range-partitioned and sorted; an id of partition and row is stored with each, and the sizes of the partitions
    before it make it a number. Only one count for each partition is brought together. Rows that tie get some order
    among themselves, so the order should end in a unique column.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = write_and_read(sorted_rows.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", ROW_BITS)
    sizes = stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    before, total = [], 0
    for r in sorted(sizes):
        before.append((r.part, total))
        total += r.n
    if not before:
        return stored.withColumnRenamed("_place", name)
    # one row for each partition
    offsets = df.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    placed = stored.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + F.col("_before")).select(*df.columns, name)
