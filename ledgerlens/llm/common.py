"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.anchors import scramble
from ledgerlens.session import write_and_read

WORD = r"[^\x20\x09-\x0D]+"
MOST_BITS = 1 << 28
#: Bits of a filter that one task makes at a time.
PART_BITS = 1 << 19
PLACES = "part int, place int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, so that a lost executor costs no recomputation."""
    return write_and_read(df, name)


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One output batch for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := rows(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [t or "" for t in column.to_pylist()]


def words(text: str) -> list[bytes]:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return, in UTF-8."""
    return text.encode().split()


def portions(texts: list[str], size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of texts of about `size` characters, so that arrays made from them stay small."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column one after another, and where each row begins (one entry more than rows)."""
    values = pa.array(column.to_pylist(), pa.large_string()) if column.offset else column.cast(pa.large_string())
    values = values.fill_null("")
    _, offsets, data = values.buffers()
    starts = np.frombuffer(offsets, np.int64, len(values) + 1, 8 * values.offset)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), starts


def joined(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def map_runs(
    df: DataFrame,
    keys: list[str],
    fn: Callable[[tuple, pa.Table], pa.RecordBatch | None],
    schema: str,
    order: tuple[str, ...] = (),
    at_least: int = 1,
) -> DataFrame:
    """Call `fn(key values, rows)` once for each combination of the integer columns `keys`, in one sorted pass.

    Like a grouped map, but groups of two or three rows cost microseconds. Keys must not be null, and the caller bounds
    the rows of a group; a task holds one group and one batch. With `at_least`, whole groups are gathered until they
    have that many rows, and the key given is the last one's.
    """
    at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        last: tuple | None = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                out = fn(last, pa.Table.from_batches(held))
                if out is not None and out.num_rows:
                    yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in at]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                key = tuple(c[a].item() for c in columns)
                if key != last and count >= at_least:
                    yield from close()
                    held, count = [], 0
                last = key
                held.append(batch.slice(a, b - a))
                count += b - a
        yield from close()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def in_blocks(df: DataFrame, keys: list[str], member: str, block_rows: int) -> DataFrame:
    """Deal the rows of each group into blocks of about `block_rows` by the hash of `member`, and copy every row to each
    pair of blocks it belongs to: adds block (the row's own), low and high (the pair). A group of one block is one pair.
    """
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
    dealt = df.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node reachable over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def join_checked(df: DataFrame, ids: DataFrame, on: list[str], how: str, most: int = 500_000) -> DataFrame:
    """Join with a stored table of ids: sent to every task only when a count shows at most `most` rows, shuffled else."""
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids, on, how)


class Filter:
    """A Bloom filter with two bits for each 64-bit hash; says yes to every hash put in."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint64)

    @staticmethod
    def places(h: np.ndarray, size: int) -> list[np.ndarray]:
        return [h & np.uint64(size - 1), (h >> np.uint64(32)) & np.uint64(size - 1)]

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for p in self.places(h, 64 * len(self.bits)):
            found &= (self.bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return found


def filter_bits(rows: int, most_bits: int) -> int:
    """About 16 bits for each row, never more than `most_bits`, so what is sent to the driver and the tasks is bounded."""
    return min(most_bits, max(1 << 12, 1 << (16 * rows).bit_length()))


def put_in(h: np.ndarray, bits: int) -> pa.RecordBatch:
    """Parts and places of the bits of some hashes, for `filter_from`."""
    place = np.concatenate(Filter.places(h, bits)).astype(np.int64)
    return pa.record_batch([pa.array((place // PART_BITS).astype(np.int32)), pa.array((place % PART_BITS).astype(np.int32))], ["part", "place"])


def filter_from(places: DataFrame, bits: int) -> Broadcast:
    """A filter from the rows that `put_in` made; tasks make its parts, and the driver lays these one after another."""

    def part_of(key: tuple, rows: pa.Table) -> pa.RecordBatch:
        out = np.zeros(min(bits, PART_BITS), bool)
        out[rows.column("place").to_numpy()] = True
        return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    found = bytearray(bits // 8)
    for part, data in map_runs(places, ["part"], part_of, "part int, bits binary").collect():
        begin = part * (PART_BITS // 8)
        found[begin : begin + len(data)] = data
    return places.sparkSession.sparkContext.broadcast(bytes(found))


def hash_filter(ids: DataFrame, column: str, most_bits: int = MOST_BITS) -> Broadcast:
    """A filter of a stored table's 64-bit hashes, for `may_hold`. Rows it turns away need not be shuffled to be joined with
    that table; a full filter lets more of them through, and the join drops those."""
    bits = filter_bits(ids.count(), most_bits)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield put_in(scramble(batch.column(0).to_numpy().view(np.uint64)), bits)

    return filter_from(ids.select(column).mapInArrow(put, PLACES), bits)


def may_hold(known: Filter, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the table of a `hash_filter`; smallest hashes are alike in their high bits, so they are mixed."""
    return known.has(scramble(hashes))
