"""Benchmark passages in documents, found by Wu-Manber search for many strings at once.

Texts and benchmark items become runs of lower-case words with one space before and after each. A window of item words
is then one byte string, and a scan of a document jumps over every position at which no window can end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import portions, stored

WINDOW_WORDS = 10
BLOCK_BYTES = 1 << 25
LONGEST_HEAD = 256
LANE = 256
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
# Letters A-Z become small; all but digits, letters and bytes of other scripts becomes a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_words(text: str) -> list[bytes]:
    return text.encode().translate(PLAIN).split()


class StringClass:
    """Shift and bucket tables for strings of similar length.

    Of each string the first `m` bytes (the length of the shortest) are its head. `shift` tells for a block of bytes how
    far a head that ends in this block may be moved at least; where it may not be moved, the bucket of the block lists the
    heads that end in it. Blocks share slots of `shift`, the smallest value counts.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        m = self.m = min(LONGEST_HEAD, min(len(s) for s in strings))
        heads = np.frombuffer(b"".join(s[:m] for s in strings), np.uint8).reshape(len(strings), m)
        # as in the method's paper, blocks grow with the logarithm of all heads; words use about 16 letters evenly
        self.block = min(8, m, max(1, int(np.ceil(np.log(2.0 * heads.size) / np.log(16)))))
        self.bits = int(min(24, max(10, np.ceil(np.log2(8.0 * heads.size)))))
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        blocks = np.zeros((len(strings), m - self.block + 1), np.uint64)
        for j in range(self.block):
            blocks |= heads[:, j : j + blocks.shape[1]].astype(np.uint64) << np.uint64(8 * j)
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.int32)
        for j in range(blocks.shape[1]):
            np.minimum.at(self.shift, self.slot(blocks[:, j]), m - self.block - j)
        self.order = np.argsort(blocks[:, -1], kind="stable")
        self.last, self.first = blocks[self.order, -1], blocks[self.order, 0]

    def slot(self, block: np.ndarray) -> np.ndarray:
        return ((block * FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def found(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where strings occur in `data` (which ends in 8 spare bytes): positions and numbers of strings.

        Stretches of LANE positions are scanned side by side, one step of each at a time.
        """
        at = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        reach = self.m - self.block
        stop = len(data) - 8 - self.m + 1
        place = np.arange(0, max(stop, 0), LANE)
        end = np.minimum(place + LANE, stop)
        held = []
        while len(place):
            step = self.shift[self.slot(at[place + reach] & self.mask)]
            held.append(place[step == 0])
            place = place + np.maximum(step, 1)
            go_on = place < end
            place, end = place[go_on], end[go_on]
        place = np.concatenate(held) if held else np.zeros(0, np.int64)
        begin = np.searchsorted(self.last, at[place + reach] & self.mask, "left")
        many = np.searchsorted(self.last, at[place + reach] & self.mask, "right") - begin
        which = np.repeat(begin - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(place) else np.zeros(0, np.int64)
        place = np.repeat(place, many)
        same = self.first[which] == at[place] & self.mask
        place, which = place[same], self.order[which[same]]
        same = np.fromiter((data.startswith(self.strings[w], p) for p, w in zip(place.tolist(), which.tolist())), bool, len(place))
        return place[same], which[same]


class Windows:
    """Benchmark windows ready for search, and the items that each belongs to."""

    def __init__(self, windows: pa.Table):
        text, item = windows.column("window").to_pylist(), windows.column("item").to_pylist()
        items: dict[str, set[str]] = {}
        for w, i in zip(text, item):
            items.setdefault(w, set()).update(() if i is None else (i,))
        by_length: dict[int, list[bytes]] = {}
        for w in items:
            by_length.setdefault(len(w.encode()).bit_length(), []).append(b" " + w.encode() + b" ")
        self.classes = [StringClass(strings) for strings in by_length.values()]
        self.items = [[items[s[1:-1].decode()] for s in c.strings] for c in self.classes]
        self.words = [np.array([s.count(b" ") - 1 for s in c.strings]) for c in self.classes]

    def hits(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """Of each text the number of words, the merged word ranges inside occurrences, and the items found."""
        plain = [b" ".join([b"", *plain_words(t), b""]) or b" " for t in texts]
        data = b"\n".join([*plain, bytes(8)])
        starts = np.r_[0, np.cumsum([len(p) + 1 for p in plain])]
        spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        first_space = np.searchsorted(spaces, starts)
        found: dict[int, tuple[list, set]] = {}
        for c, items, words in zip(self.classes, self.items, self.words):
            place, which = c.found(data)
            doc = np.searchsorted(starts, place, "right") - 1
            word = np.searchsorted(spaces, place) - first_space[doc]
            for d, a, b, w in zip(doc.tolist(), word.tolist(), (word + words[which]).tolist(), which.tolist()):
                spans, names = found.setdefault(d, ([], set()))
                spans.append((a, b))
                names |= items[w]
        for d, p in enumerate(plain):
            spans, names = found.get(d, ([], set()))
            yield p.count(b" ") - 1, merged(spans), names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, touching and overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_windows(benchmark: DataFrame, item_id: str, text: str, words: int) -> DataFrame:
    """Distinct (window, item) rows: each run of `words` item words, or all words of a shorter item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[str, str | None], None] = {}
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = plain_words(t or "")
                rows |= dict.fromkeys((b" ".join(w[i : i + words]).decode(), item) for i in range(max(len(w) - words, 0) + 1) if w)
                if len(rows) > 50_000:
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)], ["window", "item"])
                    rows = {}
            if rows:
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows)], ["window", "item"])

    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "window string, item string").distinct()


#: The tables of the block that this Python worker used last.
_ready: dict[str, Windows] = {}


def scan(docs: DataFrame, block: Broadcast, id_column: str, text: str, only_hits: bool) -> DataFrame:
    """id, digest, n_words, spans, items of each document, or of those with a hit."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, digest binary, n_words long, spans array<struct<first:int,end:int>>, items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if block.value[0] not in _ready:
            _ready.clear()
            _ready[block.value[0]] = Windows(block.value[1])
        windows = _ready[block.value[0]]
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for begin, end in portions(texts, 1 << 22):
                n, spans, items = zip(*windows.hits(texts[begin:end]))
                spans = [[{"first": a, "end": b} for a, b in s] for s in spans]
                part = batch.slice(begin, end - begin)
                arrays = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(spans, SPANS), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
                out = pa.record_batch(arrays, ["id", "digest", "n_words", "spans", "items"])
                yield out.filter(pa.array([bool(s) for s in spans])) if only_hits else out

    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_column).alias("id"), F.unhex(F.md5(body)).alias("digest"), body.alias("text")).mapInArrow(run, schema)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, *, words: int = WINDOW_WORDS, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document: id, n_words, spans (word ranges inside occurrences of a window, merged) and items (ids of the
    items with an occurring window, as text, sorted in byte order).

    Windows go to the tasks in blocks of about `block_bytes`, dealt by window and item, so that neither a long benchmark
    nor a window of very many items makes a block larger; documents are read once per block. With several blocks, rows
    that share id and text are put together again by both. Null texts and texts without words have no hits. Items without
    words have no windows; an item without id marks words, but no id can be listed. Repeated documents give repeated
    rows, repeated items count once, a null document id is kept. Other columns are not looked at. An empty benchmark
    leaves all documents without hits, an empty documents table gives no rows.
    """
    spark = docs.sparkSession
    pairs = stored(item_windows(benchmark, item_id, item_text, words), "benchmark-windows")
    size = pairs.agg(F.coalesce(F.sum(F.length("window") + F.coalesce(F.length("item"), F.lit(0)) + 64), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // block_bytes))
    parts = []
    for k in range(blocks):
        # a block is bounded by block_bytes, whatever the benchmark's size
        chosen = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k) if blocks > 1 else pairs
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, chosen.toArrow()))
        part = scan(docs, sent, id_column, text, k > 0)
        if blocks > 1:
            part = stored(part.withColumn("copies", F.lit(int(k == 0))), "benchmark-block")
            sent.destroy()
        parts.append(part)
    if blocks == 1:
        return parts[0].select(F.col("id").alias(id_column), "n_words", "spans", "items")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    together = rows.groupBy("id", "digest").agg(
        F.sum("copies").cast("int").alias("copies"), F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    return _joined_ranges(together).select(F.explode(F.array_repeat(F.struct("id", "n_words", "spans", "items"), F.col("copies"))).alias("r")).select(
        F.col("r.id").alias(id_column), "r.n_words", "r.spans", "r.items"
    )


def _joined_ranges(df: DataFrame) -> DataFrame:
    """Joins the ranges of the array column `spans` that several blocks gave."""
    at = df.columns.index("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"first": a, "end": b} for a, b in merged([(s["first"], s["end"]) for s in row])] for row in batch.column(at).to_pylist()]
            yield batch.set_column(at, "spans", pa.array(spans, SPANS))

    return df.mapInArrow(run, df.schema)
