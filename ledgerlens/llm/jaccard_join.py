"""Exact Jaccard similarity join of documents as sets of word shingles, in the metric space of Jaccard distances.

Sets that share nothing are all at distance 1, so pivots taken from anywhere would put every set within reach of every
other. Regions therefore come from shared shingles first: two sets of similarity t or more share one of the smallest
(1 - t) n + 1 hashes of each, and all sets that share such a hash go to the region of its smallest document, the pivot.
In a region the distance to the pivot decides: sets within the threshold are linked to it, and by the triangle
inequality only those near the border (their distance to the pivot within 1 - t of a set outside) must meet the sets
outside. What is left is joined block by block, each by pivots, Voronoi cells with replicated border sets, recursively.
Parity sketches bound symmetric differences from below and save most comparisons: first short ones of equal length, then,
for what these leave, wide ones with about a bit for each shingle. Every link is verified on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.anchors import word_values
from ledgerlens.llm.common import Filter, hash_filter, in_blocks, join_checked, map_runs, may_hold, portions, stored
from ledgerlens.operators.neighbors import connected_components

SKETCH_BITS = 1024
PORTION = 1 << 19
PAIRS_AT_ONCE = 256
LEAF = 48
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SIGNATURES = "doc_id long, n int, set_key binary, prefix array<long>, sketch binary, wide binary"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def chained(words: np.ndarray, span: int) -> np.ndarray:
    """Hash of each run of `span` words."""
    h = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        h = mixed(h * MULTIPLIER + words[i : len(words) - span + 1 + i])
    return h


def shingle_sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    """For each text the distinct 64-bit hashes of its word shingles, ascending; fewer words than `size` are one shingle."""
    for begin, end in portions(texts, PORTION):
        words, starts = word_values([t.encode().lower() for t in texts[begin:end]])
        runs = chained(words, size) if len(words) >= size else words[:0]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            else:
                yield chained(words[a:b], b - a) if b > a else words[:0]


def sketch_of(shingles: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity of the number of shingles in each of `bits` classes; `bits` is a power of two."""
    kind = (shingles >> np.uint64(20)).astype(np.int64) % bits
    return np.packbits((np.bincount(kind, minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_sketch(shingles: np.ndarray) -> bytes | None:
    """Sketch with at least a bit for each shingle, where the short one would be full."""
    return sketch_of(shingles, 1 << (len(shingles) - 1).bit_length()) if len(shingles) > SKETCH_BITS else None


def least_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bound of the symmetric difference: bits in which sketches differ. A longer sketch is folded to the shorter."""

    def folded(x: np.ndarray, width: int) -> np.ndarray:
        while x.shape[-1] > width:
            x = x[..., : x.shape[-1] // 2] ^ x[..., x.shape[-1] // 2 :]
        return x

    width = min(a.shape[-1], b.shape[-1])
    return np.bitwise_count(folded(a, width) ^ folded(b, width)).sum(-1).astype(np.int64)


class Sketches:
    """Sketches of any lengths, those of one length in one array."""

    def __init__(self, sketches: list[bytes]):
        self.width = np.array([len(x) // 8 for x in sketches], np.int64)
        self.row = np.zeros(len(sketches), np.int64)
        self.arrays: dict[int, np.ndarray] = {}
        for width in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == width)
            self.row[at] = np.arange(len(at))
            self.arrays[width] = np.frombuffer(b"".join(sketches[i] for i in at.tolist()), np.uint64).reshape(len(at), width)

    def difference(self, i: int, others: np.ndarray) -> np.ndarray:
        """Lower bounds of the symmetric differences between set i and the others."""
        mine = self.arrays[int(self.width[i])][self.row[i]]
        out = np.zeros(len(others), np.int64)
        widths = self.width[others]
        for width, rows in self.arrays.items():
            at = np.flatnonzero(widths == width)
            if len(at):
                out[at] = least_difference(mine, rows[self.row[others[at]]])
        return out


def may_link(na, nb, difference, similar: tuple[int, int]):
    """Whether sizes and a lower bound of the symmetric difference allow a similarity of `similar` (numerator, denominator)."""
    up, down = similar
    return (difference * (up + down) <= (down - up) * (na + nb)) & (np.minimum(na, nb) * down >= np.maximum(na, nb) * up)


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def links(a: np.ndarray, b: np.ndarray, similar: tuple[int, int]) -> bool:
    both = common_count(a, b)
    return both > 0 and both * similar[1] >= similar[0] * (len(a) + len(b) - both)


def distances(sets: list[np.ndarray], pivot: np.ndarray) -> np.ndarray:
    """Jaccard distance of every set to the pivot."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.searchsorted(pivot, flat)
    at[at == len(pivot)] = 0
    shared = np.add.reduceat((pivot[at] == flat).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
    return 1 - shared / (sizes + len(pivot) - shared)


class RegionJoin:
    """Links within one region (or between two of its blocks) that connect what is not connected yet."""

    def __init__(self, sets: list[np.ndarray], sketches: Sketches, block: np.ndarray, cross: bool, outside: np.ndarray, similar: tuple[int, int]):
        self.sets, self.sketches, self.block, self.cross, self.outside, self.similar = sets, sketches, block, cross, outside, similar
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.root = list(range(len(sets)))
        self.found: list[tuple[int, int]] = []
        self.reach = 2 * (1 - similar[0] / similar[1]) + 1e-9

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def leaf(self, home: np.ndarray, guests: np.ndarray) -> None:
        for k, i in enumerate(home):
            rest = np.concatenate([home[k + 1 :], guests])
            pairs = self.outside[i] | self.outside[rest]
            if self.cross:
                pairs &= self.block[i] != self.block[rest]
            rest = rest[pairs]
            rest = rest[may_link(self.sizes[i], self.sizes[rest], np.abs(self.sizes[i] - self.sizes[rest]), self.similar)]
            near = may_link(self.sizes[i], self.sizes[rest], self.sketches.difference(int(i), rest), self.similar)
            for j in rest[near].tolist():
                a, b = self.find(int(i)), self.find(j)
                if a != b and links(self.sets[i], self.sets[j], self.similar):
                    self.root[max(a, b)] = min(a, b)
                    self.found.append((int(i), j))

    def join(self, home: np.ndarray, guests: np.ndarray) -> None:
        """Links among the sets at home and between them and the guests.

        Every set belongs to the Voronoi cell of its nearest pivot, and is a guest in each cell whose pivot is at most
        2 (1 - t) further away: a linked pair then meets in the cell of either one. Cells that pivots cannot make
        smaller are compared directly.
        """
        both = np.concatenate([home, guests])
        if len(both) <= LEAF or len(home) < 2:
            return self.leaf(home, guests)
        pivots = home[np.linspace(0, len(home) - 1, min(8, len(home))).astype(int)]
        sets = [self.sets[m] for m in both]
        away = np.stack([distances(sets, self.sets[p]) for p in pivots], 1)
        own = away.argmin(1)
        further = away - away[np.arange(len(both)), own][:, None]
        at_home = np.arange(len(both)) < len(home)
        for q in range(len(pivots)):
            cell = at_home & (own == q)
            entered = ~cell & (further[:, q] <= self.reach)
            if cell.any():
                smaller = cell.sum() + entered.sum() <= 0.75 * len(both)
                (self.join if smaller else self.leaf)(both[cell], both[entered])


def signatures(docs: DataFrame, size: int, similar: tuple[int, int], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: set size, 128-bit key of the set, its smallest hashes and parity sketches (the wide one null where the short one does)."""
    up, down = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in portions(texts, PORTION):
                rows = []
                for s in shingle_sets(texts[a:b], size):
                    first = len(s) - -(-len(s) * up // down) + 1 if len(s) else 0
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), s[:first].view(np.int64), sketch_of(s), wide_sketch(s)))
                kinds = (pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary())
                yield pa.record_batch([docs.slice(a, b - a), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    names = [f.split()[0] for f in SIGNATURES.split(", ")]
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, SIGNATURES)


def sets_of(docs: DataFrame, ids: DataFrame, size: int, id_column: str, text: str) -> DataFrame:
    """(doc, shingles) of the documents in `ids` (column doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in portions(texts, PORTION):
                sets = [s.tobytes() for s in shingle_sets(texts[a:b], size)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["doc", "shingles"])

    wanted = join_checked(docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text).alias("text")), ids, ["doc"], "left_semi")
    return wanted.mapInArrow(run, "doc long, shingles binary")


def similarity_groups(
    docs: DataFrame, shingle_words: int = 4, least_similar: tuple[int, int] = (85, 100), block_rows: int = 1000, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    Words are lower-cased in A-Z. Two documents link when intersection >= least_similar * union. Null, empty and wordless
    texts have no shingle and link with nothing. Equal sets are joined once. Rows that share an id are one node, with the
    links of each of their texts; null ids link with nothing and have no component. Other columns are ignored; an empty
    table gives an empty result.
    """
    similar = least_similar
    up, down = similar
    table = stored(signatures(docs, shingle_words, similar, id_column, text), "signatures")
    usable = table.where("n > 0 AND doc_id IS NOT NULL")
    classes = stored(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    members = stored(usable.select("doc_id", "n", "set_key").join(classes, "set_key").select("doc_id", "rep").distinct(), "members")
    copies = members.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("rep")).alias("leads")).where("NOT leads").select("doc_id")
    leaders = join_checked(usable, stored(copies, "copies"), ["doc_id"], "left_anti")
    entries = leaders.select(F.col("doc_id").alias("doc"), F.explode("prefix").alias("key"))
    shared = entries.groupBy("key").agg(F.min("doc").alias("region"), F.max("doc").alias("other")).where("region < other").drop("other")
    shared = stored(shared, "shared")
    known = hash_filter(shared, "key")

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries whose key may be shared, so that few others are shuffled to the join."""
        allowed = Filter(known.value)
        for b in batches:
            sizes = pc.list_value_length(b.column("prefix")).to_numpy(zero_copy_only=False)
            key = b.column("prefix").flatten().to_numpy(zero_copy_only=False)
            kept = may_hold(allowed, key.view(np.uint64))
            doc = np.repeat(b.column("doc").to_numpy(), sizes)
            yield pa.record_batch([pa.array(doc[kept], pa.int64()), pa.array(key[kept], pa.int64())], ["doc", "key"])

    met = leaders.select(F.col("doc_id").alias("doc"), "prefix").mapInArrow(meeting, "doc long, key long")
    regions = stored(met.join(shared, "key").where("doc <> region").select("region", "doc").distinct(), "regions")

    brief = leaders.select(F.col("doc_id").alias("doc"), "n", "sketch")
    pivot = brief.select(F.col("doc").alias("region"), F.col("n").alias("pivot_n"), F.col("sketch").alias("pivot_sketch"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Least distance to the pivot, and whether a link to it is possible."""
        for b in batches:
            n, m = (b.column(c).to_numpy().astype(np.int64) for c in ("n", "pivot_n"))
            sketch, other = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("sketch", "pivot_sketch"))
            apart = np.maximum(least_difference(sketch, other), np.abs(n - m))
            near = may_link(n, m, apart, similar)
            columns = [b.column("region"), b.column("doc"), b.column("n"), b.column("sketch"), pa.array(near), pa.array(2 * apart / (n + m + apart))]
            yield pa.record_batch(columns, ["region", "doc", "n", "sketch", "near", "least"])

    placed = regions.join(brief, "doc").join(pivot, "region").mapInArrow(bound, "region long, doc long, n int, sketch binary, near boolean, least double")
    placed = stored(placed, "placed")

    wide = leaders.select(F.col("doc_id").alias("doc"), F.coalesce("wide", "sketch").alias("wide"))

    def bound_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(c).to_numpy().astype(np.int64) for c in ("n", "pivot_n"))
            pairs = zip(b.column("wide").to_pylist(), b.column("pivot_wide").to_pylist())
            apart = np.array([least_difference(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs], np.int64)
            near = may_link(n, m, apart, similar)
            yield pa.record_batch([b.column("region"), b.column("doc"), pa.array(near), pa.array(2 * apart / (n + m + apart))], ["region", "doc", "near", "least"])

    long_pairs = placed.where(F.col("near") & (F.col("n") > SKETCH_BITS)).select("region", "doc", "n").join(wide, "doc")
    pivot_wide = wide.select(F.col("doc").alias("region"), F.col("wide").alias("pivot_wide")).join(pivot.select("region", "pivot_n"), "region")
    long_pairs = stored(long_pairs.join(pivot_wide, "region").mapInArrow(bound_wide, "region long, doc long, near boolean, least double"), "long-pairs")

    near = placed.where(F.col("near") & (F.col("n") <= SKETCH_BITS)).select("region", "doc")
    near = near.unionByName(long_pairs.where("near").select("region", "doc"))
    ids = stored(near.select(F.explode(F.array("region", "doc")).alias("doc")).distinct(), "near-ids")
    sets = stored(sets_of(docs, ids, shingle_words, id_column, text), "near-sets")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(at, PAIRS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, PAIRS_AT_ONCE)):
            linked, away = [], []
            for x, y in zip(b.column("shingles").to_pylist(), b.column("pivot_shingles").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = common_count(x, y)
                linked.append(links(x, y, similar))
                away.append(1 - both / max(len(x) + len(y) - both, 1))
            yield pa.record_batch([b.column("region"), b.column("doc"), pa.array(linked), pa.array(away)], ["region", "doc", "linked", "away"])

    pivot_sets = sets.select(F.col("doc").alias("region"), F.col("shingles").alias("pivot_shingles"))

    def verify(pairs: DataFrame) -> DataFrame:
        found = pairs.join(sets, "doc").join(pivot_sets, "region").mapInArrow(verified, "region long, doc long, linked boolean, away double")
        return stored(found.groupBy("region", "doc").agg(F.max("linked").alias("linked"), F.max("away").alias("away")), "checked")

    # a set is first held against its smallest pivot; where another pivot of it is linked to the same one, both are
    # connected, and the sum of the two distances bounds theirs from above
    first = near.groupBy("doc").agg(F.min("region").alias("region"))
    checked = verify(first)
    mine = checked.where("linked").select("doc", F.col("region").alias("center"), F.col("away").alias("own_away"))
    theirs = mine.select(F.col("doc").alias("region"), F.col("center").alias("other_center"), F.col("own_away").alias("other_away"))
    others = near.join(first.withColumnRenamed("region", "smallest"), "doc").where("region <> smallest").drop("smallest")
    others = stored(others.join(mine, "doc", "left").join(theirs, "region", "left"), "others")
    shared_center = F.coalesce(F.col("center") == F.col("other_center"), F.lit(False))
    inferred = others.where(shared_center).select("region", "doc", F.lit(True).alias("linked"), F.least(F.col("own_away") + F.col("other_away"), F.lit(1.0)).alias("away"))
    checked = stored(checked.unionByName(inferred).unionByName(verify(others.where(~shared_center).select("region", "doc"))), "all-checked")

    refuted = long_pairs.where("NOT near").groupBy("region", "doc").agg(F.max("least").alias("away"))
    bounds = checked.unionByName(refuted.withColumn("linked", F.lit(False)))
    rest = placed.join(bounds, ["region", "doc"], "left").withColumn("outside", ~F.coalesce("linked", F.lit(False)))
    rest = rest.withColumn("least", F.coalesce("away", "least"))
    edge = rest.where("outside").groupBy("region").agg(F.min("least").alias("first"), F.count("*").alias("others"))
    rest = rest.join(edge, "region").where(F.col("outside") | (F.col("least") >= F.col("first") - F.lit(1 - up / down + 1e-9)))
    rest = stored(rest.select("region", "doc", "n", "sketch", "outside"), "rest")

    def possible(key: tuple, rows: pa.Table) -> pa.RecordBatch | None:
        """Documents of a pair of blocks that may link with another one; guests meet each other in their own class."""
        n, outside, guest, block = (rows.column(c).to_numpy() for c in ("n", "outside", "guest", "block"))
        n = n.astype(np.int64)
        sketches = Sketches(rows.column("sketch").to_pylist())
        hit = np.zeros(len(n), bool)
        left = np.flatnonzero(block == key[2])
        right = np.flatnonzero(block == key[3])
        for i in left.tolist():
            j = right[right > i] if key[2] == key[3] else right
            j = j[(outside[i] | outside[j]) & ~(guest[i] & guest[j])]
            j = j[may_link(n[i], n[j], np.abs(n[i] - n[j]), similar)]
            j = j[may_link(n[i], n[j], sketches.difference(i, j), similar)]
            if len(j):
                hit[i] = True
                hit[j] = True
        return pa.record_batch([pa.array(np.full(hit.sum(), key[0])), rows.column("doc").combine_chunks().filter(pa.array(hit))], ["region", "doc"])

    # sizes of linked sets are at most one class apart, so each set also is a guest in the next class
    step = math.log(down / up) + 1e-9

    def alive_of(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.withColumn("own", F.floor(F.log("n") / F.lit(step))).withColumn("class", F.explode(F.array("own", F.col("own") + 1)))
        rows = rows.withColumn("guest", F.col("class") > F.col("own"))
        blocks = in_blocks(rows, ["region", "class"], "doc", block_rows)
        blocks = blocks.select("region", "class", "low", "high", "doc", "n", "sketch", "outside", "guest", "block")
        return stored(map_runs(blocks, ["region", "class", "low", "high"], possible, "region long, doc long").distinct(), name)

    short = alive_of(rest, "alive-short")
    rest = stored(short.join(rest, ["region", "doc"]).drop("sketch").join(wide.withColumnRenamed("wide", "sketch"), "doc"), "rest-wide")
    alive = alive_of(rest, "alive")
    more = sets_of(docs, stored(alive.select("doc").distinct(), "alive-ids"), shingle_words, id_column, text)
    last = in_blocks(alive.join(rest.select("region", "doc", "sketch", "outside"), ["region", "doc"]), ["region"], "doc", block_rows)
    last = last.join(more, "doc").select("region", "low", "high", "doc", "sketch", "outside", "block", "shingles")

    def joined_region(key: tuple, rows: pa.Table) -> pa.RecordBatch | None:
        sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
        join = RegionJoin(sets, Sketches(rows.column("sketch").to_pylist()), rows.column("block").to_numpy(), key[1] != key[2], rows.column("outside").to_numpy(), similar)
        join.join(np.arange(len(sets)), np.arange(0))
        doc = rows.column("doc").to_numpy()
        return pa.record_batch([pa.array([doc[i] for i, _ in join.found], pa.int64()), pa.array([doc[j] for _, j in join.found], pa.int64())], ["a", "b"])

    inside = map_runs(last, ["region", "low", "high"], joined_region, "a long, b long")
    edges = checked.where("linked").select(F.col("region").alias("a"), F.col("doc").alias("b")).unionByName(inside)
    edges = edges.unionByName(members.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    components = connected_components(stored(edges, "edges"))
    out = table.select("doc_id", "n").join(components, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` whose id is the smallest of their group, with all their columns; null ids stay."""
    gone = similarity_groups(docs, id_column=id_column, **options).where("doc_id <> component_id").select(F.col("doc_id").alias(id_column)).distinct()
    return join_checked(docs, stored(gone, "gone"), [id_column], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
