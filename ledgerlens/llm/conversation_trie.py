"""The prefix trie of conversations: which turn sequences are shared, by how many, and what sharing them saves.

Conversations become rows of a padded matrix of turn ids. Rows are sorted by range over the cluster, cut into blocks of
neighbours, and each block finds its nodes at all depths at once: a node starts where any column up to its depth changes.
Nodes at the edge of a block may go on in the next one; only these are put together afterwards. Long conversations are
cut into bands of 64 turns, so that no row of the matrix grows with a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, stored

BAND = 64
GROUP = 1024
FAMILY = 20
HEADS = 4
BLOCK_ROWS = 10_000
PAD = np.iinfo(np.int64).min
NODE = "ka long, kb long, depth long, pa long, pb long, parent long, open boolean, low long, n long, words long, children long, leaves long, saved long, first long, ends string, sha string"
NODE_NAMES = [f.split()[0] for f in NODE.split(", ")]


def crc32_of(number: Column) -> Column:
    return F.crc32(number.cast("string").cast("binary"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, at, a, b, words): the place of each turn in its conversation from 1, two hashes of role and text, and the words
    of the text.

    Rows are numbered within range partitions, and the one conversation that a partition may have begun before goes on
    from the counts of the partitions before it, so a very long conversation is spread over many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    keys = ["conv", F.col("turn").asc_nulls_first(), "a", "b", "row"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            start = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            at = np.arange(1, len(conv) + 1) - np.repeat(start, np.diff(np.r_[start, len(conv)]))
            if conv[0] == last:
                at[: start[1] if len(start) > 1 else len(conv)] += seen
            last, seen = conv[-1], at[-1]
            yield pa.record_batch([pa.array(np.full(len(conv), part)), batch.column(0), pa.array(at), *(batch.column(i) for i in (2, 3, 4))], ["part", "conv", "at", "a", "b", "words"])

    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "a", "b", "words")
    placed = stored(sorted_rows.mapInArrow(count, "part long, conv long, at long, a long, b long, words long"), "turns")
    # one row for each partition: its last conversation and how many turns of it the partition holds
    last = placed.groupBy("part").agg(F.max(F.struct("conv", "at")).alias("l"), F.min("conv").alias("first")).select("part", "l.*", "first")
    before, tail, count_before = [], None, 0
    for r in sorted(last.collect()):
        if tail == r.first:
            before.append((r.part, r.first, count_before))
        count_before = r.at + (count_before if tail == r.conv == r.first else 0)
        tail = r.conv
    if not before:
        return placed.drop("part")
    shift = placed.sparkSession.createDataFrame(before, "part long, conv long, before long")
    return placed.join(F.broadcast(shift), ["part", "conv"], "left").select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "a", "b", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, total, at, a, b, words): turns of the rebuilt conversations, and one row with at = 0 for each conversation."""
    placed = numbered_turns(turns)
    base = F.col("conv") - F.col("conv") % FAMILY
    heads = placed.where((F.col("conv") % FAMILY == 0) & (F.col("at") < HEADS)).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "a", "b", "words"))).alias("head"))
    convs = placed.groupBy("conv").agg(F.count("*").alias("own")).select("conv", "own", base.alias("base"), (crc32_of(F.col("conv")) % HEADS).alias("h"))
    convs = convs.join(heads.withColumnRenamed("conv", "base"), "base", "left")
    convs = convs.withColumn("head", F.coalesce(F.filter("head", lambda t: t["at"] <= F.col("h")), F.array().cast(heads.schema["head"].dataType)))
    convs = stored(
        convs.select("conv", "h", "head", (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")), "conversations"
    )
    mark = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("words"))
    front = convs.select("conv", "total", F.explode(F.concat(F.array(mark), F.col("head"))).alias("t")).select("conv", "total", "t.*")
    rest = placed.join(convs.select("conv", "total", "h", F.size("head").alias("taken")), "conv").where("at > h")
    return front.unionByName(rest.select("conv", "total", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "a", "b", "words"))


def bands(turns: DataFrame, band: int, group: int) -> DataFrame:
    """(band, ta, tb, ids, words, conv, total): `band` turns of a conversation in a row, below the node (ta, tb).

    A turn's id depends on its place; the ids of a sequence, joined by XOR, name the node at its end.
    """
    za, zb = (F.xxhash64(F.lit(k), "a", "b", "at") for k in (3, 4))
    turn = F.when(F.col("at") > 0, F.struct("at", za.alias("za"), zb.alias("zb"), "words"))
    rows = turns.groupBy("conv", "total", F.floor(F.greatest(F.col("at") - 1, F.lit(0)) / band).alias("band")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    rows = rows.select("conv", "total", "band", F.flatten(F.transform("turns", lambda t: F.array(t["za"], t["zb"]))).alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words"))
    short = rows.where(F.col("total") <= band).withColumns({"ta": F.lit(0).cast("long"), "tb": F.lit(0).cast("long")})
    long = stored(rows.where(F.col("total") > band).withColumn("group", F.floor(F.col("band") / group)), "long-conversations")
    half = lambda k: F.aggregate(F.filter("ids", lambda x, i: i % 2 == k), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))
    ends = long.select("conv", "group", "band", half(0).alias("xa"), half(1).alias("xb"))
    # names of the nodes above: running XOR over groups of bands, then over the bands of a group
    before = lambda w, c: F.coalesce(F.bit_xor(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    over_groups, over_bands = Window.partitionBy("conv").orderBy("group"), Window.partitionBy("conv", "group").orderBy("band")
    groups = ends.groupBy("conv", "group").agg(F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"))
    groups = groups.select("conv", "group", before(over_groups, "xa").alias("ga"), before(over_groups, "xb").alias("gb"))
    inside = ends.select("conv", "group", "band", before(over_bands, "xa").alias("ia"), before(over_bands, "xb").alias("ib"))
    tops = inside.join(groups, ["conv", "group"]).select("conv", "band", F.col("ia").bitwiseXOR(F.col("ga")).alias("ta"), F.col("ib").bitwiseXOR(F.col("gb")).alias("tb"))
    return short.unionByName(long.drop("group").join(tops, ["conv", "band"])).select("band", "ta", "tb", "ids", "words", "conv", "total")


def block_nodes(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """Nodes (or, at the edges, parts of nodes) of one block of neighbouring rows; columns as NODE."""
    band, ta, tb, conv, total = (batch.column(i).to_numpy() for i in (0, 1, 2, 5, 6))
    n = len(band)
    lists = batch.column(4)
    length = np.diff(lists.offsets.to_numpy())
    deep = int(length.max(initial=0))
    valid = np.arange(deep) < length[:, None]
    ids = np.full((n, deep, 2), PAD, np.int64)
    ids[valid] = batch.column(3).flatten().to_numpy().reshape(-1, 2)
    words = np.zeros((n, deep + 1), np.int64)
    words[:, 1:][valid] = lists.flatten().to_numpy()
    order = np.lexsort((conv, total > (band + 1) * width, *ids.reshape(n, -1).T[::-1], tb, ta, band))
    band, ta, tb, conv, total, ids, words, valid = (x[order] for x in (band, ta, tb, conv, total, ids, words, valid))
    # column 0 is the node above the band
    valid = np.c_[np.ones(n, bool), valid]
    change = np.ones((n, deep + 1), bool)
    change[1:, 0] = (band[1:] != band[:-1]) | (ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])
    change[1:, 1:] = (ids[1:] != ids[:-1]).any(2) | (valid[1:, 1:] != valid[:-1, 1:])
    change = np.logical_or.accumulate(change, 1)
    key = np.stack([np.c_[ta, ids[:, :, 0]], np.c_[tb, ids[:, :, 1]]], 2)
    key = np.bitwise_xor.accumulate(key, 1)
    depth0 = band * width
    out = []
    below = dict(start=np.zeros(n, bool), open=np.zeros(n, bool), leaves=np.zeros(n, np.int64), saved=np.zeros(n, np.int64))
    later: tuple | None = None
    for d in range(deep, -1, -1):
        start = np.flatnonzero(change[:, d])
        end = np.r_[start[1:], n]
        at = valid[start, d]
        add = lambda x: np.add.reduceat(x, start)  # noqa: E731, B023
        children, leaves, saved = add((below["start"] & ~below["open"]).astype(np.int64)), add(below["leaves"]), add(below["saved"])
        low, size = np.minimum.reduceat(conv, start), end - start
        depth = depth0[start] + d
        edge = (start == 0) | (end == n) | np.logical_or.reduceat(below["open"], start)
        edge |= (d == 0) | ((d == width) & (np.maximum.reduceat(total, start) > depth))
        # what this node adds to the one above, unless it is still open
        leaf = (children == 0) & ~edge
        leaves = leaves + leaf
        saved = saved + np.where(edge, 0, (size - 1) * words[start, d])
        if later is not None:
            # nodes one deeper now know the node above them
            above = np.searchsorted(start, later[0], "right") - 1
            later[1]["parent"] = np.where(edge[above], 0, low[above])
            later[1]["has"] = ~edge[above]
            later[1]["pa"], later[1]["pb"] = key[start[above], d, 0], key[start[above], d, 1]
            out.append(later[1])
        again = (d == 0) & (band[start] > 0)  # counted by the band above
        # conversations that end here are the first rows of the node, in order of their ids
        done = add((total == depth0 + d).astype(np.int64)) * ~again
        ends = [conv[s : s + k] for s, k in zip(start.tolist(), done.tolist())]
        keep = np.flatnonzero(at)
        node = dict(ka=key[start, d, 0], kb=key[start, d, 1], depth=depth, pa=0 * low, pb=0 * low, parent=0 * low, has=np.zeros(len(start), bool), open=edge, low=np.where(again, np.iinfo(np.int64).max, low), n=np.where(again, 0, size), words=words[start, d], children=children, leaves=leaves, saved=saved)
        node["first"] = np.array([e[0] if len(e) else np.iinfo(np.int64).max for e in ends], np.int64)
        node = {k: v[keep] for k, v in node.items()}
        texts = [",".join(map(str, ends[i].tolist())) for i in keep.tolist()]
        node["ends"] = [t if o and t else None for t, o in zip(texts, node["open"].tolist())]
        node["sha"] = [None if o else hashlib.sha256(t.encode()).hexdigest() for t, o in zip(texts, node["open"].tolist())]
        later = (start[keep], node)
        rows = start[keep]
        below = dict(start=np.zeros(n, bool), open=np.zeros(n, bool), leaves=np.zeros(n, np.int64), saved=np.zeros(n, np.int64))
        below["start"][rows], below["open"][rows] = True, edge[keep]
        # sums of closed nodes; what lies below an open one is passed up when that one is put together
        shut = ~edge[keep]
        below["leaves"][rows[shut]], below["saved"][rows[shut]] = leaves[keep][shut], saved[keep][shut]
    out.append(later[1])
    columns = []
    kinds = dict(zip(NODE_NAMES, (f.split()[1] for f in NODE.split(", "))))
    for c, kind in kinds.items():
        if kind == "string":
            columns.append(pa.array([x for node in out for x in node[c]], pa.string()))
        elif c == "parent":
            value, has = np.concatenate([node[c] for node in out]), np.concatenate([node["has"] for node in out])
            columns.append(pa.array(value, pa.int64(), mask=~has))
        else:
            columns.append(pa.array(np.concatenate([node[c] for node in out]), pa.bool_() if kind == "boolean" else pa.int64()))
    return pa.record_batch(columns, NODE_NAMES)


def put_together(parts: DataFrame) -> DataFrame:
    """One row for each open node from its parts, which pass in order of their ids; `sha` is made as they pass by."""
    names = [c for c in NODE_NAMES if c not in ("parent", "open", "first", "ends")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        digest, any_ends, done = hashlib.sha256(), False, []

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[c] for r in rows], pa.string() if c == "sha" else pa.int64()) for c in names], names)

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or (r["ka"], r["kb"], r["depth"]) != (now["ka"], now["kb"], now["depth"]):
                    if now is not None:
                        done.append(now | {"sha": digest.hexdigest()})
                    now, digest, any_ends = {c: r[c] for c in names}, hashlib.sha256(), False
                else:
                    for c in ("n", "children", "leaves", "saved"):
                        now[c] += r[c]
                    now["low"], now["words"] = min(now["low"], r["low"]), max(now["words"], r["words"])
                    if r["n"]:
                        now["pa"], now["pb"] = r["pa"], r["pb"]
                if r["ends"]:
                    digest.update(("," if any_ends else "").encode() + r["ends"].encode())
                    any_ends = True
            if len(done) > 10_000:
                yield batch_of(done)
                done = []
        if now is not None:
            done.append(now | {"sha": digest.hexdigest()})
        if done:
            yield batch_of(done)

    kinds = dict(f.split() for f in NODE.split(", "))
    rows = parts.repartition("ka", "kb", "depth").sortWithinPartitions("ka", "kb", "depth", F.col("n") == 0, "first")
    return rows.mapInArrow(fold, ", ".join(f"{c} {kinds[c]}" for c in names))


def subtree_sums(nodes: DataFrame, deepest: int) -> DataFrame:
    """Adds to each open node what the open nodes below it have: after round i, all within 2^i levels are counted."""
    sums = nodes.select("ka", "kb", "depth", F.col("pa").alias("ua"), F.col("pb").alias("ub"), (F.col("depth") - 1).alias("to"), "leaves", "saved")
    reach = 1
    while reach <= deepest:
        sums = stored(sums, "subtrees")
        gained = sums.where("to >= 0").groupBy(F.col("ua").alias("ka"), F.col("ub").alias("kb"), F.col("to").alias("depth")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
        up = sums.select(F.col("ka").alias("ua"), F.col("kb").alias("ub"), F.col("depth").alias("to"), F.col("ua").alias("va"), F.col("ub").alias("vb"), F.col("to").alias("then"))
        sums = (
            sums.join(gained, ["ka", "kb", "depth"], "left")
            .join(up, ["ua", "ub", "to"], "left")
            .select("ka", "kb", "depth", F.col("va").alias("ua"), F.col("vb").alias("ub"), F.coalesce("then", F.lit(-1)).alias("to"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        )
        reach *= 2
    return sums.select("ka", "kb", "depth", "leaves", "saved")


def prefix_trie(turns: DataFrame, *, band: int = BAND, group: int = GROUP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, named by its smallest member and its depth: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` has conv_id, turn, role and text; other columns are not looked at. Turns are ordered by turn, null first;
    turns that tie are ordered by hashes of role and text, the same way in each run. Null roles and texts are empty,
    repeated rows are repeated turns, rows without a conv_id belong to no conversation. An empty table has no node, not
    even a root. Sequences are equal when their 128-bit hashes are. `ends_sha256` of a node that many conversations end
    in is fed by one task as their ids pass by; nothing is gathered for it.
    """
    # of conversations that fill a band, those that end with it come first
    keys = ["band", "ta", "tb", "ids", F.col("total") > (F.col("band") + 1) * band, "conv"]
    rows = bands(rebuilt(turns), band, group).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                yield block_nodes(batch.slice(at, block_rows), band)

    nodes = stored(rows.mapInArrow(blocks, NODE), "trie-blocks")
    merged = stored(put_together(nodes.where("open")), "trie-edges")
    kids = merged.groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("kids"))
    opened = merged.join(kids, ["ka", "kb", "depth"], "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0))).drop("kids")
    opened = opened.withColumn("leaves", F.col("leaves") + (F.col("children") == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("words"))
    opened = stored(opened, "trie-open")
    deepest = opened.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first().d
    summed = opened.drop("leaves", "saved").join(subtree_sums(opened, deepest), ["ka", "kb", "depth"])
    names = opened.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), (F.col("depth") + 1).alias("depth"), F.col("low").alias("parent"))
    columns = ["low", "depth", "parent", "n", "children", "leaves", "saved", "sha"]
    closed = nodes.where("NOT open")
    found = (
        closed.where("parent IS NOT NULL").select(columns)
        .unionByName(closed.where("parent IS NULL").drop("parent").join(names, ["pa", "pb", "depth"]).select(columns))
        .unionByName(summed.join(names, ["pa", "pb", "depth"], "left").select(columns))
    )
    return found.toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
