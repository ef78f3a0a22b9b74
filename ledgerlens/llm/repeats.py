"""Which windows of a corpus recur, as a Spark job around a resolver for groups of similar contexts.

1. Anchors are sampled from every text; those that recur are found by counting. A filter of these turns most others away
   where they are made.
2. Rows (gram, context) of recurring anchors form classes. Equal contexts decide all their windows at once, without
   moving text; in documents that are copies of one another this settles all but the surroundings of changes.
3. One context of each class of a gram with several classes is cut from the texts, and the resolver tells which windows
   they share. A gram with more than `most` classes is split by whole windows instead, which are counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.anchors import PrefixHash, anchors
from ledgerlens.llm.common import MOST_BITS, Filter, hash_filter, join_checked, map_runs, may_hold, portions, stored

ROWS = "gram long, context long, doc long, mark int, first int, last int, lead int"
CONTEXTS = "gram long, context long, lowest long, owned int, lead int, units binary, at int, window long"


@dataclass(frozen=True)
class Units:
    """How UTF-8 texts become units: `split(texts)` gives 64-bit unit hashes laid one after another, and where texts begin;
    `cut(text, spans)` gives the bytes that stand for unit ranges of a text, `hashes` turns these into unit hashes."""

    split: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    cut: Callable[[bytes, list[tuple[int, int]]], list[bytes]]
    hashes: Callable[[bytes], np.ndarray]
    width: int
    gram: int


def numbered(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """doc, mark (a checksum, so that rows sharing an id are told apart by their text) and text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_column).cast("long").alias("doc"), F.hash(body).alias("mark"), body.alias("text"))


def anchor_rows(texts: DataFrame, units: Units, narrow: bool, known: Broadcast | None = None) -> DataFrame:
    """Anchors of all texts: gram and doc, or all of ROWS; with `known` those whose gram that filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = None if known is None else Filter(known.value)
        for batch in batches:
            doc, mark = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            texts = batch.column(2).to_pylist()
            for begin, end in portions(texts):
                values, starts = units.split([t.encode() for t in texts[begin:end]])
                for a in anchors(values, starts, units.width, units.gram):
                    row = a.row + begin
                    columns = [a.gram.view(np.int64), doc[row].astype(np.int64)]
                    if not narrow:
                        small = [x.astype(np.int32) for x in (mark[row], a.first, a.last, a.lead)]
                        columns = [columns[0], a.context.view(np.int64), columns[1], *small]
                    if allowed is not None:
                        kept = may_hold(allowed, a.gram)
                        columns = [x[kept] for x in columns]
                    yield pa.record_batch([pa.array(c) for c in columns], names)

    schema = "gram long, doc long" if narrow else ROWS
    names = [f.split()[0] for f in schema.split(", ")]
    return texts.where("doc IS NOT NULL").mapInArrow(run, schema)


def contexts_of(texts: DataFrame, wanted: DataFrame, units: Units, most: int) -> DataFrame:
    """Contexts named in `wanted` (doc, mark, gram, context, first, last, lead, lowest, classes) cut from the texts: those
    of groups up to `most` whole (at is null), the windows of the others one by one (at and window)."""
    spans = wanted.groupBy("doc", "mark").agg(F.collect_list(F.struct("gram", "context", "lowest", "first", "last", "lead", "classes")).alias("spans"))
    ids = stored(wanted.select("doc", "mark").distinct(), "context-ids")
    found = join_checked(texts, ids, ["doc", "mark"], "left_semi").join(spans, ["doc", "mark"]).select("text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            out, size = [], 0
            for text, spans in zip(batch.column(0), batch.column(1)):
                spans = spans.as_py()
                parts = units.cut(text.as_py().encode(), [(s["first"], s["last"] + units.width) for s in spans])
                for s, part in zip(spans, parts):
                    n = s["last"] - s["first"] + 1
                    if s["classes"] <= most:
                        out.append((s["gram"], s["context"], s["lowest"], n, s["lead"], part, None, None))
                        size += len(part)
                        continue
                    at = np.arange(n)
                    hashes = PrefixHash(units.hashes(part)).spans(at, at + units.width).view(np.int64)
                    out += [(s["gram"], s["context"], s["lowest"], n, s["lead"], None, k, h) for k, h in enumerate(hashes.tolist())]
                if len(out) > 20_000 or size > 1 << 23:
                    yield batch_of(out)
                    out, size = [], 0
            if out:
                yield batch_of(out)

    names = [f.split()[0] for f in CONTEXTS.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]] for f in CONTEXTS.split(", ")]
    return found.mapInArrow(cut, CONTEXTS)


def recurring_spans(
    docs: DataFrame,
    units: Units,
    resolver: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]],
    smaller_only: bool,
    most: int = 1000,
    id_column: str = "doc_id",
    text: str = "text",
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """doc, mark, spans: unit ranges of each text that are covered by recurring windows.

    A window recurs when it starts anywhere else, or with `smaller_only` in a document with a smaller id. `resolver`
    gets contexts of whole groups and returns (row, first start, last start) of runs of recurring windows.
    """
    texts = numbered(docs, id_column, text)
    if smaller_only:
        counted = anchor_rows(texts, units, True).groupBy("gram").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    else:
        counted = anchor_rows(texts, units, True).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    grams = stored(counted.select("gram"), "grams")
    rows = anchor_rows(texts, units, False, hash_filter(grams, "gram", most_bits))
    rows = stored(join_checked(rows, grams, ["gram"], "inner"), "anchors")
    classes = stored(rows.groupBy("gram", "context").agg(F.count("*").alias("count"), F.min("doc").alias("lowest")), "classes")
    several = classes.groupBy("gram").agg(F.count("*").alias("classes")).where("classes > 1")
    open_classes = classes.join(several, "gram")
    one_each = rows.join(open_classes, ["gram", "context"]).where("doc = lowest").groupBy("gram", "context").agg(
        F.min(F.struct("doc", "mark", "first", "last", "lead", "lowest", "classes")).alias("r")
    )
    found = stored(contexts_of(texts, stored(one_each.select("gram", "context", "r.*"), "wanted"), units, most), "contexts")
    contexts = found.where("at IS NULL").drop("at", "window")
    windows = found.where("at IS NOT NULL").select("gram", "context", "lowest", "at", "window").distinct()

    def resolve(_: tuple, table: pa.Table) -> pa.RecordBatch | None:
        gram, context = (table.column(c).to_numpy() for c in ("gram", "context"))
        # a row that is stored twice has its contexts twice
        table = table.filter(pa.array(np.r_[True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])]))
        row, begin, end = resolver(table)
        gram, context = (table.column(c).to_numpy()[row] for c in ("gram", "context"))
        return pa.record_batch([pa.array(gram), pa.array(context), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["gram", "context", "begin", "end"])

    hits = map_runs(contexts, ["gram"], resolve, "gram long, context long, begin int, end int", ("context",), at_least=2000)
    best = windows.groupBy("gram", "window").agg(F.min("lowest").alias("low"), F.count("*").alias("n"))
    again = windows.join(best, ["gram", "window"]).where("low < lowest" if smaller_only else "n > 1")
    hits = hits.unionByName(again.select("gram", "context", F.col("at").alias("begin"), F.col("at").alias("end")))
    # a context that occurs more than once is settled as a whole; the rest follows what the resolver found
    if smaller_only:
        whole = rows.join(classes.where("count > 1"), ["gram", "context"]).where("doc > lowest")
        part = rows.join(stored(hits, "hits"), ["gram", "context"]).join(classes.select("gram", "context", "lowest"), ["gram", "context"]).where("doc = lowest")
    else:
        whole = rows.join(classes.where("count > 1"), ["gram", "context"])
        part = rows.join(stored(hits, "hits"), ["gram", "context"])
    spans = whole.select("doc", "mark", "first", (F.col("last") + units.width).alias("end"))
    spans = spans.unionByName(part.select("doc", "mark", (F.col("first") + F.col("begin")).alias("first"), (F.col("first") + F.col("end") + units.width).alias("end")))
    return spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame, id_column: str, text: str) -> DataFrame:
    """doc, text, spans (null when nothing recurs) for every row of `docs`."""
    texts = numbered(docs, id_column, text)
    spans = stored(spans, "spans")
    ids = stored(spans.select("doc", "mark"), "span-ids")
    hit = join_checked(texts, ids, ["doc", "mark"], "left_semi").join(spans, ["doc", "mark"]).select("doc", "text", "spans")
    rest = join_checked(texts, ids, ["doc", "mark"], "left_anti")
    return hit.unionByName(rest.select("doc", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans in order, touching and overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["first"], s["end"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
