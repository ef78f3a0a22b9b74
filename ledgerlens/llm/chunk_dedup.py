"""Exact duplicates by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes has `bits` leading zeros, and at least every `longest` bytes.
Equal chunks get one identifier, the SHA-256 of their bytes, so a document is the ordered list of its chunk identifiers;
only these lists (about 32 bytes for 4 KB of text) are shuffled and compared, the texts never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import joined, stored, utf8

RECIPE = "doc_id long, n_bytes long, text_sha256 string, recipe array<binary>"


def gear_table() -> np.ndarray:
    """One 32-bit value for each byte, from a multiply-and-shift rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes that end at each position."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def cut_points(data: np.ndarray, starts: np.ndarray, bits: int, longest: int) -> np.ndarray:
    """Ends of all chunks of all texts, ascending; they depend on the bytes of the own text only."""
    cuts = np.flatnonzero(rolling(data) >> np.uint32(32 - bits) == 0) + 1 if len(data) else np.zeros(0, np.int64)
    own = starts[np.searchsorted(starts, cuts, "left") - 1] if len(cuts) else cuts
    cuts = cuts[cuts - own >= 32]  # the rolling hash must not reach into the text before
    cuts = np.union1d(cuts, starts)
    gaps = np.diff(cuts)
    more = [np.arange(a + longest, a + g, longest) for a, g in zip(cuts[:-1][gaps > longest], gaps[gaps > longest])]
    return np.union1d(cuts, np.concatenate(more)) if more else cuts


def recipes(docs: DataFrame, bits: int = 12, longest: int = 1 << 16, id_column: str = "doc_id", text: str = "text", portion_bytes: int = 1 << 21) -> DataFrame:
    """One row per document: its length, digest and ordered chunk identifiers; null text counts as empty (no chunk)."""

    def portion(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, starts = utf8(batch.column(1))
        cuts = cut_points(data, starts, bits, longest)
        view = memoryview(data)
        sizes, digests, lists = [], [], []
        first = np.searchsorted(cuts, starts[:-1], "left")
        last = np.searchsorted(cuts, starts[1:], "left")
        for a, b, i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), first.tolist(), last.tolist()):
            ends = cuts[i : j + 1].tolist()
            sizes.append(b - a)
            digests.append(hashlib.sha256(view[a:b]).hexdigest())
            lists.append([hashlib.sha256(view[x:y]).digest() for x, y in zip(ends, ends[1:]) if y > x])
        return pa.record_batch(
            [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(lists, pa.list_(pa.binary()))],
            ["doc_id", "n_bytes", "text_sha256", "recipe"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch has a number of rows, not of bytes; the arrays are made for some megabytes at a time
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            filled = np.cumsum(lengths) // portion_bytes
            edges = [0, *(np.flatnonzero(filled[1:] != filled[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    yield portion(batch.slice(a, b - a))

    return docs.select(F.col(id_column), F.col(text)).mapInArrow(rows, RECIPE)


def chunk_store(docs: DataFrame, **options) -> DataFrame:
    """Distinct chunk identifiers with the number of places that use each."""
    found = recipes(docs, **options).select(F.explode("recipe").alias("chunk"))
    return found.groupBy("chunk").agg(F.count("*").alias("n_uses"))


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks for every row of `docs`.

    Of equal texts the row with the largest id stays. Null ids lose against any number; where all ids of a group are
    null, keep_id is null and the rows are kept. Rows equal in id and text are each other's copies and share a decision.
    An empty table gives an empty result; other columns are ignored.
    """
    found = stored(recipes(docs, **options), "recipes")
    groups = found.groupBy("recipe", "text_sha256").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    # a group of copies may be a third of all rows: one row of `groups` meets many, which adaptive execution splits
    same = (F.col("f.text_sha256") == F.col("g.text_sha256")) & (F.col("f.recipe") == F.col("g.recipe"))
    return found.alias("f").join(groups.alias("g"), same).select(
        "f.doc_id",
        "g.keep_id",
        "g.group_size",
        F.col("f.doc_id").eqNullSafe(F.col("g.keep_id")).alias("kept"),
        "f.text_sha256",
        F.size("f.recipe").cast("long").alias("n_chunks"),
    )


def without_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, one for each different text, with all their columns, whatever their names.

    Null texts are empty ones. Rows equal in id and text are one row; an empty table gives an empty result.
    """
    stay = exact_duplicates(docs, id_column=id_column, text=text, **options).where("kept").select("doc_id", "text_sha256")
    # the user's columns in one, apart from the digest
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept_row"),
        F.col(id_column).cast("long").alias("id"), F.sha2(joined(text), 256).alias("digest"),
    )
    match = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("text_sha256"))
    return rows.join(stay, match, "left_semi").dropDuplicates(["digest"]).select("kept_row.*")
