"""Repeated passages by prefix-partitioned suffix trees over words.

Suffixes are split by what they have in common: windows around the same anchor form a group, and a group too large for
memory is split by a longer prefix, the whole window. In each group the suffixes that begin where a window begins are
sorted; neighbours with a common prefix of `width` words or more hang below one deep internal node of the group's suffix
tree, a repeat, and the smallest document below the node keeps its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.anchors import word_values
from ledgerlens.llm.common import words
from ledgerlens.llm.repeats import Units, merged, recurring_spans, with_spans

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<begin: long, end: long>>"


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    values, _ = word_values([text])
    return [values[a:b].tobytes() for a, b in spans]


def word_units(width: int, gram: int) -> Units:
    return Units(word_values, cut_words, lambda b: np.frombuffer(b, np.uint64), width, gram)


def deep_nodes(group: np.ndarray, suffixes: np.ndarray, width: int) -> np.ndarray:
    """Number of the topmost node of depth `width` or more above each suffix in its group's suffix tree.

    `suffixes` has a row for each suffix with its first words; the sorted order and the common prefixes of neighbours
    are the tree: a node of depth d is a run of neighbours that agree in d words.
    """
    order = np.lexsort([*suffixes.T[::-1], group])
    ordered, own = suffixes[order], group[order]
    common = np.cumprod(ordered[1:] == ordered[:-1], axis=1).sum(1) * (own[1:] == own[:-1])
    node = np.zeros(len(order), np.int64)
    node[order] = np.r_[0, np.cumsum(common < width)]
    return node


def resolver(width: int):
    def resolve(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of each context that also start in a context with a smaller lowest document."""
        owned = table.column("owned").to_numpy().astype(np.int64)
        units = [np.frombuffer(b, np.uint64) for b in table.column("units").to_pylist()]
        begins = np.r_[0, np.cumsum([len(u) for u in units])][:-1]
        flat = np.concatenate(units)
        row = np.repeat(np.arange(len(units)), owned)
        at = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(owned)[:-1]], owned)
        suffixes = flat[(begins[row] + at)[:, None] + np.arange(width)]
        node = deep_nodes(table.column("gram").to_numpy()[row], suffixes, width)
        lowest = table.column("lowest").to_numpy()[row]
        best = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, node, lowest)
        hit = np.flatnonzero(best[node] < lowest)
        return row[hit], at[hit], at[hit]

    return resolve


def without_repeats(
    docs: DataFrame, width: int = 13, gram: int = 5, most: int = 1000, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed word ranges of every row of `docs`.

    A word goes when a window of `width` words that covers it also starts in a document with a smaller id. Null and
    empty texts have no words. Rows that share an id do not remove from one another; rows with a null id neither lose
    words nor make others lose any. Other columns are ignored; an empty table gives an empty result.
    """
    spans = recurring_spans(docs, word_units(width, gram), resolver(width), True, most, id_column, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found, gone = words(t), merged(s)
                kept, at = [], 0
                for a, b in gone:
                    kept += found[at:a]
                    at = b
                kept += found[at:]
                digest = hashlib.sha256(b" ".join(kept)).hexdigest()
                out.append((len(found), len(found) - len(kept), digest, [{"begin": a, "end": b} for a, b in gone]))
            n, removed, digest, gone = zip(*out) if out else ((), (), (), ())
            ranges = pa.array(gone, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), ranges], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"]
    return with_spans(docs, spans, id_column, text).mapInArrow(run, RESULT)
