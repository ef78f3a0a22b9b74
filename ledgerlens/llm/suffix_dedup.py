"""Repeated byte strings by suffix arrays that are built from groups of equal Lyndon prefixes.

The suffix array construction first sorts suffixes into groups, taking the groups in descending order: every suffix of
the group in hand points to the previous suffix of a lower group, and the suffixes pointed at are moved behind their old
group by how many point at them; at the end a group holds the suffixes with the same Lyndon prefix. A second pass over
the growing array emits each group's order: the suffixes whose next smaller suffix is the one in hand are found along
the same pointers. Nothing is renamed and no string is sorted again.

Suffix arrays are made for the contexts of one anchor at a time, in blocks of bytes aligned with the anchor, so that one
symbol stands for a block. They tell which windows may recur; windows at the edge of a match are then held against each
other byte by byte (as hashes of the whole window).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.anchors import BYTE_HASH, PrefixHash, byte_values
from ledgerlens.llm.repeats import Units, merged, recurring_spans, with_spans

BLOCK = 32
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<begin: long, end: long>>"


def suffix_groups(s: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Group of each suffix, previous suffix of a lower group (-1: none), and the groups in descending order."""
    by_symbol = defaultdict(list)
    for i, c in enumerate(s):
        by_symbol[c].append(i)
    members = [by_symbol[c] for c in sorted(by_symbol)]
    top = len(members)
    below, above = [g - 1 for g in range(top)], [g + 1 for g in range(top)]
    above[-1] = -1
    group, done, prev = [0] * len(s), [False] * top, [-1] * len(s)
    for g, inside in enumerate(members):
        for i in inside:
            group[i] = g
    order, g = [], top - 1
    while g >= 0:
        done[g] = True
        order.append(g)
        pointed: dict[int, int] = {}
        for i in members[g]:
            if group[i] != g:  # has moved on
                continue
            j = i - 1
            while j >= 0 and done[group[j]]:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        moved: dict[int, dict[int, list[int]]] = {}
        for j in sorted(pointed):
            moved.setdefault(group[j], {}).setdefault(pointed[j], []).append(j)
        for h, parts in moved.items():
            low, high = h, above[h]
            for times in sorted(parts):
                new = len(members)
                members.append(parts[times])
                done.append(False)
                below.append(low)
                above.append(high)
                above[low] = new
                if high >= 0:
                    below[high] = new
                for j in parts[times]:
                    group[j] = new
                low = new
        g = below[g]
    return group, prev, order


def suffix_array(s: list[int]) -> list[int]:
    """Suffixes of `s` in ascending order; the last symbol must be smaller than all others."""
    n = len(s)
    group, prev, order = suffix_groups(s)
    size = [0] * (max(group, default=0) + 1)
    for g in group:
        size[g] += 1
    free, at = [0] * len(size), 0
    for g in reversed(order):
        if g < len(size):
            free[g] = at
            at += size[g]
    out, placed = [0] * n, [False] * n
    if n:
        out[free[group[n - 1]]], placed[n - 1] = n - 1, True
        free[group[n - 1]] += 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = prev[j]
    return out


def longest_matches(s: list[int], array: list[int]) -> list[int]:
    """For each suffix the longest prefix it shares with any other suffix: the larger one of its two neighbours' LCPs."""
    n = len(s)
    rank = [0] * n
    for k, i in enumerate(array):
        rank[i] = k
    best, h = [0] * n, 0
    for i in range(n):
        if rank[i]:
            j = array[rank[i] - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            if h > best[i]:
                best[i] = h
            if h > best[j]:
                best[j] = h
            h -= h > 0
        else:
            h = 0
    return best


def cut_bytes(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    return [text[a:b] for a, b in spans]


def byte_units(width: int, gram: int) -> Units:
    return Units(byte_values, cut_bytes, lambda b: BYTE_HASH[np.frombuffer(b, np.uint8)], width, gram)


def may_recur(contexts: list[bytes], leads: list[int], owned: list[int], width: int, block: int) -> list[np.ndarray]:
    """Per context the window starts whose whole blocks all match those of another suffix of the group."""
    symbols: dict[bytes, int] = {}
    cuts = []
    for c, lead in zip(contexts, leads):
        shift = lead % block
        cuts.append([c[k : k + block] for k in range(shift, len(c) - block + 1, block)])
        for b in cuts[-1]:
            symbols.setdefault(b, 0)
    for k, b in enumerate(sorted(symbols)):
        symbols[b] = len(contexts) + k
    string, begins = [], []
    for k, blocks in enumerate(cuts):
        begins.append(len(string))
        string += [symbols[b] for b in blocks]
        string.append(len(contexts) - 1 - k)  # ends are all different, the last one is the smallest
    best = np.array(longest_matches(string, suffix_array(string)), np.int64)
    out = []
    for c, lead, n, begin in zip(contexts, leads, owned, begins):
        start = np.arange(n)
        shift = lead % block
        first = np.maximum(-(-(start - shift) // block), 0)
        whole = (start + width - shift) // block - first
        out.append(start[best[begin + first] >= whole])
    return out


def resolver(width: int, block: int):
    def resolve(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows of each context that are equal to another window of its group."""
        gram = table.column("gram").to_numpy()
        owned, leads = table.column("owned").to_pylist(), table.column("lead").to_pylist()
        contexts = table.column("units").to_pylist()
        edges = [0, *(np.flatnonzero(gram[1:] != gram[:-1]) + 1).tolist(), len(gram)]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(edges, edges[1:]):
            starts = may_recur(contexts[a:b], leads[a:b], owned[a:b], width, block)
            row = np.repeat(np.arange(b - a), [len(x) for x in starts])
            at = np.concatenate(starts)
            if not len(at):
                continue
            begins = np.r_[0, np.cumsum([len(c) for c in contexts[a:b]])][:-1]
            sums = PrefixHash(BYTE_HASH[np.frombuffer(b"".join(contexts[a:b]), np.uint8)])
            window = sums.spans(begins[row] + at, begins[row] + at + width)
            _, which, times = np.unique(window, return_inverse=True, return_counts=True)
            hit = np.flatnonzero(times[which] > 1)
            if len(hit):
                row, at = row[hit], at[hit]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)])
                found.append((row[new] + a, at[new], at[np.r_[new[1:], len(row)] - 1]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    return resolve


def without_repeats(
    docs: DataFrame, width: int = 400, gram: int = 64, most: int = 1000, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte ranges of every row of `docs`.

    A byte goes when a string of `width` bytes that covers it also starts at any other place, in this text or another
    one; strings do not cross texts. Null text is empty. Rows that repeat are other places, so both lose their bytes.
    Rows that share an id are told apart by their text; rows with a null id are left as they are and do not count as
    places. Other columns are ignored; an empty table gives an empty result.
    """
    spans = recurring_spans(docs, byte_units(width, gram), resolver(width, BLOCK), False, most, id_column, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, gone = t.encode(), merged(s)
                digest, at, kept = hashlib.sha256(), 0, 0
                for a, b in [*gone, (len(data), len(data))]:
                    digest.update(data[at:a])
                    kept += a - at
                    at = b
                out.append((len(data), len(data) - kept, len(gone), digest.hexdigest(), [{"begin": a, "end": b} for a, b in gone]))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    return with_spans(docs, spans, id_column, text).mapInArrow(run, RESULT)
