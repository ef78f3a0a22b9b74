"""Best-fit packing of token sequences by the sum-of-squares rule.

Documents become token pieces of at most `capacity`. Pieces are dealt over groups of about `group_tokens` tokens; within
a group every piece goes where the sum, over all gaps, of the squared number of open bins with that gap becomes smallest.
Groups grow in number with the data, never in size, so each is packed in one task; a group leaves about one bin unfilled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import portions, stored

CAPACITY = 4096
END_ID = 1
FAR = np.int64(1) << 60
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", bin long, offset long"
#: The tokenizer parts a run of these from letters before it, whatever the run.
MARKS = ".,;:!?*#$%&"
#: Up to here a capital and its small letter are one character each, in every Unicode version.
LATIN = "\xff"
#: Python splits words at these too, the tokenizer does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


class WordIds(dict):
    """Token ids of a word, packed as little-endian 32-bit numbers; kept for words seen, up to `limit` of them.

    New words are encoded many at a time, as one text, and its tokens are dealt to words by where they begin.
    """

    def __init__(self, path: str, limit: int = 600_000, together: int = 100):
        from tokenizers import Tokenizer

        # "" stands for the missing tail of a word; short texts stay in the processor's cache while they are encoded
        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.together = limit, together
        vocab, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(1 + max(vocab.values(), default=0), bool)
        self.ends[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, found: set[str]) -> None:
        new = [w for w in found if w not in self]
        if len(self) + len(new) > self.limit:
            self.clear()
            self[""] = b""
            new = list(found)
        # letters are lower-cased and end where punctuation begins: most new words are known ones, written otherwise
        cores, tails, latin = [], [], []
        for w in new:
            core = w.rstrip(MARKS)
            if core.isalpha() and (small := core.lower()).isalpha():
                if core.isascii() or max(core) <= LATIN:
                    latin.append(core := small)
                cores.append(core)
                tails.append(w[len(core) :])
            else:
                cores.append(w)
                tails.append("")
        self.encode_words([p for p in dict.fromkeys(latin) if p not in self], True)
        self.encode_words([p for p in dict.fromkeys(chain(cores, tails)) if p not in self], False)
        self.update(zip(new, map(add, map(self.__getitem__, cores), map(self.__getitem__, tails))))

    def encode_words(self, words: list[str], one_each: bool) -> None:
        """`one_each`: the tokenizer takes each as one word, so that the only token that can end a word is its last."""
        for i in range(0, len(words), self.together):
            part = words[i : i + self.together]
            encoded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.asarray(encoded.ids, "<u4")
            edges = np.flatnonzero(self.ends[ids]) + 1 if one_each else ()
            if len(edges) == len(part):
                edges = np.r_[0, edges]
            else:
                begins = np.r_[0, np.cumsum([len(w) + 1 for w in part])]
                edges = np.searchsorted([o[0] for o in encoded.offsets], begins)
            data, edges = ids.tobytes(), (4 * edges).tolist()
            self.update((w, data[a:b]) for w, a, b in zip(part, edges, edges[1:]))

    def of(self, texts: list[str]) -> list[bytes]:
        """White space ends a word for this tokenizer, so a text's ids are its words' ids one after another."""
        split = [None if any(c in t for c in SEPARATORS) else t.split() for t in texts]
        self.learn(set().union(*(w for w in split if w)))
        return [self.encode(t) if w is None else b"".join(map(self.__getitem__, w)) for t, w in zip(texts, split)]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One table of words for each Python worker, whose tasks share it."""
    return WordIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document's ids followed by the end id; null text is empty (one piece with the end id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            out = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            encoded = (ids for a, b in portions(texts) for ids in ids_of.of(texts[a:b]))
            for doc, ids in zip(batch.column(0).to_pylist(), encoded):
                ids += end
                step = 4 * capacity
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_column).cast("long"), F.col(text)).mapInArrow(run, PIECES)


def sum_of_squares(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each size, in the given order.

    With `n[g]` open bins of gap g, putting `size` into gap g changes the sum of squares by 2 (n[g - size] - n[g]) + 2;
    full bins do not count, and a new bin only adds one. The smallest change wins, ties go to the smallest gap. Once the
    open gaps could hold all that is left, a new bin is opened only when nothing fits.
    """
    open_bins = np.zeros(capacity + 1, np.int64)
    by_gap: dict[int, list[int]] = {}
    left, free, bins, out = sum(sizes), 0, 0, []
    for size in sizes:
        gap = capacity
        if size < capacity:
            before, after = open_bins[size:], open_bins[: capacity - size + 1]
            change = 2 * (after - before) + 2
            change[before == 0] = FAR
            if before[0]:
                change[0] = 1 - 2 * before[0]
            if left > free:
                change[-1] = 2 * after[-1] + 1
            best = int(change.argmin())
            gap = best + size if change[best] < FAR else capacity
        if gap == capacity:
            here, bins = bins, bins + 1
            free += capacity
        else:
            here = by_gap[gap].pop()
            open_bins[gap] -= 1
        out.append((here, capacity - gap))
        if gap > size:
            by_gap.setdefault(gap - size, []).append(here)
            open_bins[gap - size] += 1
        left -= size
        free -= size
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    group_tokens: int = 1 << 25,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of `docs`.

    Empty and null texts are one piece holding the end id; longer texts are cut into full pieces and a rest. Rows that
    repeat are packed each. Other columns are ignored; an empty table gives an empty result. Equal sizes are taken in
    the order of doc_id, piece and checksum, so reruns agree up to rows that are equal.
    """
    pieces = stored(token_pieces(docs, tokenizer, capacity, id_column, text), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = -(-total // group_tokens) or 1

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        places = sum_of_squares(frame["length"].tolist(), capacity)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        frame["bin"] = np.fromiter((p[0] for p in places), np.int64, len(frame)) * groups + frame["group"]
        frame["offset"] = np.fromiter((p[1] for p in places), np.int64, len(frame))
        return frame.drop(columns="group")

    # the stored table's row number deals rows evenly whatever their ids and texts are
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    placed = dealt.groupBy("group").applyInPandas(place, PLACED)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
