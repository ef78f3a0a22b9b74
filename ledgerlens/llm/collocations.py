"""Phrases whose words occur together more often than apart, from sorted streams of counts.

Phrases of each length are counted level by level; a phrase is counted only where the shorter ones in it are frequent.
The frequent ones are kept as streams in two orders. In prefix order a phrase stands right after its first words, in
suffix order (words reversed) right after its last ones, so that both parts of every cut, and the longer phrases that
hold a phrase, come from merge joins of neighbouring levels: nothing is looked up in a table of all phrases.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.anchors import BYTE_HASH, FACTOR, PrefixHash, scramble
from ledgerlens.llm.common import MOST_BITS, PLACES, Filter, filter_bits, filter_from, portions, put_in, stored

LONGEST = 4
LEAST = 30
COVERED = 80
BEST = 2000
SCALE = 2_000_000
SALTS = 64
UNKNOWN = "und"
SPACE, BREAK = 32, 10
# Letters A-Z become small, a tab a space; the characters that end a piece become line feeds.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else SPACE if b == 9 else BREAK if b in b".,;:!?\n\v\f\r" else b for b in range(256))


def plain(text: str) -> bytes:
    """One space between words; pieces end in line feeds."""
    out = text.encode().translate(PLAIN)
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


@dataclass
class Layout:
    """Words of texts laid one after another: bytes, begin and end of each word, its 64-bit hash, and whether the next word
    is in the same piece."""

    data: bytes
    begin: np.ndarray
    end: np.ndarray
    value: np.ndarray
    goes_on: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Layout:
        data = b"\n".join([*map(plain, texts), b""])
        values = np.frombuffer(data, np.uint8)
        edge = np.flatnonzero(np.diff(np.r_[False, (values != SPACE) & (values != BREAK), False].astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        if not len(begin):
            return cls(data, begin, end, np.zeros(0, np.uint64), np.zeros(0, bool))
        goes_on = np.r_[(begin[1:] - end[:-1] == 1) & (values[end[:-1]] == SPACE), False]
        return cls(data, begin, end, PrefixHash(BYTE_HASH[values]).spans(begin, end), goes_on)

    def hashes(self, size: int, seed: np.uint64) -> np.ndarray:
        """For each word the hash of the phrase of `size` words that starts there (as far as the words reach)."""
        out = scramble(self.value + seed)
        for k in range(1, size):
            out = scramble(out[: len(self.value) - k] * FACTOR + self.value[k:])
        return out


def seed_of(lang: str) -> np.uint64:
    return np.uint64(zlib.crc32(lang.encode()) << 20)


def filter_of(frequent: DataFrame, most_bits: int) -> Broadcast:
    """A filter of (lang, phrase, size) rows: about 16 bits for each row, never more than `most_bits`, so what is sent to
    the driver and the tasks is bounded. A full filter lets more phrases through to be counted; results stay the same."""
    bits = filter_bits(frequent.count(), most_bits)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, size = np.array(batch.column(0).to_pylist(), object), batch.column(2).to_numpy()
            for name in set(lang):
                for n in np.unique(size[lang == name]).tolist():
                    mine = batch.filter(pa.array((lang == name) & (size == n))).column(1).to_pylist()
                    words = Layout.of(mine)
                    yield put_in(words.hashes(n, seed_of(name))[::n], bits)

    return filter_from(frequent.select("lang", "phrase", "size").mapInArrow(put, PLACES), bits)


def counted(docs: DataFrame, sizes: tuple[int, ...], known: Broadcast | None, known_size: int) -> DataFrame:
    """(lang, phrase, size, a): phrases of the given sizes with their counts, if the shorter phrases of `known_size` words
    in them may be frequent. With size 1 the empty phrase counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = None if known is None else Filter(known.value)
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_lang: dict[str, list[str]] = {}
            for lang, t in zip(langs, texts):
                by_lang.setdefault(lang, []).append(t)
            for lang, mine in by_lang.items():
                for a, b in portions(mine, 1 << 20):
                    yield from phrases_of(Layout.of(mine[a:b]), lang, allowed)

    def phrases_of(words: Layout, lang: str, allowed: Filter | None) -> Iterator[pa.RecordBatch]:
        n, seed = len(words.begin), seed_of(lang)
        ok = np.ones(n, bool) if allowed is None else np.r_[allowed.has(words.hashes(known_size, seed)), np.zeros(known_size - 1, bool)][:n]
        for size in sizes:
            if n < size:
                continue
            good = np.ones(n - size + 1, bool)
            for k in range(size - 1):
                good &= words.goes_on[k : k + len(good)]
            for k in range(size - known_size + 1 if allowed else 0):
                good &= ok[k : k + len(good)]
            at = np.flatnonzero(good)
            _, first, count = np.unique(words.hashes(size, seed)[at], return_index=True, return_counts=True)
            first = at[first]
            phrase = pa.array([words.data[x:y] for x, y in zip(words.begin[first].tolist(), words.end[first + size - 1].tolist())], pa.binary()).cast(pa.string())
            yield batch_of(lang, phrase, size, pa.array(count, pa.int64()))
        if 1 in sizes and n:
            yield batch_of(lang, pa.array([""]), 0, pa.array([n], pa.int64()))

    def batch_of(lang: str, phrase: pa.Array, size: int, count: pa.Array) -> pa.RecordBatch:
        return pa.record_batch([pa.array([lang] * len(phrase), pa.string()), phrase, pa.array(np.full(len(phrase), size, np.int32)), count], ["lang", "phrase", "size", "a"])

    return docs.mapInArrow(run, "lang string, phrase string, size int, a long").groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a"))


def frequent_phrases(docs: DataFrame, least: int, longest: int, most_bits: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and the frequent phrases of 1 to `longest` words, a table for each length."""
    words = stored(counted(docs, (1,), None, 0).where((F.col("a") >= least) | (F.col("size") == 0)), "words")
    levels = [words.where("size = 1")]
    if longest > 1:
        levels.append(stored(counted(docs, (2,), filter_of(levels[0], most_bits), 1).where(F.col("a") >= least), "pairs"))
    if longest > 2:
        more = stored(counted(docs, tuple(range(3, longest + 1)), filter_of(levels[1], most_bits), 2).where(F.col("a") >= least), "longer")
        levels += [more.where(F.col("size") == k) for k in range(3, longest + 1)]
    return words.where("size = 0").select("lang", F.col("a").alias("n")), levels


def cut_counts(levels: list[DataFrame], last: bool) -> DataFrame:
    """(lang, phrase, cuts): for each phrase of two words or more, how often its first (or with `last` its last) words occur,
    by the place of the cut. Each level meets the one below in the order that both share."""
    out, below = None, levels[0].select("lang", "phrase", "a", F.array().cast("array<bigint>").alias("cuts"))
    for size in range(2, len(levels) + 1):
        part = F.substring_index("phrase", " ", (1 - size) if last else (size - 1)).alias("part")
        shorter = below.select("lang", F.col("phrase").alias("part"), F.col("a").alias("part_a"), F.col("cuts").alias("part_cuts"))
        rows = levels[size - 1].select("lang", "phrase", "a", part).hint("merge").join(shorter, ["lang", "part"])
        one = F.array("part_a")
        below = stored(rows.select("lang", "phrase", "a", (F.concat(one, "part_cuts") if last else F.concat("part_cuts", one)).alias("cuts")), "suffix-order" if last else "prefix-order")
        out = below if out is None else out.unionByName(below)
    return out


def collocations(
    docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, best: int = BEST, text: str = "text", lang: str = "lang", most_bits: int = MOST_BITS
) -> DataFrame:
    """The `best` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a counts the phrase, l and r the parts of its weakest cut, n all words of the language, score is
    floor(2,000,000 a / (l + r)). A phrase inside a longer candidate that has `covered` percent of its count or more is left
    out; it is enough to look at candidates one word longer, since none inside those is rarer. Ties in score go by count,
    then by phrase in byte order. Null texts are empty, a null language is `und`, repeated rows count as often as they
    are there, other columns are not looked at; an empty table, or one without frequent phrases, gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    totals, levels = frequent_phrases(rows, least, longest, most_bits)
    counts = levels[1]
    for level in levels[2:]:
        counts = counts.unionByName(level)
    prefix, suffix = cut_counts(levels, False), cut_counts(levels, True)
    found = counts.join(prefix.select("lang", "phrase", F.col("cuts").alias("ls")).hint("merge"), ["lang", "phrase"]).join(suffix.select("lang", "phrase", F.col("cuts").alias("rs")).hint("merge"), ["lang", "phrase"])
    score = lambda c: F.expr(f"CAST(a AS DECIMAL(20, 0)) * {SCALE} div CAST({c}.l + {c}.r AS DECIMAL(20, 0))")
    cuts = F.transform(F.arrays_zip("ls", "rs"), lambda c, i: F.struct(c["ls"].alias("l"), c["rs"].alias("r"), (i + 1).alias("k")))
    found = found.select("lang", "phrase", "size", "a", "ls", "rs", F.explode(cuts).alias("cut"))
    found = stored(
        found.withColumn("score", score("cut"))
        .groupBy("lang", "phrase", "size", "a")
        .agg(F.min(F.struct("score", "cut.k", "cut.l", "cut.r")).alias("cut"), F.max(F.element_at("ls", -1)).alias("left_a"), F.max(F.col("rs")[0]).alias("right_a")),
        "candidates",
    )
    longer = found.where("size > 2")
    holds = lambda sub: F.lit(100) * F.col("a") >= F.lit(covered) * F.col(sub)
    inside = longer.where(holds("left_a")).select("lang", F.expr("substring_index(phrase, ' ', size - 1)").alias("phrase"))
    inside = inside.unionByName(longer.where(holds("right_a")).select("lang", F.expr("substring_index(phrase, ' ', 1 - size)").alias("phrase"))).distinct()
    left = found.join(inside.hint("merge"), ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each share of a language first, so that no task gets all its phrases
    share = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    left = left.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= best)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
