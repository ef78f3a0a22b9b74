"""Toxicity by compression distance: two zstandard dictionaries, one for toxic and one for ordinary text.

Both begin with the same common words. The end of the toxic dictionary holds the words and word beginnings that mark toxic training texts,
the end of the ordinary one holds ordinary words of the same total length, so equal matches cost the same in both and
only marked words change a window's length. Windows of a text are compressed with both; features of the length
differences go through a logistic function calibrated on training rows that the dictionaries did not see.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import words

#: Length differences, in bytes, whose exceedances are counted.
STEPS = (2, 4, 6)
NEUTRAL = 0.0


@dataclass(frozen=True)
class CompressionModel:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    window: int = 12
    stride: int = 12
    level: int = 6

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Compressors of a model; they cannot be sent to other processes, so each task makes its own."""

    def __init__(self, model: CompressionModel):
        self.model = model
        self.ordinary, self.toxic = (
            zstd.ZstdCompressor(
                level=model.level,
                dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT),
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            ).compress
            for d in (model.ordinary, model.toxic)
        )

    def features(self, text: str) -> list[float]:
        """Largest, mean of the three largest and mean difference over all windows, and how many reach each step."""
        found, m = words(text.lower()), self.model
        if not found:
            return [NEUTRAL] * (3 + len(STEPS))
        windows = [b" ".join(found[i : i + m.window]) for i in range(0, max(len(found) - m.window + m.stride, 1), m.stride)]
        gains = sorted((len(self.ordinary(w)) - len(self.toxic(w)) for w in windows), reverse=True)
        best = gains[:3]
        counts = [math.log1p(sum(g >= s for g in gains)) for s in STEPS]
        return [gains[0], sum(best) / len(best), sum(gains) / len(gains), *counts]

    def scores(self, texts: list[str]) -> np.ndarray:
        m = self.model
        x = np.array([self.features(t) for t in texts], float).reshape(len(texts), 3 + len(STEPS))
        z = np.c_[(x - m.mean) / m.scale, np.ones(len(x))] @ m.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def contrast(toxic: list[str], ordinary: list[str], least: int = 4, lift: float = 2.0) -> tuple[dict[str, float], list[str]]:
    """Two-proportion z of the document frequency of each word and word beginning of `least` letters or more, and the
    whole words by frequency.

    A word counts in a text only if its first place there has neighbours that no earlier text of the class had, so copies,
    near copies and shared passages are one piece of evidence, not many. A word less than `lift` times as frequent in toxic
    texts gets 0: with many texts, ordinary words differ significantly when one class has more of a language."""
    frequencies, whole = [], Counter()
    for group in (toxic, ordinary):
        count: Counter[str] = Counter()
        seen: set[int] = set()
        for t in group:
            found = [w.decode() for w in words(t.lower())]
            places = {w: hash((before, w, after)) for before, w, after in reversed(list(zip(["", *found], found, [*found[1:], ""])))}
            whole.update(places.keys())
            own = {w for w, place in places.items() if place not in seen}
            seen.update(places.values())
            count.update(own.union(w[:n] for w in own for n in range(least, len(w))))
        frequencies.append(count)
    a, b = frequencies
    na, nb = max(len(toxic), 1), max(len(ordinary), 1)
    z = {}
    for w in a:
        p = (a[w] + b[w]) / (na + nb)
        spread = math.sqrt(p * (1 - p) * (1 / na + 1 / nb))
        z[w] = (a[w] / na - b[w] / nb) / spread if spread and a[w] / na >= lift * b[w] / nb else 0.0
    return z, sorted(whole, key=lambda w: (-whole[w], w))


def marking_segments(z: dict[str, float], chance: float) -> list[str]:
    """Segments whose z one of all that were tested reaches by accident with probability `chance`, strongest last; of
    segments that begin one another, the longest among those within 5 % of the strongest."""
    if not z:
        return []
    least, names = NormalDist().inv_cdf(1 - chance / len(z)), sorted(z)
    chosen: set[str] = set()
    begun: set[str] = set()  # all beginnings of the chosen ones
    for w in sorted((w for w in z if z[w] >= least), key=lambda w: (-z[w], w)):
        if w in begun or any(w[:n] in chosen for n in range(1, len(w))):
            continue
        longest, k = w, bisect_left(names, w)
        while k < len(names) and names[k].startswith(w):
            if z[names[k]] >= 0.95 * z[w]:
                longest = max(longest, names[k], key=lambda x: (len(x), x))
            k += 1
        chosen.add(longest)
        begun.update(longest[:n] for n in range(1, len(longest) + 1))
    return sorted(chosen, key=lambda w: (z[w], w))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge-regularised logistic regression by Newton steps: means, scales, weights with the constant last."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) / len(y) + ridge * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return mean, scale, w


def fit(toxic: list[str], ordinary: list[str], common_words: int = 3000, chance: float = 1e-6) -> CompressionModel:
    """Dictionaries from two thirds of each class, calibration on the last third.

    Words and word beginnings mark toxic text when their z is significant at `chance`, corrected for the number tested,
    whatever the z of others. With a class missing, all scores are the
    share of toxic rows (0 without any row).
    """
    size = 3 + len(STEPS)
    if len(toxic) < 3 or len(ordinary) < 3:
        rate = len(toxic) / max(len(toxic) + len(ordinary), 1)
        constant = math.log((rate + 1e-6) / (1 - rate + 1e-6))
        return CompressionModel(b" ", b" ", np.zeros(size), np.ones(size), np.array([0.0] * size + [constant]))
    seen = [group[: -(-len(group) * 2 // 3)] for group in (toxic, ordinary)]
    z, by_count = contrast(*seen)
    marks = marking_segments(z, chance)
    rest = [w for w in by_count if not w.startswith(tuple(marks))]
    base = " ".join(reversed(rest[:common_words])) + " "
    tail = " ".join(marks) + " "
    filler = (" ".join(rest[common_words:]) + " " + base + " " * len(tail))[: len(tail)]
    toxic_words, ordinary_words = (base + tail).encode(), (base + filler).encode()
    untrained = CompressionModel(toxic_words, ordinary_words, np.zeros(size), np.ones(size), np.zeros(size + 1))
    scorer = untrained.scorer()
    unseen = [group[len(s) :] for group, s in zip((toxic, ordinary), seen)]
    x = np.array([scorer.features(t) for group in unseen for t in group])
    y = np.repeat([1.0, 0.0], [len(g) for g in unseen])
    return CompressionModel(toxic_words, ordinary_words, *logistic(x, y))


def training_texts(
    docs: DataFrame, labels: DataFrame, toxic_rows: int, ordinary_rows: int, sample_bytes: int, id_column: str = "doc_id", text: str = "text"
) -> tuple[list[str], list[str]]:
    """Bounded sample of labelled texts whose crc32(id) mod 5 is not 0: rows with the smallest id hash in each class,
    as many as fit in `sample_bytes` characters for each class; a text too long for what is left is skipped."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    picked = None
    for label, most in ((1, toxic_rows), (0, ordinary_rows)):
        part = usable.where(F.col("toxic") == label).select("doc_id", "toxic").distinct()
        part = part.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # at most toxic_rows + ordinary_rows ids: small enough to send to every task
    match = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") <= sample_bytes)
    rows = match.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "order", "text", F.length("text").alias("n"))

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room: dict[int, int] = {}
        for batch in batches:
            kept = []
            for k, (label, n) in enumerate(zip(batch.column("toxic").to_pylist(), batch.column("n").to_pylist())):
                if n <= room.setdefault(label, sample_bytes):
                    room[label] -= n
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int64()))

    # two classes, so two tasks, of at most toxic_rows or ordinary_rows ids each
    dealt = rows.repartition(2, "toxic").sortWithinPartitions("toxic", "order", "doc_id", "text")
    rows = dealt.mapInArrow(fitting, rows.schema).orderBy("order", "doc_id", "text").collect()
    return [r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic == 0]


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    toxic_rows: int = 2000,
    ordinary_rows: int = 4000,
    sample_bytes: int = 12_000_000,
    id_column: str = "doc_id",
    text: str = "text",
    score_column: str = "toxic_score",
) -> DataFrame:
    """All columns of `docs` and `score_column` (0 to 1), from every window of the whole text.

    Only the text enters a score. Null and empty texts have no window and get the score of zero differences. Rows whose
    id is in no label row, null or repeated are scored like all others; an empty table gives an empty result. A column
    of that name is replaced. Training reads at most `toxic_rows` + `ordinary_rows` labelled rows and
    `sample_bytes` characters for each class; scoring reads everything.
    """
    model = fit(*training_texts(docs, labels, toxic_rows, ordinary_rows, sample_bytes, id_column, text))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for batch in batches:
            yield pd.Series(scorer.scores([t or "" for t in batch]))

    return docs.drop(score_column).withColumn(score_column, score(F.col(text)))


def held_out(id_column: str = "doc_id"):
    """True where crc32 of the id as text is divisible by 5; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ordinary_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of `docs` scored below `threshold`, with their columns, whatever their names.

    Null and empty texts are scored like all others, scores equal to the threshold go, an empty table gives an empty result.
    """
    score = "toxic_score"
    while score in [c.lower() for c in docs.columns]:
        score += "_"
    scored = score_documents(docs, labels, score_column=score, **options)
    return scored.where(F.col(score) < threshold).drop(score)
