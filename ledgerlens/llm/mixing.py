"""Mixing sources to target weights along a time-varying curriculum, with DataFrame operations only.

Each source has a weight schedule over training time 0..1, piecewise linear. Its integral up to t is the share of the
source's tokens demanded by then; the inverse gives every document the time at which its tokens are due, and documents
are range-sorted by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, stored

Schedule = Sequence[tuple[float, float]]
#: (time, weight) knots for the sources in turn: more early, more late, even.
CURRICULUM: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)))


def due_time(share: Column, schedule: Schedule) -> Column:
    """Time at which the integral of `schedule`, scaled to 1 at the end, reaches `share`."""
    pieces = list(zip(schedule, schedule[1:]))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pieces)
    done, branches = 0.0, []
    for (t0, w0), (t1, w1) in pieces:
        w0, w1 = w0 / area, w1 / area
        rest = F.greatest(share - F.lit(done), F.lit(0.0))
        under = F.greatest(F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / (t1 - t0)) * rest, F.lit(0.0))
        root = F.lit(w0) + F.sqrt(under)
        step = F.when(root > 0, F.lit(2.0) * rest / root).otherwise(F.lit(0.0))
        done += (t1 - t0) * (w0 + w1) / 2
        branches.append((done, F.least(F.lit(t0) + step, F.lit(t1))))
    last = branches.pop()[1]
    return reduce(lambda rest, b: F.when(share <= F.lit(b[0]), b[1]).otherwise(rest), reversed(branches), last)


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Per source: rank, source_size, weight and target. `sizes` has one row per source, whose number is the only bound.

    All sizes are shared by weight; a target stops at `cap` times its source's size and the excess goes to the rest by
    weight. Sources ordered by cap / weight are capped from the front, so the common level of the rest is the largest
    that any front gives.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    front = Window.orderBy("ratio", "rank")
    ranked = ranked.withColumn("ratio", F.col("most") / F.col("weight"))
    ahead = F.coalesce(F.sum("most").over(front.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(front.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    ranked = ranked.withColumn("level", (total - ahead) / open_weight)
    ranked = ranked.withColumn("level", F.max("level").over(everything))
    return ranked.withColumn("target", F.least(F.col("most"), F.col("weight") * F.col("level"))).select(
        "source", "rank", "weight", "source_size", "target"
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    cap: float = 3.0,
    curriculum: Sequence[Schedule] = CURRICULUM,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and position for every row, sorted by position.

    A source's documents stand in the order of md5(id:text) and are repeated until the target, rounded to whole words,
    is reached; the last one taken may be cut. `taken` counts words, at most `cap` times the size when `cap` is whole.
    `position` is the time at which the document's first copy is due (null if none of it is taken).
    Null text and text without words have size 0 and are not taken; null sources are one source, last in order. Rows
    equal in id, source and text are placed one after another. An empty table gives an empty result.
    The running sums are made in 4,096 hash ranges for each source, so a source with a third of all rows is spread.
    """
    key = F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    sized = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("place"),
    )
    sized = stored(sized.withColumn("part", F.substring("place", 1, 3)), "sizes")
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, cap)
    parts = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select(
        F.col("p.source").alias("source"), "part", "part_start", "rank", "source_size", "target"
    )
    rows = sized.alias("d").join(
        parts.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.part") == F.col("p.part"))
    ).select("d.doc_id", "d.source", "d.part", "d.size", "d.place", "part_start", "rank", "source_size", "target")
    inside = Window.partitionBy("source", "part").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("part_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    goal = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("goal", goal).withColumn("rounds", rounds)
    rest = F.col("goal") - F.col("rounds") * F.col("source_size") - F.col("start")
    rows = rows.withColumn("taken", F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest)))
    return rows.withColumn("position", _position(F.lit(0), curriculum)).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "position", "start", "goal", "rank", "place"
    ).orderBy(F.col("position").asc_nulls_last(), "rank", "start")


def _position(copy: Column, curriculum: Sequence[Schedule]) -> Column:
    """When copy number `copy` of a document is due."""
    middle = copy * F.col("source_size") + F.col("start") + F.col("size") / F.lit(2.0)
    share = F.least(middle / F.col("goal"), F.lit(1.0))
    kinds = [(i, due_time(share, s)) for i, s in enumerate(curriculum)]
    which = F.col("rank") % len(kinds)
    time = reduce(lambda rest, k: F.when(which == k[0], k[1]).otherwise(rest), kinds[1:], kinds[0][1])
    return F.when(F.col("taken") > F.lit(0), time)


def mixed_documents(
    docs: DataFrame, curriculum: Sequence[Schedule] = CURRICULUM, id_column: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The documents of the mix with the columns of `docs`: a row for each copy, in the order in which they are due.

    Documents come whole: one of which `mix` takes a part is taken or left, whichever is nearer (half of it is taken), so
    a source differs from its target by half a document at most. Columns may have any names. Null texts and texts without
    words are not taken; rows equal in id, source and text each get the copies of their plan's first row. An empty table
    gives an empty result.
    """
    plan = mix(docs, curriculum=curriculum, id_column=id_column, text=text, source=source, **options)
    numbers = F.struct("size", "source_size", "taken", "goal", "rank", "start")
    first = F.min_by(numbers, "start").alias("first")
    plan = plan.where("taken > 0").groupBy("doc_id", "source", "place").agg(first).select("doc_id", "source", "place", "first.*")
    # 0 to times - 1; without any there is no row
    times = F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")
    copies = F.when(times > 0, F.sequence(F.lit(0), times - 1))
    plan = plan.withColumn("copy", F.explode(copies)).withColumn("due", _position(F.col("copy"), curriculum))
    plan = plan.select("doc_id", "source", "place", "due", "copy")
    key = F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    # the user's columns in one, apart from those of the plan
    kept = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"),
        F.col(id_column).alias("id"), F.col(source).alias("origin"), key.alias("key"),
    )
    match = (F.col("key") == F.col("place")) & F.col("id").eqNullSafe(F.col("doc_id")) & F.col("origin").eqNullSafe(F.col("source"))
    return kept.join(plan, match).orderBy("due", "place", "copy").select("kept.*")
