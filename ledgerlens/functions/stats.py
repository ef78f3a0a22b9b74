"""Statistics that stay exact and distributed on large columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import write_and_read

SKETCH_ACCURACY = 10_000
MARGINS = 5
BINS = 1024
LARGEST = 1.7976931348623157e308


def usable(c: Column) -> Column:
    """As double, with NaN treated as missing."""
    value = c.cast("double")
    return F.when(~F.isnan(value), value)


def tidy(df: DataFrame, columns: Sequence[str], keep_missing: bool = False) -> DataFrame:
    """(feature, value) rows of the numbers."""
    cells = [F.struct(F.lit(c).alias("feature"), usable(F.col(c)).alias("value")) for c in columns]
    rows = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    return rows if keep_missing else rows.filter("value IS NOT NULL")


def _bin(bins: int) -> Column:
    """Number of the bin of a value in the interval low..high; it never falls as values rise. Both ends have a bin of their
    own; between them bins are even, on a log scale where all is positive."""
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    first, last = F.greatest(low, F.lit(-LARGEST)), F.least(high, F.lit(LARGEST))
    even = F.try_divide(value / 2 - first / 2, last / 2 - first / 2)
    scaled = F.when((low > 0) & (last / 4 > low), F.try_divide(F.log(value) - F.log(low), F.log(last) - F.log(low))).otherwise(even)
    inside = F.least(F.greatest(F.floor(scaled * (bins - 2)), F.lit(0)), F.lit(bins - 3)) + 1
    return F.when(value == low, 0).when(value == high, bins - 1).otherwise(F.coalesce(inside, F.lit(1))).cast("double")


def select_ranks(
    values: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[float, Callable[[Column], Column]]], *, accuracy: int = SKETCH_ACCURACY, bins: int = BINS
) -> DataFrame:
    """(keys, n, name, value): for each group of `keys` the value at each wanted rank, exactly.

    `wanted` names a probability near the rank and the rank itself (from 0) as a function of the group's size. A small
    sketch proposes an interval for each rank. Then, round by round, values are counted below, above and in bins of the
    interval, and the part that holds the rank becomes the next interval, until it is a single value. An interval of no
    more values than bins has a part for each value. A proposal that misses costs a round, nothing else; one path serves
    every size. Counts combine in the map tasks, so a group of any size is spread over all tasks, and no task sees more
    than its parts. `values` (keys and a double column `value` without nulls) is read once for the sketch and once for
    each round, so it should be stored. A null key is a group. Each row also has the group's size n.
    """
    keys = list(keys)
    margin = MARGINS / accuracy
    ends = [end for p, _ in wanted.values() for end in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = values.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile_approx("value", ends, accuracy).alias("points")
    )
    # a margin of a rank or two would miss neighbours
    few = (F.col("n") <= bins) | (F.col("n") * margin < 2)
    states = [
        F.struct(
            F.lit(name).alias("name"),
            rank(F.col("n")).cast("bigint").alias("rank"),
            F.when(few, F.col("least")).otherwise(F.col("points")[2 * i]).alias("low"),
            F.when(few, F.col("most")).otherwise(F.col("points")[2 * i + 1]).alias("high"),
            F.when(few, F.col("n")).otherwise(F.ceil(F.col("n") * (2 * margin + 2 / accuracy))).alias("inside"),
        )
        for i, (name, (_, rank)) in enumerate(wanted.items())
    ]
    states = write_and_read(sketch.select(*keys, "n", F.explode(F.array(*states)).alias("s")).select(*keys, "n", "s.*"), "ranks")
    found = None
    while True:
        # ranks often share an interval, so intervals meet the values and ranks meet the counts
        mine, same = [F.col(k).alias(f"_{k}") for k in keys], reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        intervals = states.select(*mine, "low", "high", "inside").distinct()
        value = F.col("value")
        zone = F.when(value < F.col("low"), -1).when(value > F.col("high"), 1).otherwise(0)
        # a part for each value where they are few
        part = F.when(zone != 0, 0.0).when(F.col("inside") <= bins, value).otherwise(_bin(bins))
        parts = (
            values.join(intervals, same)
            .groupBy(*keys, "low", "high", zone.alias("zone"), part.alias("part"))
            .agg(F.count("*").alias("count"), F.min("value").alias("least"), F.max("value").alias("most"))
        )
        # about bins + 2 rows in a window
        order = Window.partitionBy(*keys, "low", "high").orderBy("zone", "part")
        upto = parts.withColumn("upto", F.sum("count").over(order))
        ranks = states.select(*mine, "n", "name", "rank", F.col("low").alias("_low"), F.col("high").alias("_high"))
        holds = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("count"))
        met = upto.join(ranks, same & (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high")) & holds)
        columns = [*keys, "n", "name", "rank", F.col("least").alias("low"), F.col("most").alias("high"), F.col("count").alias("inside")]
        states = write_and_read(met.select(*columns), "ranks")
        done = states.filter("low = high").select(*keys, "n", "name", F.col("low").alias("value"))
        found = done if found is None else found.unionByName(done)
        states = states.filter("low < high")
        if states.isEmpty():
            return found


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], *, bins: int = BINS) -> DataFrame:
    """Linearly interpolated quantiles as (feature, probability, quantile) rows; the columns are stored once and read in
    every round of `select_ranks`. Missing values and NaN do not count; a column without values has no rows."""
    wide = write_and_read(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]), "quantile-columns")
    values = tidy(wide, wide.columns)
    places = [(i, float(p)) for i, p in enumerate(probabilities)]
    wanted = {}
    for i, p in places:
        wanted[f"{i}_lo"] = (p, _rank_below(p))
        wanted[f"{i}_hi"] = (p, _rank_above(p))
    picked = select_ranks(values, ["feature"], wanted, bins=bins)
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    rows = picked.groupBy("feature", "n").agg(*[at(name).alias(name) for name in wanted])
    quantiles = []
    for i, p in places:
        position = F.lit(p) * (F.col("n") - 1)
        share = position - F.floor(position)
        # ends of equal value stay as they are, infinite ones too
        between = F.when(F.col(f"{i}_lo") == F.col(f"{i}_hi"), F.col(f"{i}_lo")).otherwise(F.col(f"{i}_lo") * (1.0 - share) + F.col(f"{i}_hi") * share)
        quantiles.append(F.struct(F.lit(p).alias("probability"), between.alias("quantile")))
    names = F.array(*[F.lit(c) for c in columns])
    column = F.get(names, F.substring("feature", 2, 10).cast("int"))
    return rows.select(column.alias("feature"), F.explode(F.array(*quantiles)).alias("q")).select("feature", "q.*")


def _rank_below(p: float) -> Callable[[Column], Column]:
    return lambda n: F.floor(F.lit(p) * (n - 1))


def _rank_above(p: float) -> Callable[[Column], Column]:
    return lambda n: F.least(F.floor(F.lit(p) * (n - 1)) + 1, n - 1)


def discrete_quantiles(df: DataFrame, keys: Sequence[str], value: Column, probabilities: dict[str, float]) -> DataFrame:
    """A row for each group with a column for each named probability: the smallest value that at least this share of the
    group's values does not exceed. Groups without values are left out."""
    rows = df.select(*keys, usable(value).alias("value")).filter("value IS NOT NULL")
    grouped = list(keys) or ["_all"]
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    wanted = {name: (p, _rank_within(p)) for name, p in probabilities.items()}
    picked = select_ranks(write_and_read(rows, "quantile-values"), grouped, wanted)
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    return picked.groupBy(*grouped).agg(*[at(name).alias(name) for name in probabilities]).select(*keys, *probabilities)


def _rank_within(p: float) -> Callable[[Column], Column]:
    return lambda n: F.greatest(F.ceil(F.lit(p) * n), F.lit(1)) - 1


def pick(quantiles: DataFrame, feature: str, probability: float) -> Column:
    """Aggregate expression taking one quantile out of `exact_quantiles` rows."""
    wanted = (F.col("feature") == feature) & (F.col("probability") == float(probability))
    return F.max(F.when(wanted, F.col("quantile")))


def quantile_row(df: DataFrame, columns: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    """One row with a column `<column>_<name>` for every column and named probability."""
    rows = exact_quantiles(df, columns, list(probabilities.values()))
    return rows.agg(
        *[pick(rows, c, p).alias(f"{c}_{name}") for c in columns for name, p in probabilities.items()]
    )


def as_struct(one_row: DataFrame) -> Column:
    """A one-row frame as a scalar struct expression."""
    return one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns]).alias("row")).scalar()


def attach(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Add a one-row frame as a struct column.

    Reading many fields of the column keeps one subquery in the plan, where many `as_struct` expressions would each be
    planned anew.
    """
    return df.withColumn(name, as_struct(one_row))


def sample_skewness(c: Column) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1.0)) / (n - 2))


def sample_kurtosis(c: Column) -> Column:
    n = F.count(c)
    return F.when(n > 3, ((n + 1.0) * F.kurtosis(c) + 6) * (n - 1) / ((n - 2.0) * (n - 3)))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over the value range as (bin, lower, upper, count); the last bin includes the maximum."""
    values = df.select(usable(F.col(column)).alias("value")).filter("value IS NOT NULL")
    limits = as_struct(values.agg(F.min("value").alias("low"), F.max("value").alias("high")))
    placed = values.select("value", limits.alias("limits")).select(
        "value", F.col("limits.low").alias("low"), F.col("limits.high").alias("high")
    )
    width = (F.col("high") - F.col("low")) / bins
    index = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("value") - F.col("low")) / width), F.lit(bins - 1)))
    return (
        placed.groupBy(F.coalesce(index, F.lit(0)).cast("int").alias("bin"), "low", "high")
        .agg(F.count("*").alias("count"))
        .select(
            "bin",
            (F.col("low") + F.col("bin") * width).alias("lower"),
            (F.col("low") + (F.col("bin") + 1) * width).alias("upper"),
            "count",
        )
    )
