"""An adaptive grid for joins within a fixed distance.

Points are projected onto the directions in which they spread most; a projection never makes distances longer. Cells halve
along these directions until they hold few points or are two distances wide, so that sparse regions stay one cell. A
point is copied only to the cells within the distance of it: never to more than two along each direction, however many
cells there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.metric_tree import stack
from ledgerlens.session import write_and_read

DIRECTIONS = 3
MOST_HALVINGS = 19
SAMPLE_ROWS = 4096
SLACK = 1e-9


def hash_sample(points: DataFrame, rows: int) -> pd.DataFrame:
    """About `rows` of the points, chosen by a hash of their ids; all of them when there are fewer."""
    n = points.count()
    share = 1 << 30 if n <= rows else int((1 << 30) * rows / n)
    return points.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < share).select("vec").limit(2 * rows).toPandas()


def widest_directions(sample: np.ndarray, directions: int) -> np.ndarray:
    """Orthonormal rows: leading principal axes of the sample. Results never depend on them, only the work does."""
    dims = sample.shape[1]
    axes = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(dims, dims))[1][:, ::-1] if len(sample) > 1 else np.eye(dims)
    return np.ascontiguousarray(axes[:, : min(directions, dims)].T)


@dataclass(frozen=True)
class Grid:
    """points: id, vec, weight, at (projections), code (finest cell), cell. cells: code, cell, points_in."""

    points: DataFrame
    cells: DataFrame
    eps: float
    low: list[float]
    width: list[float]
    halvings: list[int]

    def codes_near(self) -> Column:
        """Finest cells within the distance of a point."""
        reach = self.eps * (1 + SLACK) + SLACK * max(1.0, *(abs(x) for x in self.low))
        per_direction = [F.array_distinct(F.array(self.index(i, -reach), self.index(i, reach))) for i in range(len(self.low))]
        codes = per_direction[0]
        for more in per_direction[1:]:
            codes = extended(codes, more)
        return codes

    def index(self, i: int, shift: float = 0.0) -> Column:
        return slot(F.col("at")[i] + F.lit(shift), self.low[i], self.width[i], self.halvings[i])

    def copies(self, points: DataFrame) -> DataFrame:
        """Rows of `points` (with at) once for each cell within the distance, as rows with that `cell`."""
        near = points.drop("code", "cell").withColumn("code", F.explode(self.codes_near()))
        placed = near.join(self.cells.select("code", "cell"), "code").drop("code")
        return placed.dropDuplicates(["id", "cell"])


def extended(codes: Column, more: Column) -> Column:
    """Every code followed by every further index."""
    return F.flatten(F.transform(codes, lambda c: F.transform(more, lambda x: F.shiftleft(c, MOST_HALVINGS).bitwiseOR(x))))


def slot(value: Column, low: float, width: float, halvings: int) -> Column:
    return F.least(F.greatest(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit((1 << halvings) - 1)).cast("long")


def build_grid(points: DataFrame, eps: float, cell_rows: int, directions: int = DIRECTIONS) -> Grid:
    """Deal (id, vec, weight) points into cells of about `cell_rows`, or two `eps` wide."""
    sample = hash_sample(points, SAMPLE_ROWS)
    axes = widest_directions(stack(sample["vec"]) if len(sample) else np.zeros((1, 1)), directions)
    kind = points.schema["id"].dataType.simpleString()

    def project(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(at=list(stack(pdf["vec"]) @ axes.T))

    rows = points.select("id", "vec", "weight").mapInPandas(project, f"id {kind}, vec array<double>, weight bigint, at array<double>")
    rows = write_and_read(rows, "projected")
    ends = rows.agg(*[f(F.col("at")[i]).alias(f"{n}{i}") for i in range(len(axes)) for n, f in (("low", F.min), ("high", F.max))]).first()
    low, width, halvings = [], [], []
    for i in range(len(axes)):
        a, b = ends[f"low{i}"] or 0.0, ends[f"high{i}"] or 0.0
        span = max(b - a, 0.0)
        wanted = np.log2(span / (2 * eps)) if span > 0 and eps > 0 else (MOST_HALVINGS if span > 0 else 0)
        halvings.append(int(min(MOST_HALVINGS, max(0, np.floor(wanted)))))
        low.append(a)
        width.append(span / (1 << halvings[i]) or 1.0)
    grid = Grid(rows, rows, eps, low, width, halvings)
    code = grid.index(0)
    for i in range(1, len(axes)):
        code = F.shiftleft(code, MOST_HALVINGS).bitwiseOR(grid.index(i))
    rows = rows.withColumn("code", code)
    finest = rows.groupBy("code").agg(F.count("*").alias("points_in"))
    cells = write_and_read(leaf_cells(finest, halvings, cell_rows), "cells")
    return Grid(rows.join(cells.select("code", "cell"), "code"), cells, eps, low, width, halvings)


def leaf_cells(finest: DataFrame, halvings: list[int], cell_rows: int) -> DataFrame:
    """(code, cell, points_in): for each finest cell the first cell on the way down that holds `cell_rows` points or fewer."""
    deepest = max(halvings)

    def above(level: int) -> Column:
        """The cell of this level, with the level in its upper bits."""
        out = F.lit(level).cast("long")
        for i, h in enumerate(halvings):
            mine = F.shiftright("code", MOST_HALVINGS * (len(halvings) - 1 - i)).bitwiseAND(F.lit((1 << MOST_HALVINGS) - 1))
            out = F.shiftleft(out, MOST_HALVINGS).bitwiseOR(F.shiftright(mine, h - min(level, h)))
        return out

    path = F.posexplode(F.array(*[above(level) for level in range(deepest + 1)])).alias("level", "cell")
    chain = finest.select("code", "points_in", path)
    sizes = chain.groupBy("cell").agg(F.sum("points_in").alias("cell_points"))
    fits = (F.col("cell_points") <= cell_rows) | (F.col("level") == deepest)
    first = chain.drop("points_in").join(sizes, "cell").filter(fits)
    return first.groupBy("code").agg(F.min(F.struct("level", "cell", "cell_points")).alias("c")).select("code", "c.cell", F.col("c.cell_points").alias("points_in"))
