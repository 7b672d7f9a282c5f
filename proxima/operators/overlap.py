"""Spatial join of two sets of 3-D boxes as an ordinary equi-join.

Spark has no range-join operator, and a join on inequalities alone becomes a
nested loop over all pairs. Here each box gets a level of a cube pyramid whose
cell is at least as wide as the box, so it covers at most a few cells there.
Two boxes meet in a cell of the coarser of their two levels. Both sides emit
one row per covered cell at their own level and at the coarser levels the
other side uses; Spark then joins on (level, cell) with whatever strategy the
sizes call for. A pair is kept only in the cell that holds the lower corner of
its intersection, so no pair appears twice and nothing has to be
de-duplicated.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import boxes_touch
from ..session import stage_table

#: Cell numbers are 32-bit; only levels in use cost anything.
MAX_LEVEL = 30
#: Rows of one cell that may be shuffled to one task to learn their shares.
CELL_TASK_ROWS = 1_000_000


def _level(cols, size: float) -> Column:
    lo, hi = cols[:3], cols[3:]
    side = F.greatest(*[F.col(h).cast("double") - F.col(l).cast("double") for l, h in zip(lo, hi)])
    depth = F.floor(F.log2(F.lit(size) / side)).cast("int")
    return F.when(side <= 0, MAX_LEVEL).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(MAX_LEVEL), F.coalesce(depth, F.lit(0))))
    )


def cell_of(value: Column, origin: float, size: float, level: Column) -> Column:
    """Cell index at a level; monotone in ``value`` and clamped to the cube."""
    n = F.pow(F.lit(2.0), level)
    raw = F.floor((value.cast("double") - F.lit(origin)) / F.lit(size) * n)
    return F.greatest(F.lit(0.0), F.least(n - 1.0, raw.cast("double"))).cast("int")


def _levels_in_use(sides, size):
    """Levels each side uses; points are all at the finest, without a look."""
    found = [[MAX_LEVEL], [MAX_LEVEL]]
    asked = [
        df.select(F.lit(i).alias("side"), _level(cols, size).alias("lv"))
        for i, (df, cols) in enumerate(sides)
        if tuple(cols[:3]) != tuple(cols[3:])
    ]
    if asked:
        # At most MAX_LEVEL + 1 values a side.
        rows = reduce(DataFrame.union, asked).distinct().collect()
        for i in {r["side"] for r in rows}:
            found[i] = sorted(r["lv"] for r in rows if r["side"] == i)
    return found


def _emit(df, cols, origin, size, other_levels, tag):
    own = f"_{tag}_own"
    out = df.withColumn(own, _level(cols, size))
    coarser = F.filter(F.array(*[F.lit(v) for v in other_levels]), lambda v: v < F.col(own))
    # nothing of the other side is found at a level finer than all of its own
    levels = F.when(F.col(own) <= max(other_levels), F.array_distinct(F.array_append(coarser, F.col(own)))).otherwise(coarser)
    out = out.withColumn("_lv", F.explode(levels))
    for axis, lo, hi in zip("xyz", cols[:3], cols[3:]):
        o = origin["xyz".index(axis)]
        first = f"_{tag}_{axis}0"
        out = out.withColumn(first, cell_of(F.col(lo), o, size, F.col("_lv"))).withColumn(
            f"_c{axis}",
            F.explode(F.sequence(F.col(first), cell_of(F.col(hi), o, size, F.col("_lv")))),
        )
    return out


def _shared_out(l_rows, r_rows, l_columns, r_columns, keys, spread):
    """Both sides with the shares of their cells, from the counts of the cells that have more than ``spread`` rows.

    At most one cell for ``spread`` rows is busy, so the counts that are joined back are few. They are written
    first, so that their size is known: where it is small they are broadcast and no row is shuffled for them. Where it
    is not, rows are shuffled on their cell, those of the largest cells (at most one for ``CELL_TASK_ROWS`` rows) by a part of it.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > spread)
    busy = stage_table(count(l_rows, "_nl").join(count(r_rows, "_nr"), keys, "full"), "busy-cells")
    parts = F.ceil(F.greatest(F.coalesce("_nl", F.lit(1)), F.coalesce("_nr", F.lit(1))) / CELL_TASK_ROWS).cast("int")
    large = stage_table(busy.select(*keys, parts.alias("_parts")).where("_parts > 1"), "large-cells")
    busy = busy.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    shares = lambda n: F.ceil(F.coalesce(F.col(n), F.lit(1)) / spread).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), shares(n) - 1))
    own = lambda columns, n: F.pmod(F.xxhash64(*columns), shares(n)).cast("int")

    def counted(rows, columns):
        part = F.pmod(F.xxhash64(F.lit("part"), *columns), F.coalesce("_parts", F.lit(1))).cast("int")
        rows = rows.join(large, keys, "left").withColumn("_part", part).drop("_parts")
        return rows.join(busy, [*keys, "_part"], "left").drop("_part")

    l_rows = counted(l_rows, l_columns).withColumn("_l_share", own(l_columns, "_nl")).withColumn("_r_share", every("_nr"))
    r_rows = counted(r_rows, r_columns).withColumn("_r_share", own(r_columns, "_nr")).withColumn("_l_share", every("_nl"))
    return l_rows.drop("_nl", "_nr"), r_rows.drop("_nl", "_nr")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_box,
    right_box,
    lo,
    hi,
    spread: int = 0,
) -> DataFrame:
    """Inner join of rows whose boxes overlap or touch.

    ``left_box`` / ``right_box`` name six columns (three lower, three upper
    corners; points name their three columns twice); column names of the two
    sides must differ. ``lo`` / ``hi`` is the extent both sides are indexed
    over; boxes outside are still matched, in the outermost cells. ``spread``
    bounds what meets in one place: rows are counted by cell, and where a side has
    more than ``spread`` of them it is dealt over shares, each of which meets all shares of
    the other side. Cells below that are joined as they are.
    """
    size = max(max(h - l for l, h in zip(lo, hi)), 0.0)
    if not (size > 0 and math.isfinite(size)):
        size = 1.0
    l_levels, r_levels = _levels_in_use([(left, left_box), (right, right_box)], size)
    l_rows = _emit(left, left_box, lo, size, r_levels, "l")
    r_rows = _emit(right, right_box, lo, size, l_levels, "r")
    keys = ["_lv", "_cx", "_cy", "_cz"]
    if spread:
        l_rows, r_rows = _shared_out(l_rows, r_rows, left.columns, right.columns, keys, spread)
        keys += ["_l_share", "_r_share"]
    pairs = l_rows.join(r_rows, keys)
    meet_once = F.col("_lv") == F.least(F.col("_l_own"), F.col("_r_own"))
    for a in "xyz":
        meet_once &= F.col(f"_c{a}") == F.greatest(F.col(f"_l_{a}0"), F.col(f"_r_{a}0"))
    touch = boxes_touch(
        [F.col(c) for c in left_box[:3]],
        [F.col(c) for c in left_box[3:]],
        [F.col(c) for c in right_box[:3]],
        [F.col(c) for c in right_box[3:]],
    )
    return pairs.filter(meet_once & touch).select(*left.columns, *right.columns)


def extent_of(*sides) -> tuple[list[float], list[float]]:
    """Common extent of several (table, six box columns) sides; one row each."""
    lows, highs = [], []
    for df, cols in sides:
        row = df.agg(
            *[F.min(c).alias(f"l{i}") for i, c in enumerate(cols[:3])],
            *[F.max(c).alias(f"h{i}") for i, c in enumerate(cols[3:])],
        ).first()
        if row["l0"] is not None:
            lows.append([float(row[f"l{i}"]) for i in range(3)])
            highs.append([float(row[f"h{i}"]) for i in range(3)])
    if not lows:
        return [0.0] * 3, [1.0] * 3
    return [min(v) for v in zip(*lows)], [max(v) for v in zip(*highs)]
