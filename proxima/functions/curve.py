"""Peano-Hilbert keys in three dimensions, as plain column expressions.

The curve is described by one base path through the eight octants and, for
each octant, the quarter turns the path takes inside it and whether it runs
backwards there. The 24 orientations of the cube and the transition table over
them are built from that description instead of being written out.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from ..model import XYZ

BITS = 15

# Position on the base path of octant (x, y, z), x slowest.
BASE_PATH = {
    (0, 0, 0): 0, (0, 0, 1): 7, (0, 1, 0): 1, (0, 1, 1): 6,
    (1, 0, 0): 3, (1, 0, 1): 4, (1, 1, 0): 2, (1, 1, 1): 5,
}
# Per position on the path, quarter turns about x and about y,
# and the sense of travel (+1 along, -1 against).
TURNS_X = (3, 0, 0, 2, 2, 0, 0, 1)
TURNS_Y = (0, 1, 1, 2, 2, 3, 3, 0)
SENSE = (-1, -1, -1, 1, 1, -1, -1, -1)

OCTANTS = tuple(product((0, 1), repeat=3))


def _turn_x(o):
    x, y, z = o
    return (x, 1 - z, y)


def _turn_y(o):
    x, y, z = o
    return (z, y, 1 - x)


@lru_cache(maxsize=1)
def transition_table() -> tuple[int, ...]:
    """``table[state * 8 + octant] = next_state * 8 + digit``.

    A state is where the cube's octants have been turned to, together with the
    sense of travel. Only states that can be reached from rest are numbered.
    """
    start = (OCTANTS, 1)
    numbers, queue, rows = {start: 0}, [start], []
    while queue:
        turned, sense = queue.pop(0)
        row = []
        for octant in turned:
            position = BASE_PATH[octant]
            nxt = turned
            for _ in range(TURNS_X[position]):
                nxt = tuple(map(_turn_x, nxt))
            for _ in range(TURNS_Y[position]):
                nxt = tuple(map(_turn_y, nxt))
            state = (nxt, sense * SENSE[position])
            if state not in numbers:
                numbers[state] = len(numbers)
                queue.append(state)
            digit = position if sense == 1 else 7 - position
            row.append(numbers[state] * 8 + digit)
        rows.append(row)
    return tuple(v for row in rows for v in row)


@lru_cache(maxsize=3)
def stride_table(width: int) -> tuple[int, ...]:
    """The transition table taken ``width`` levels at a time.

    Indexed by state and by ``width`` bits of x, y and z side by side; holds
    ``next_state << 3 * width | digits``.
    """
    single = transition_table()
    side = range(1 << width)
    out = []
    for state in range(len(single) // 8):
        for x, y, z in product(side, side, side):
            at, digits = state, 0
            for level in range(width - 1, -1, -1):
                octant = (x >> level & 1) << 2 | (y >> level & 1) << 1 | (z >> level & 1)
                entry = single[at * 8 + octant]
                at, digits = entry >> 3, digits << 3 | entry & 7
            out.append(at << 3 * width | digits)
    return tuple(out)


def _lookup(width: int) -> Column:
    # One string literal that the optimizer folds into an array literal.
    return F.split(F.lit(" ".join(map(str, stride_table(width)))), " ").cast("array<int>")


def peano_key(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """Key of an integer cell, three levels of the curve per table lookup.

    A handful of nested lookups, all inside generated code.
    """
    entry, came, at = F.lit(0), 1, bits
    key = F.lit(0).cast("long")
    while at > 0:
        width = at % 3 or 3
        at -= width
        mask = F.lit((1 << width) - 1)
        index = F.shiftright(entry, 3 * came)
        for c in (x, y, z):
            index = F.shiftleft(index, width).bitwiseOR(
                F.shiftright(c.cast("int"), at).bitwiseAND(mask)
            )
        entry, came = F.get(_lookup(width), index), width
        digits = entry.bitwiseAND(F.lit((1 << 3 * width) - 1)).cast("long")
        key = key.bitwiseOR(F.shiftleft(digits, 3 * at))
    return key


def curve_cell(p: Column, lo: Column, hi: Column, bits: int = BITS) -> Column:
    """Integer cell of a coordinate in [lo, hi]; a flat axis is cell 0."""
    n = 1 << bits
    width = (hi - lo).cast("double") / F.lit(float(n))
    cell = F.when(width > 0, ((p - lo).cast("double") / width).cast("int")).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), cell))


def with_peano_key(df: DataFrame, partition_by=(), bits: int = BITS, name="ph_key") -> DataFrame:
    """Add the key relative to the extent of the whole table or of each group.

    A group's extent is an aggregate joined back on the group's key, the whole
    table's is one row read by the driver; no group passes through one task.
    """
    keys = list(partition_by)
    bounds = [F.min(c).alias(f"_lo_{c}") for c in XYZ] + [
        F.max(c).alias(f"_hi_{c}") for c in XYZ
    ]
    if keys:
        joined = df.join(df.groupBy(*keys).agg(*bounds), keys)
        edge = {f"_{side}_{c}": F.col(f"_{side}_{c}") for c in XYZ for side in ("lo", "hi")}
    else:
        joined = df
        row = df.agg(*bounds).first().asDict()
        edge = {k: F.lit(v).cast("float") for k, v in row.items()}
    cells = [
        curve_cell(F.col(c), edge[f"_lo_{c}"], edge[f"_hi_{c}"], bits) for c in XYZ
    ]
    return joined.withColumn(name, peano_key(*cells, bits=bits)).select(*df.columns, name)


def curve_order(df: DataFrame, partition_by=(), tie=("row_idx",)) -> DataFrame:
    """Rows laid out along the curve, ready to be written in that order.

    Range partitioning spreads a crowded key over tasks; the tie columns make
    the order total.
    """
    keys = [*partition_by, "ph_key", *tie]
    return with_peano_key(df, partition_by).repartitionByRange(*keys).sortWithinPartitions(*keys)
