"""Scalar geometry on point and box columns, kept in 32-bit floats.

Every helper takes Columns and Python numbers and returns a Column, so the
expressions stay inside whole-stage code generation. Literals are cast to
float on purpose: Spark would otherwise widen the arithmetic to double and
change both values and ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

AXES = ("x", "y", "z")


def f32(value) -> Column:
    return F.lit(float(value)).cast("float")


def wrap_position(p: Column, length: float) -> Column:
    """Move a coordinate into [0, length], keeping both end points."""
    full = F.lit(float(length))
    rest = F.pmod(p.cast("double"), full)
    moved = F.when((rest == 0.0) & (p > 0), full).otherwise(rest)
    return F.when((p >= 0) & (p <= full), p).otherwise(moved.cast("float")).cast("float")


def axis_separation(a: Column, b: Column, length: float | None = None) -> Column:
    """Distance along one axis; shortest way round when a period is given."""
    d = F.abs(a - b)
    if not is_periodic(length):
        return d
    return F.when(d > f32(length / 2.0), f32(length) - d).otherwise(d)


def is_periodic(length: float | None) -> bool:
    return length is not None and length > 0


def squared_distance(a, b, length: float | None = None) -> Column:
    """Squared separation of two (x, y, z) column triples, x then y then z."""
    dx, dy, dz = (axis_separation(i, j, length) for i, j in zip(a, b))
    return dx * dx + dy * dy + dz * dz


def box_volume(lo, hi) -> Column:
    return (hi[0] - lo[0]) * (hi[1] - lo[1]) * (hi[2] - lo[2])


def grow(lo, hi, by):
    """Box corners moved outwards by ``by`` on every side."""
    by = by if isinstance(by, Column) else f32(by)
    return [c - by for c in lo], [c + by for c in hi]


def boxes_touch(lo_a, hi_a, lo_b, hi_b) -> Column:
    """Overlap test with closed sides: boxes that only touch count."""
    tests = [(la <= hb) & (lb <= ha) for la, ha, lb, hb in zip(lo_a, hi_a, lo_b, hi_b)]
    return reduce(Column.__and__, tests)


def point_in_box(p, lo, hi) -> Column:
    return reduce(Column.__and__, [(l <= c) & (c <= h) for c, l, h in zip(p, lo, hi)])


def periodic_pieces(lo: Column, hi: Column, length: float) -> Column:
    """Cut one side of a box into its parts inside [0, length].

    Returns ARRAY<STRUCT<lo, hi>>. The side is first moved by whole periods so
    that its upper end lies in (0, length]; whatever then sticks out below zero
    re-enters at the top. Axes are independent, so the parts of a box are the
    product of the parts of its three sides.
    """
    full, zero = f32(length), f32(0.0)
    turns = (F.ceil(hi.cast("double") / F.lit(float(length))) - 1).cast("float")
    top = hi - turns * full
    bottom = lo - turns * full
    wraps = F.ceil(-bottom.cast("double") / F.lit(float(length))).cast("int")

    def part(a, b):
        return F.struct(a.cast("float").alias("lo"), b.cast("float").alias("hi"))

    return F.when(bottom >= zero, F.array(part(bottom, top))).otherwise(
        F.concat(
            F.array(part(zero, top)),
            F.array_repeat(part(zero, full), wraps - 1),
            F.array(part(bottom + wraps.cast("float") * full, full)),
        )
    )


def side_holds(p: Column, lo: Column, hi: Column, length: float) -> Column:
    return F.exists(
        periodic_pieces(lo, hi, length), lambda s: (s["lo"] <= p) & (p <= s["hi"])
    )


def point_in_grown_box(p, lo, hi, buffer, length: float | None = None) -> Column:
    """Inclusive containment in a box with a margin, round the period if any."""
    lo, hi = grow(lo, hi, buffer)
    if not is_periodic(length):
        return point_in_box(p, lo, hi)
    inside = [
        F.when((l >= f32(0.0)) & (h <= f32(length)), (l <= c) & (c <= h)).otherwise(
            side_holds(c, l, h, length)
        )
        for c, l, h in zip(p, lo, hi)
    ]
    return reduce(Column.__and__, inside)


def grown_boxes_touch(lo_a, hi_a, lo_b, hi_b, buffer_a, buffer_b, length=None) -> Column:
    """Overlap of two boxes, each with its own margin, round the period if any."""
    lo_a, hi_a = grow(lo_a, hi_a, buffer_a)
    lo_b, hi_b = grow(lo_b, hi_b, buffer_b)
    if not is_periodic(length):
        return boxes_touch(lo_a, hi_a, lo_b, hi_b)

    def sides_touch(la, ha, lb, hb):
        return F.exists(
            periodic_pieces(la, ha, length),
            lambda s: F.exists(
                periodic_pieces(lb, hb, length),
                lambda t: (s["lo"] <= t["hi"]) & (t["lo"] <= s["hi"]),
            ),
        )

    return reduce(
        Column.__and__, [sides_touch(*side) for side in zip(lo_a, hi_a, lo_b, hi_b)]
    )


def nearest_face_distance2(p, lo, hi) -> Column:
    """Squared distance from a point to the surface of a box. Not periodic.

    Outside, the gaps of the axes add up; inside, the least depth counts.
    """
    gaps = [F.greatest(l - c, c - h, f32(0.0)) for c, l, h in zip(p, lo, hi)]
    depth = F.least(*(F.least(c - l, h - c) for c, l, h in zip(p, lo, hi)))
    return F.when(F.greatest(*gaps) > 0, square_sum(gaps)).otherwise(depth * depth)


def axis_gap(lo_a, hi_a, lo_b, hi_b, length: float | None = None) -> Column:
    """Smallest separation of two intervals, in double precision."""
    la, ha, lb, hb = (c.cast("double") for c in (lo_a, hi_a, lo_b, hi_b))
    zero = F.lit(0.0)
    if not is_periodic(length):
        return F.greatest(lb - ha, la - hb, zero)
    per = F.lit(float(length))
    return F.greatest(
        F.least(
            F.greatest(lb - ha, la - hb),
            F.greatest(lb + per - ha, la - hb - per),
            F.greatest(lb - per - ha, la - hb + per),
        ),
        zero,
    )


def axis_reach(lo_a, hi_a, lo_b, hi_b, length: float | None = None) -> Column:
    """Largest separation of two intervals (an upper bound when periodic)."""
    la, ha, lb, hb = (c.cast("double") for c in (lo_a, hi_a, lo_b, hi_b))
    far = F.greatest(hb - la, ha - lb)
    return F.least(far, F.lit(length / 2.0)) if is_periodic(length) else far


def square_sum(terms) -> Column:
    terms = list(terms)
    return reduce(Column.__add__, [t * t for t in terms])
