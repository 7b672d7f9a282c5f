"""Per-file spatial zone maps and the joins that use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geometry import (
    box_volume, f32, grow, is_periodic, nearest_face_distance2, periodic_pieces,
)
from ..model import BOX_COLS, XYZ
from ..session import stage_table
from .overlap import cell_of, extent_of, overlap_join

LOW, HIGH = BOX_COLS[:3], BOX_COLS[3:]
MERGE_WITHIN = 0.1
#: Rows of one cell that meet in one place; more are dealt over shares.
SPREAD_ROWS = 100_000
#: Levels of the pyramid on which entries outside all boxes look for a first box.
BOUND_LEVELS = 9


def _lo():
    return [F.col(c) for c in LOW]


def _hi():
    return [F.col(c) for c in HIGH]


def file_cells(points: DataFrame, ndiv: int) -> DataFrame:
    """Tight boxes of the non-empty cells of an ndiv^3 grid over each file.

    Columns fnum, ind, corners, np: ``ind`` numbers a file's boxes in cell
    order. A flat axis has only cell 0.
    """
    extent = points.groupBy("fnum").agg(
        *[F.min(c).alias(f"_lo_{c}") for c in XYZ], *[F.max(c).alias(f"_hi_{c}") for c in XYZ]
    )
    # Written first, so that its size is known: a small one is broadcast and the points stay where they are.
    rows = points.join(stage_table(extent, "file-extents"), "fnum")
    cell = F.lit(0)
    for c in XYZ:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        width = ((hi - lo) / F.lit(ndiv)).cast("float")
        at = ((F.col(c) - lo) / width).cast("float").cast("int")
        at = F.when(width > 0, F.greatest(F.lit(0), F.least(F.lit(ndiv - 1), at))).otherwise(0)
        cell = cell * ndiv + at
    boxes = rows.groupBy("fnum", cell.alias("_cell")).agg(
        *[F.min(c).alias(n) for c, n in zip(XYZ, LOW)],
        *[F.max(c).alias(n) for c, n in zip(XYZ, HIGH)],
        F.count("*").alias("np"),
    )
    # At most ndiv^3 rows in a window.
    index = F.row_number().over(Window.partitionBy("fnum").orderBy("_cell")) - 1
    return boxes.withColumn("ind", index.cast("int")).select("fnum", "ind", *BOX_COLS, "np")


def file_boxes(points: DataFrame, ndiv: int, length=None) -> DataFrame:
    """The zone map: a file's cells, or one box if the cells nearly fill it.

    In a periodic volume a box outside [0, length] is an error.
    """
    cells = file_cells(points, ndiv)
    whole = cells.groupBy("fnum").agg(
        *[F.min(c).alias(f"_w{c}") for c in LOW], *[F.max(c).alias(f"_w{c}") for c in HIGH],
        F.sum("np").alias("_wnp"),
        F.sum(box_volume(_lo(), _hi()).cast("double")).cast("float").alias("_sum"),
    )
    total = box_volume([F.col(f"_w{c}") for c in LOW], [F.col(f"_w{c}") for c in HIGH])
    ratio = (total / F.when(F.col("_sum") != 0, F.col("_sum"))).cast("float")
    one = F.coalesce(F.abs(ratio - 1.0) < F.lit(MERGE_WITHIN), F.lit(False))
    merged = (
        cells.join(whole, "fnum")
        .withColumn("_one", one)
        .filter(~F.col("_one") | (F.col("ind") == 0))
        .select(
            "fnum", "ind",
            *[F.when(F.col("_one"), F.col(f"_w{c}")).otherwise(F.col(c)).alias(c) for c in BOX_COLS],
            F.when(F.col("_one"), F.col("_wnp")).otherwise(F.col("np")).alias("np"),
        )
    )
    if is_periodic(length):
        inside = F.least(*_lo()) >= f32(0.0)
        inside &= F.greatest(*_hi()) <= f32(length)
        merged = merged.withColumn(
            "np",
            F.when(inside, F.col("np")).otherwise(
                F.raise_error(F.lit("all points must lie in the primary image [0, L]")).cast("bigint")
            ),
        )
    return merged


def number_boxes(boxes: DataFrame) -> DataFrame:
    """Add box_id, the position in the list ordered by (fnum, ind).

    Only one count per file, the file list itself, is numbered in one task.
    """
    per_file = boxes.groupBy("fnum").agg(F.count("*").alias("_n"))
    before = Window.orderBy("fnum").rowsBetween(Window.unboundedPreceding, -1)
    start = per_file.select("fnum", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return boxes.join(start, "fnum").withColumn(
        "box_id", (F.col("_start") + F.col("ind")).cast("bigint")
    ).drop("_start")


def decompose_periodic(boxes: DataFrame, length: float, prefix: str = "") -> DataFrame:
    """One row per part of each box inside [0, length]^3, corners replaced."""
    out = boxes
    for lo, hi in zip(LOW, HIGH):
        out = out.withColumn("_part", F.explode(periodic_pieces(F.col(lo), F.col(hi), length)))
        out = out.withColumns({lo: F.col("_part.lo"), hi: F.col("_part.hi")}).drop("_part")
    return out


def buffered_pieces(boxes: DataFrame, buffer: float, length=None) -> DataFrame:
    lo, hi = grow(_lo(), _hi(), buffer)
    grown = boxes.withColumns(dict(zip(BOX_COLS, [*lo, *hi])))
    return decompose_periodic(grown, length) if is_periodic(length) else grown


def _prefixed(df, prefix, cols):
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in cols])


def file_overlap(boxes: DataFrame, buffer: float, length=None) -> DataFrame:
    """(fnum, nbr_fnum): files whose boxes meet a file's grown boxes.

    A file always lists itself.
    """
    boxes = stage_table(boxes, "boxes")  # read several times below
    mine = _prefixed(buffered_pieces(boxes, buffer, length), "a_", ["fnum", *BOX_COLS])
    theirs = _prefixed(boxes, "b_", ["fnum", *BOX_COLS])
    a, b = [f"a_{c}" for c in BOX_COLS], [f"b_{c}" for c in BOX_COLS]
    lo, hi = extent_of((theirs, b))
    pairs = overlap_join(mine, theirs, a, b, lo, hi).select(
        F.col("a_fnum").alias("fnum"), F.col("b_fnum").alias("nbr_fnum")
    )
    own = boxes.select("fnum", F.col("fnum").alias("nbr_fnum"))
    return pairs.unionByName(own).distinct()


def buffered_read(points: DataFrame, boxes: DataFrame, buffer: float, length=None,
                  spread: int = SPREAD_ROWS) -> DataFrame:
    """For each file its own points and other files' points near its boxes.

    Columns for_fnum, own, then the point. A point that lies in several grown
    boxes of a file is returned once.
    """
    boxes = stage_table(boxes, "boxes")  # read several times below
    pieces = _prefixed(buffered_pieces(boxes, buffer, length), "a_", ["fnum", *BOX_COLS])
    a, p = [f"a_{c}" for c in BOX_COLS], [*XYZ, *XYZ]
    lo, hi = extent_of((boxes, BOX_COLS))
    near = (
        overlap_join(points, pieces, p, a, lo, hi, spread)
        .filter(F.col("a_fnum") != F.col("fnum"))
        .select(F.col("a_fnum").alias("for_fnum"), F.lit(False).alias("own"), "fnum", "row_idx", *XYZ)
        .dropDuplicates(["for_fnum", "fnum", "row_idx"])
    )
    own = points.select(
        F.col("fnum").alias("for_fnum"), F.lit(True).alias("own"), "fnum", "row_idx", *XYZ
    )
    return own.unionByName(near)


def slices_near(slices: DataFrame, spots: DataFrame, buffer: float, length=None) -> DataFrame:
    """The slices of a snapshot index that can hold a point within ``buffer`` of a spot.

    Slices meet spots by their grown boxes; slices without corners stay.
    """
    slices = stage_table(slices, "slices")
    known = slices.where(F.col("xmin").isNotNull()).select("fnum", "first", *BOX_COLS)
    pieces = _prefixed(buffered_pieces(known, buffer, length), "a_", ["fnum", "first", *BOX_COLS])
    a, lo, hi = [f"a_{c}" for c in BOX_COLS], *extent_of((known, BOX_COLS))
    met = overlap_join(spots.select(*XYZ), pieces, [*XYZ, *XYZ], a, lo, hi, SPREAD_ROWS)
    met = met.select(F.col("a_fnum").alias("fnum"), F.col("a_first").alias("first")).distinct()
    kept = slices.where(F.col("xmin").isNotNull()).join(met, ["fnum", "first"], "left_semi")
    return kept.unionByName(slices.where(F.col("xmin").isNull()))


def assign_boxes(halos: DataFrame, boxes: DataFrame, spread: int = 0) -> DataFrame:
    """The box each catalogue entry belongs to.

    Among the boxes that hold it, the largest, the first on a tie; if none
    does, the one with the nearest face. ``boxes`` needs box_id. Adds
    bbox_file_index and bbox_index to halo_file_index.

    Entries outside every box each get a bound of their own: the boxes nearest by
    cell of a cube pyramid, one for each cell that holds the middle of a box, are
    met level by level, and the closest of those is at least as far as the nearest
    face. One search within that distance settles the entry; an entry far from all boxes
    does not widen the search of the others. Entries are few beside points, so
    crowded cells are left to adaptive execution unless ``spread`` says otherwise.
    """
    # Read by several joins below.
    b = stage_table(_prefixed(boxes, "b_", ["fnum", "box_id", *BOX_COLS]), "boxes")
    bc = [f"b_{c}" for c in BOX_COLS]
    spot = halos.select("halo_file_index", *XYZ)
    lo, hi = extent_of((b, bc), (spot, [*XYZ, *XYZ]))
    b_lo, b_hi = [F.col(c) for c in bc[:3]], [F.col(c) for c in bc[3:]]

    def best(hits, rank):
        pick = F.min(F.struct(rank.alias("by"), F.col("b_box_id"), F.col("b_fnum"))).alias("_b")
        return hits.groupBy("halo_file_index").agg(pick).select(
            "halo_file_index", F.col("_b.b_fnum").alias("bbox_file_index"), F.col("_b.b_box_id").alias("bbox_index"))

    inside = overlap_join(spot, b, [*XYZ, *XYZ], bc, lo, hi, spread)
    held = stage_table(best(inside, -box_volume(b_lo, b_hi)), "box-held")
    rest = stage_table(spot.join(held, "halo_file_index", "left_anti"), "box-rest")
    d2 = nearest_face_distance2([F.col(c) for c in XYZ], b_lo, b_hi)
    size = max(h - l for l, h in zip(lo, hi)) or 1.0
    levels = F.explode(F.sequence(F.lit(0), F.lit(BOUND_LEVELS)))
    cells = lambda df, at: df.withColumn("_lv", levels).withColumns(
        {f"_c{x}": cell_of(v, o, size, F.col("_lv")) for x, v, o in zip("xyz", at, lo)})
    middle = [(low.cast("double") + high.cast("double")) / 2 for low, high in zip(b_lo, b_hi)]
    keys = ["_lv", "_cx", "_cy", "_cz"]
    # one box for each cell in use; a cell shared by very many entries is split by adaptive execution
    one = cells(b, middle).groupBy(*keys).agg(F.min(F.struct("b_box_id", *bc)).alias("_one")).select(*keys, "_one.*")
    reach = cells(rest, [F.col(c) for c in XYZ]).join(one, keys).groupBy("halo_file_index", *XYZ).agg(F.min(d2).alias("_r"))
    radius = F.sqrt(F.col("_r").cast("double")) * (1 + 1e-5) + size * 1e-7
    probe = stage_table(reach.select(
        "halo_file_index", *XYZ, *((F.col(c).cast("double") - radius).alias(f"_l{c}") for c in XYZ),
        *((F.col(c).cast("double") + radius).alias(f"_h{c}") for c in XYZ)), "box-probe")
    hits = overlap_join(probe, b, [f"_l{c}" for c in XYZ] + [f"_h{c}" for c in XYZ], bc, lo, hi, spread)
    return held.unionByName(best(hits, d2))


def grow_to_halos(boxes: DataFrame, halos: DataFrame, assigned: DataFrame) -> DataFrame:
    """Boxes stretched to cover the entries assigned to them."""
    span = (
        halos.join(assigned, "halo_file_index")
        .groupBy(F.col("bbox_index").alias("box_id"))
        .agg(*[F.min(c).alias(f"_lo_{c}") for c in XYZ], *[F.max(c).alias(f"_hi_{c}") for c in XYZ])
    )
    joined = boxes.join(span, "box_id", "left")
    return joined.withColumns({
        **{n: F.least(F.col(n), F.col(f"_lo_{c}")) for n, c in zip(LOW, XYZ)},
        **{n: F.greatest(F.col(n), F.col(f"_hi_{c}")) for n, c in zip(HIGH, XYZ)},
    }).select(*boxes.columns)


def work_units(assigned: DataFrame) -> DataFrame:
    """How many files the assigned entries fall into."""
    return assigned.agg(F.countDistinct("bbox_file_index").alias("n_files"))
