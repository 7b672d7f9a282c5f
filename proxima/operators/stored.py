"""A block table that is built once and asked many times.

Points that stay the same while catalogues come in chunks need not be blocked
anew for every chunk. ``store_blocks`` writes, below one folder,

* ``blocks``: the folded positions, in a folder for each range of the curve,
* ``extents``: one row per block with its corners and counts,
* ``pyramid``: for each cell of a cube pyramid that holds the middle of a block
  the box around those blocks, how many points they hold and the heaviest of them,
* ``about``: one row, written last, so that a table without it is unfinished.

A chunk's entries are answered in three steps. The pyramid gives each position
a distance within which enough points lie, and a block near it. That block's own
points make the distance a close one. Units of entries with the same block and about the same
distance then meet the extents they reach and are shown the points of those blocks.
Only the ranges of the curve that hold a block which is shown are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geometry import axis_gap, axis_reach, is_periodic, square_sum
from ..model import XYZ
from ..session import stage_table, staged_path
from .knn import (
    BLOCK_ROWS, GHOST_ROWS, PARTITION_ROWS, SLACK, _at_positions, _bounds, _by_shares, _cols, _dealt, _finish, _grown,
    _search, _survey, cut_blocks, wrap_points,
)
from .overlap import cell_of, overlap_join

#: Folders of the block table, about; more partitions share a folder.
MOST_RANGES = 4096
#: Levels of the pyramid below its root.
LEVELS = 10
#: The partition a block was cut in stands above this bit of its number.
PART_BIT = 40
CELL = ["_lv", "_cx", "_cy", "_cz"]


@dataclass(frozen=True)
class StoredBlocks:
    """An open block table; ``lo`` and ``hi`` are the corners of all points, None if there are none."""

    path: str
    spark: SparkSession
    rows: int
    length: float | None
    lo: list[float] | None
    hi: list[float] | None
    range_bits: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def shown(self, links: DataFrame) -> DataFrame:
        """The block rows of the ranges that ``links`` name; at most one value a range comes to the driver."""
        ranges = [r[0] for r in links.select(F.shiftright("b", self.range_bits)).distinct().collect()]
        none = F.lit(0).cast("bigint")
        return self.table("blocks").where(F.col("range").isin(ranges)).select(
            "block", *XYZ, "nd", none.alias("nq"), none.alias("ia"), none.alias("ib"), F.lit(0).cast("float").alias("bound2"))


def _in_cells(df: DataFrame, middle, lo, hi) -> DataFrame:
    size = max(h - l for l, h in zip(lo, hi)) or 1.0
    out = df.withColumn("_lv", F.explode(F.sequence(F.lit(1), F.lit(LEVELS))))
    return out.withColumns({name: cell_of(v, o, size, F.col("_lv")) for name, v, o in zip(CELL[1:], middle, lo)})


def _ready(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/about/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def store_blocks(points: DataFrame, path: str | None = None, length=None, block_rows: int = BLOCK_ROWS) -> StoredBlocks:
    """Write the block table of ``points``; without a path it is staged. Points without a place are left out."""
    spark = points.sparkSession
    path = (path or staged_path(spark, "block-table")).rstrip("/")
    length = float(length) if is_periodic(length) else None
    points = wrap_points(points, length).dropna(subset=list(XYZ))
    total, lo, hi = survey = _survey([points])
    none = F.lit(0).cast("bigint")
    positions = points.groupBy(*XYZ).agg(F.count("*").alias("nd")).select(
        *XYZ, "nd", none.alias("nq"), none.alias("ia"), none.alias("ib"))
    bits = PART_BIT + (total // PARTITION_ROWS // MOST_RANGES).bit_length()
    cut_blocks(positions, survey, 0, length, block_rows).select(
        F.shiftright("block", bits).alias("range"), "block", *XYZ, "nd"
    ).write.mode("overwrite").partitionBy("range").parquet(f"{path}/blocks")
    blocks = spark.read.schema("block bigint, px float, py float, pz float, nd bigint, range bigint").parquet(f"{path}/blocks")
    blocks.groupBy("block").agg(
        *_bounds("d", F.lit(True)), F.sum("nd").alias("weight"), F.count("*").alias("rows"),
    ).write.mode("overwrite").parquet(f"{path}/extents")
    extents = spark.read.parquet(f"{path}/extents")
    middle = [(F.col(a).cast("double") + F.col(b).cast("double")) / 2 for a, b in zip(_cols("d")[:3], _cols("d")[3:])]
    _in_cells(extents, middle, lo, hi).groupBy(*CELL).agg(
        *[F.min(c).alias(c) for c in _cols("d")[:3]], *[F.max(c).alias(c) for c in _cols("d")[3:]],
        F.sum("weight").alias("weight"), F.max(F.struct("weight", "block"))["block"].alias("home"),
    ).write.mode("overwrite").parquet(f"{path}/pyramid")
    about = spark.range(1).select(
        F.lit(total).cast("bigint").alias("rows"), F.lit(length).cast("double").alias("length"), F.lit(bits).alias("range_bits"),
        F.array(*map(F.lit, lo)).alias("lo"), F.array(*map(F.lit, hi)).alias("hi"))
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return open_blocks(spark, path)


def open_blocks(spark: SparkSession, path: str) -> StoredBlocks | None:
    """The block table in a folder, or None if there is no finished one."""
    path = path.rstrip("/")
    if not _ready(spark, path):
        return None
    row = spark.read.parquet(f"{path}/about").first()
    some = row["rows"] > 0
    return StoredBlocks(path, spark, row["rows"], row["length"], list(row["lo"]) if some else None,
                        list(row["hi"]) if some else None, row["range_bits"])


def _units(asked: DataFrame, names: list[str], block_rows: int) -> DataFrame:
    """Name the unit each position asks in: at most about ``block_rows`` positions that agree in ``names``."""
    crowded = asked.groupBy(*names).agg(F.ceil(F.count("*") / F.lit(block_rows)).alias("_n")).where("_n > 1")
    part = F.pmod(F.xxhash64(*XYZ), F.coalesce("_n", F.lit(1)))
    return asked.join(crowded, names, "left").withColumn("a", F.concat_ws(":", *names, part)).drop("_n")


def _asking(units: DataFrame) -> DataFrame:
    none = F.lit(0).cast("bigint")
    return units.select("a", *XYZ, none.alias("nd"), "nq", none.alias("ia"), none.alias("ib"), "bound2")


def stored_distances(spots: DataFrame, stored: StoredBlocks, n: int, max_radius=None, block_rows: int = BLOCK_ROWS,
                     ghost_rows: int = GHOST_ROWS) -> DataFrame:
    """Squared distances at ranks 1, n and n + 1 of ``spots(px, py, pz, nq)``, distinct places of a non-empty table."""
    per, lo, hi = stored.length, stored.lo, stored.hi
    scale = per or max(abs(v) for v in (*lo, *hi))
    spot = [F.col(c) for c in XYZ]

    def farthest(corners_lo, corners_hi):
        return F.sqrt(square_sum(axis_reach(p, p, a, b, per) for p, a, b in zip(spot, corners_lo, corners_hi)))

    # enough points lie within the box of any cell that holds more than n; no point lies beyond the box of all
    pyramid = stored.table("pyramid").where(F.col("weight") > n)
    cell = F.when(F.col("home").isNotNull(), F.struct(
        farthest([F.col(c) for c in _cols("d")[:3]], [F.col(c) for c in _cols("d")[3:]]).alias("reach"), "home"))
    met = _in_cells(spots, spot, lo, hi).join(pyramid, CELL, "left").groupBy(*XYZ).agg(
        F.first("nq").alias("nq"), F.min(cell).alias("best"))
    everything = farthest([F.lit(v).cast("float") for v in lo], [F.lit(v).cast("float") for v in hi])
    reach = F.least(F.col("best.reach"), everything) * F.lit(SLACK) + F.lit(1e-6 * scale)
    if max_radius is not None:
        reach = F.least(reach, F.lit(float(max_radius) * SLACK))
    asked = stage_table(met.select(
        *XYZ, "nq", F.col("best.home").alias("home"), (reach * reach).cast("float").alias("bound2")), "asked")

    # the points of the block nearby
    units = _units(asked.where(F.col("home").isNotNull()), ["home"], block_rows)
    first = stage_table(units.groupBy("a", F.col("home").alias("b")).agg(*_bounds("q", F.lit(True))).select(
        "a", "b", *_cols("q"), F.lit(float("inf")).alias("reach"), F.lit(0).alias("share")), "first-links")
    close = _search(stored.shown(first), _asking(units).withColumn("share", F.lit(0)), first, n, per, False, False)
    bounded = asked.join(close.select(*XYZ, "next_r2"), list(XYZ), "left").withColumn(
        "bound2", F.least("bound2", "next_r2")).drop("next_r2")

    # all blocks within that distance; a unit's distances differ by less than half
    band = F.coalesce(F.floor(F.log2("bound2")).cast("int"), F.lit(-999))
    units = stage_table(_units(bounded.withColumns({
        "home": F.coalesce("home", F.lit(-1)), "band": band}), ["home", "band"], block_rows), "units")
    ask = stage_table(units.groupBy("a").agg(
        *_bounds("q", F.lit(True)),
        (F.sqrt(F.max("bound2").cast("double")) * F.lit(SLACK) + F.lit(1e-6 * scale)).alias("reach")), "unit-extents")
    have = stored.table("extents").select(F.col("block").alias("b"), *_cols("d"), "rows")
    corners = zip(*[[F.col(c) for c in names] for names in (_cols("q")[:3], _cols("q")[3:], _cols("d")[:3], _cols("d")[3:])])
    gap2 = square_sum(axis_gap(a, b, c, d, per) for a, b, c, d in corners)
    extent = ([0.0] * 3, [per] * 3) if per else (lo, hi)
    pairs = overlap_join(_grown(ask, per, scale), have, _cols("g"), _cols("d"), *extent).filter(
        gap2 <= F.col("reach") * F.col("reach")).select("a", "b", "reach", "rows", *_cols("q"))
    links, heavy = _dealt(stage_table(pairs.dropDuplicates(["a", "b"]) if per else pairs, "unit-links"), ghost_rows)
    return _by_shares(stored.shown(links), _asking(units), links, heavy, n, per, False, False)


def rnn_halos_stored(halos: DataFrame, stored: StoredBlocks, n: int, max_radius=None, strict=False,
                     block_rows: int = BLOCK_ROWS, ghost_rows: int = GHOST_ROWS) -> DataFrame:
    """``rnn_halos`` against a stored block table; the period is the table's.

    Entries without a place, and all entries of an empty table, are uncertified.
    """
    halos = wrap_points(halos, stored.length)
    out = ["halo_file_index", "id", "rnn", "certified"]
    unplaced = F.lit(stored.lo is None)
    for c in XYZ:
        unplaced |= F.col(c).isNull() | F.isnan(c)
    lost = _finish(halos.where(unplaced), F.lit(None).cast("double"), max_radius, strict).select(*out)
    if stored.lo is None:
        return lost
    placed = halos.where(~unplaced)
    spots = stage_table(placed.groupBy(*XYZ).agg(F.count("*").alias("nq")), "spots")
    found = stored_distances(spots, stored, n, max_radius, block_rows, ghost_rows)
    r2 = F.when(F.col("first_r2") == F.lit(0).cast("float"), F.col("next_r2")).otherwise(F.col("nth_r2"))
    found = _finish(found, r2, max_radius, strict).select(*XYZ, "rnn", "certified")
    return _at_positions(placed, found, spots).select(*out).unionByName(lost)
