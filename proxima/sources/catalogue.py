"""Text catalogues of query points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.geometry import is_periodic, wrap_position
from ..model import XYZ
from ..session import stage_table

# Column of the id and of x, y, z in each catalogue layout.
LAYOUTS = {
    "SKELETON": (0, (8, 9, 10)),
    "SUB": (1, (17, 18, 19)),
}


def parse_catalogue(lines: DataFrame, layout: str, length=None) -> DataFrame:
    """(halo_file_index, value) rows to halo_file_index, id, px, py, pz."""
    if layout not in LAYOUTS:
        raise ValueError(f"catalogue format {layout!r} not supported; known: {sorted(LAYOUTS)}")
    id_at, xyz_at = LAYOUTS[layout]
    parts = F.split(F.trim(F.col("value")), r"\s+")
    cols = {"id": F.get(parts, F.lit(id_at)).cast("bigint")}
    for name, at in zip(XYZ, xyz_at):
        value = F.get(parts, F.lit(at)).cast("float")
        cols[name] = wrap_position(value, length) if is_periodic(length) else value
    return lines.withColumns(cols).select("halo_file_index", "id", *XYZ)


def catalogue_text(lines: DataFrame) -> DataFrame:
    """The columns ``number_lines`` needs, from a text source (batch or stream)."""
    return lines.select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )


def number_lines(text: DataFrame) -> DataFrame:
    """halo_file_index, value, _file: all lines but the first of each file, in file order.

    Spark reads a text file in byte ranges; file, range and the place in the
    range order the lines. Only one count per range is numbered in one task.
    """
    # The place is written down once: a lost executor must not give rows new numbers.
    raw = stage_table(text.withColumn("_at", F.monotonically_increasing_id()), "catalogue-lines")
    # Several ranges can share a task, so blocks are ordered by start, rows by id.
    sizes = raw.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    every = Window.orderBy("_file", "_block")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_file", "_block", "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"),
        F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_in_file"),
        F.dense_rank().over(Window.orderBy("_file")).alias("_headers"),
    )
    place = F.col("_at") - F.col("_first")
    return raw.join(starts, ["_file", "_block"]).filter(F.col("_in_file") + place > 0).select(
        (F.col("_skip") + place - F.col("_headers")).alias("halo_file_index"), "value", "_file"
    )


def read_catalogue(spark: SparkSession, path: str, layout: str, length=None) -> DataFrame:
    """All rows of a file or folder but each file's header line, numbered in order."""
    lines = number_lines(catalogue_text(spark.read.text(path)))
    return parse_catalogue(lines.select("halo_file_index", "value"), layout, length)


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """halo_file_index, id, bbox_file_index, bbox_index of a box assignment file."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = number_lines(catalogue_text(spark.read.text(path)))
    names = ("id", "bbox_file_index", "bbox_index")
    return lines.select("halo_file_index", *(F.get(parts, F.lit(i)).cast("bigint").alias(n) for i, n in enumerate(names)))


def check_ids(halos: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Halos with the box columns of a sidecar, matched by place; missing or other ids are an error."""
    side = sidecar.select(
        "halo_file_index", F.col("id").alias("_id"), "bbox_file_index", "bbox_index"
    )
    joined = halos.join(side, "halo_file_index", "left")
    same = F.when(F.col("_id") == F.col("id"), F.col("id")).otherwise(
        F.raise_error(F.lit("catalogue and sidecar ids differ")).cast("bigint")
    )
    return joined.withColumn("id", same).drop("_id")


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()
