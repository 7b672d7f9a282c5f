"""Point sets, catalogues and directions derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import XYZ


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _float(c):
    return (c if not isinstance(c, str) else F.col(c)).cast("float")


def points(spark, sf) -> DataFrame:
    """Embedding vectors as points: label is the file, vec_id the row."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("int").alias("fnum"), F.col("vec_id").alias("row_idx"),
        *[_float(F.get(e, F.lit(i))).alias(c) for i, c in enumerate(XYZ)],
    )


def points_periodic(spark, sf) -> DataFrame:
    """The same moved into the unit box."""
    half = F.lit(0.5).cast("float")
    return points(spark, sf).withColumns({c: (F.col(c) + half).cast("float") for c in XYZ})


def halos(spark, sf, first=0) -> DataFrame:
    """Catalogue entries from three components of every vector."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("halo_file_index"), (F.col("vec_id") + 1000).alias("id"),
        *[_float(F.get(e, F.lit(first + i))).alias(c) for i, c in enumerate(XYZ)],
    )


def points_events(spark, sf) -> DataFrame:
    """Events as points (user, value, hour); files by the type's first letter."""
    return table(spark, sf, "events").select(
        F.ascii("event_type").cast("int").alias("fnum"), F.col("event_id").alias("row_idx"),
        _float("user_id").alias("px"), _float("value").alias("py"),
        _float(F.hour("ts")).alias("pz"),
    )


def points_lineitem(spark, sf) -> DataFrame:
    """Order lines as points; a few thousand positions shared by all rows."""
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("fnum"), F.col("l_orderkey").alias("row_idx"),
        _float("l_quantity").alias("px"), _float("l_discount").alias("py"),
        _float("l_tax").alias("pz"),
    )


def sky(spark, sf) -> DataFrame:
    """Directions, in double precision."""
    return points(spark, sf).select(
        F.col("row_idx").alias("id"), *[F.col(c).cast("double").alias(c[1]) for c in XYZ]
    )


def pixels(spark, sf, order: int) -> DataFrame:
    """One pixel number per order."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % (12 << 2 * order)).alias("pix")
    )
