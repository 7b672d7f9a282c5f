"""Schemas of the tables the engine works on."""

from pyspark.sql import types as T

XYZ = ("px", "py", "pz")

POINTS = T.StructType([
    T.StructField("fnum", T.IntegerType()),
    T.StructField("row_idx", T.LongType()),
    T.StructField("px", T.FloatType()),
    T.StructField("py", T.FloatType()),
    T.StructField("pz", T.FloatType()),
])

HALOS = T.StructType([
    T.StructField("halo_file_index", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("px", T.FloatType()),
    T.StructField("py", T.FloatType()),
    T.StructField("pz", T.FloatType()),
])

BOX_COLS = ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")

BOXES = T.StructType(
    [T.StructField("fnum", T.IntegerType()), T.StructField("ind", T.IntegerType())]
    + [T.StructField(c, T.FloatType()) for c in BOX_COLS]
    + [T.StructField("np", T.LongType())]
)
