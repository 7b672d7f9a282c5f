"""Binary particle snapshots as a Spark data source.

``spark.read.format("snapshot").option("dialect", "LGADGET").load(list_file)``
gives (fnum, row_idx, px, py, pz). ``list_file`` names one snapshot per line;
its line number is ``fnum``. Tasks read the headers and write a table of slices, byte
ranges of positions; each partition of the scan then reads one slice and
nothing else, so a large file is shared by many tasks. More layouts can be
added to ``DIALECTS``.

Files are not opened in vain. ``index_snapshot`` adds the corners of every slice, kept as
Parquet. ``read_points`` takes files and ranges of positions and drops slices
before the scan is planned; ``slices_near`` and ``slices_of`` prune the table of slices
by a join, for jobs that know what they need. (The Python data source's own filter
push-down is not used: Spark 4.1 keeps pushed filters with the table, and another query on
the same DataFrame would be answered from the wrong slices.)
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import BOX_COLS, POINTS, XYZ
from ..session import ship, stage_table

ROWS_PER_PARTITION = 4_000_000
BATCH = 262_144

# File layouts, little-endian.
GADGET_HEADER = np.dtype([
    ("npart", "<u4", 6), ("mass", "<f8", 6), ("time", "<f8"), ("redshift", "<f8"),
    ("flag_sfr", "<i4"), ("flag_feedback", "<i4"), ("npartTotal", "<u4", 6),
    ("flag_cooling", "<i4"), ("num_files", "<i4"), ("BoxSize", "<f8"), ("Omega0", "<f8"),
    ("OmegaLambda", "<f8"), ("HubbleParam", "<f8"), ("flag_stellarage", "<i4"),
    ("flag_metals", "<i4"), ("hashtabsize", "<i4"), ("npartTotalHighWord", "<u4", 6),
    ("fill", "V60"),
])
SKY_HEADER = np.dtype([
    ("npart", "<u8"), ("nside", "<u4"), ("filenside", "<u4"), ("rmin", "<f4"), ("rmax", "<f4"),
    ("npartrad", "<u8"), ("BoxSize", "<f4"), ("pad", "V4"), ("mass", "<f8"), ("Omega0", "<f8"),
    ("OmegaLambda", "<f8"), ("HubbleParam", "<f8"),
])
MARKER = 4
COUNTED_TYPES = 5  # the sixth particle type is not part of the point set


@dataclass
class FileInfo:
    """What a header says: rows, where positions start, period, wrap, nside."""

    rows: int
    offset: int
    period: float
    wrap: float
    file_nside: int


def open_input(path: str):
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


def _exactly(f, n: int, path: str) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError(f"{path}: file ends early")
    return data


def _gadget(f, path, periodic):
    raw = _exactly(f, 2 * MARKER + GADGET_HEADER.itemsize, path)
    head = np.frombuffer(raw, GADGET_HEADER, 1, MARKER)[0]
    rows = int(head["npart"][:COUNTED_TYPES].sum(dtype=np.int64))
    offset = 3 * MARKER + GADGET_HEADER.itemsize
    box = float(head["BoxSize"])
    return FileInfo(rows, offset, float(np.float32(box)) if periodic else -1.0,
                    box if periodic else 0.0, 0)


def read_lgadget(f, path):
    return _gadget(f, path, True)


def read_lgadget_cone(f, path):
    return _gadget(f, path, False)


def read_sky_cone(f, path):
    head = np.frombuffer(_exactly(f, SKY_HEADER.itemsize, path), SKY_HEADER, 1)[0]
    order = max(int(head["nside"]).bit_length() - 1, 0)
    index = 8 * (12 << 2 * order)
    return FileInfo(int(head["npart"]), SKY_HEADER.itemsize + index, -1.0, 0.0,
                    int(head["filenside"]))


DIALECTS = {
    "LGADGET": read_lgadget,
    "LGADGETLC": read_lgadget_cone,
    "LGADGETBCCLC": read_sky_cone,
}


def file_info(path: str, dialect: str) -> FileInfo:
    if dialect not in DIALECTS:
        raise ValueError(f"unknown simulation type {dialect!r}; known: {sorted(DIALECTS)}")
    with open_input(path) as f:
        return DIALECTS[dialect](f, path)


def snapshot_paths(list_file: str) -> list[str]:
    """One path per line; a last line without a line feed counts too."""
    with open_input(list_file) as f:
        lines = f.read().decode().split("\n")
    return [line for line in lines if line.strip()]


def wrapped(p: np.ndarray, box: float) -> np.ndarray:
    """Positions moved into [0, box], end points kept."""
    out = (p < 0) | (p > box)
    if box > 0 and out.any():
        v = p[out].astype(np.float64)
        m = np.mod(v, box)
        p = p.copy()
        p[out] = np.where((m == 0) & (v > 0), box, m).astype(np.float32)
    return p


class Slice(InputPartition):
    def __init__(self, fnum, path, first, rows, offset, wrap):
        self.fnum, self.path, self.first = fnum, path, first
        self.rows, self.offset, self.wrap = rows, offset, wrap


def _read_table(path: str):
    """A Parquet folder of the shared storage."""
    import pyarrow.dataset as ds

    system, inner = (fs.FileSystem.from_uri(path) if re.match(r"(?!file:)\w+://", path)
                     else (fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)))
    return ds.dataset(inner, filesystem=system, format="parquet").to_table()


class SnapshotReader(DataSourceReader):
    def __init__(self, options):
        self.slices = options["slices"]

    def partitions(self):
        rows = _read_table(self.slices).select(["fnum", "path", "first", "rows", "offset", "wrap"]).to_pylist()
        rows.sort(key=lambda r: (r["fnum"], r["first"]))
        return [Slice(**r) for r in rows if r["rows"]] or [Slice(0, "", 0, 0, 0, 0.0)]

    def read(self, part):
        done = 0
        if not part.rows:
            return
        with open_input(part.path) as f:
            f.seek(part.offset)
            while done < part.rows:
                n = min(BATCH, part.rows - done)
                xyz = np.frombuffer(_exactly(f, 12 * n, part.path), "<f4").reshape(n, 3)
                cols = [wrapped(np.ascontiguousarray(xyz[:, i]), part.wrap) for i in range(3)]
                start = part.first + done
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part.fnum, np.int32)),
                     pa.array(np.arange(start, start + n, dtype=np.int64)),
                     *[pa.array(c) for c in cols]],
                    names=["fnum", "row_idx", "px", "py", "pz"],
                )
                done += n


class SnapshotSource(DataSource):
    @classmethod
    def name(cls):
        return "snapshot"

    def schema(self):
        return POINTS

    def reader(self, schema):
        return SnapshotReader(self.options)


ship(sys.modules[__name__])


_SLICES = "fnum int, path string, first bigint, rows bigint, offset bigint, wrap double"


def listed_files(spark: SparkSession, list_file: str) -> DataFrame:
    """(fnum, path) of a snapshot list; nothing is opened but the list."""
    return spark.createDataFrame(list(enumerate(snapshot_paths(list_file))), "fnum int, path string")


def snapshot_slices(files: DataFrame, dialect: str, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """The slices of ``files(fnum, path)``, corners NULL. Headers are read by tasks."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown simulation type {dialect!r}; known: {sorted(DIALECTS)}")

    def heads(batches):
        for batch in batches:
            paths = batch.column("path").to_pylist()
            infos = [file_info(p, dialect) for p in paths]
            rows = [(f, p, first, min(rows_per_partition, i.rows - first), i.offset + 12 * first, i.wrap)
                    for f, p, i in zip(batch.column("fnum").to_pylist(), paths, infos) for first in range(0, i.rows, rows_per_partition)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                names=["fnum", "path", "first", "rows", "offset", "wrap"])

    none = {c: F.lit(None).cast("float") for c in BOX_COLS}
    return files.select("fnum", "path").mapInArrow(heads, _SLICES).withColumns(none)


def read_slices(spark: SparkSession, slices: DataFrame | str) -> DataFrame:
    """The points of a table of slices, or of the Parquet folder that holds one."""
    if not isinstance(slices, str):
        slices = stage_table(slices, "slices").inputFiles()
        slices = slices[0].rsplit("/", 1)[0] if slices else ""
    if not slices:
        return spark.createDataFrame([], POINTS)
    spark.dataSource.register(SnapshotSource)
    return spark.read.format("snapshot").option("slices", slices).load()


def read_snapshot(spark: SparkSession, list_file: str, dialect: str,
                  rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """All points of a snapshot list."""
    return read_slices(spark, snapshot_slices(listed_files(spark, list_file), dialect, rows_per_partition))


def index_snapshot(spark: SparkSession, list_file: str, dialect: str, path: str,
                   rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Write the slices with their corners to ``path``; for ``read_slices`` and the pruning joins.

    One pass over the points, aggregated where they are read; one row a slice is shuffled.
    """
    slices = stage_table(snapshot_slices(listed_files(spark, list_file), dialect, rows_per_partition), "slices")
    at = F.col("row_idx") - F.col("row_idx") % rows_per_partition
    corners = read_slices(spark, slices).groupBy("fnum", at.alias("first")).agg(
        *(F.min(c).alias(n) for c, n in zip(XYZ, BOX_COLS[:3])), *(F.max(c).alias(n) for c, n in zip(XYZ, BOX_COLS[3:])))
    slices.drop(*BOX_COLS).join(corners, ["fnum", "first"]).select(*slices.columns).write.parquet(path)
    return spark.read.parquet(path)


def read_points(spark: SparkSession, index: str | DataFrame, files=None, low=(None, None, None), high=(None, None, None)) -> DataFrame:
    """The points of some files (``files``: numbers) with ``low <= position <= high`` on every axis; None is no bound.

    Slices of other files, or that lie outside altogether, are not opened.
    """
    slices = spark.read.parquet(index) if isinstance(index, str) else index
    wanted = F.lit(True) if files is None else F.col("fnum").isin([int(f) for f in files])
    may, does = wanted, wanted
    for axis, small, large, lo, hi in zip(XYZ, BOX_COLS[:3], BOX_COLS[3:], low, high):
        if lo is not None:
            bound = F.lit(float(lo)).cast("float")
            may, does = may & (F.col(large).isNull() | (F.col(large) >= bound)), does & (F.col(axis) >= bound)
        if hi is not None:
            bound = F.lit(float(hi)).cast("float")
            may, does = may & (F.col(small).isNull() | (F.col(small) <= bound)), does & (F.col(axis) <= bound)
    return read_slices(spark, slices.where(may)).where(does)


def slices_of(slices: DataFrame, files: DataFrame) -> DataFrame:
    """The slices of ``files(fnum)``."""
    return slices.join(files.select("fnum").distinct(), "fnum", "left_semi")


def name_tokens(path):
    """Shell and pixel numbers at the end of a light-cone file name, and its base name."""
    parts = F.split(path, "_")
    number = lambda c: F.regexp_extract(c, r"^\s*(\d+)", 1).try_cast("bigint")
    return {
        "hpix": number(F.element_at(parts, -1)),
        "rbin": F.when(F.size(parts) > 1, number(F.try_element_at(parts, F.lit(-2)))).cast("int"),
        "base_name": F.element_at(F.split(path, "/"), -1),
    }


def snapshot_files(spark: SparkSession, list_file: str, dialect: str) -> DataFrame:
    """The file table: fnum, path, n_parts, box_size, forder, hpix, rbin, base_name.

    Headers are read by tasks, a few bytes per file.
    """
    return file_table(listed_files(spark, list_file), dialect)


def file_table(df: DataFrame, dialect: str) -> DataFrame:
    """``snapshot_files`` of ``df(fnum, path)``."""
    out = "fnum int, path string, n_parts bigint, box_size float, forder int"

    def heads(batches):
        for batch in batches:
            infos = [file_info(p, dialect) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "fnum": batch.column("fnum"),
                "path": batch.column("path"),
                "n_parts": pa.array([i.rows for i in infos], pa.int64()),
                "box_size": pa.array([i.period for i in infos], pa.float32()),
                "forder": pa.array([max(i.file_nside.bit_length() - 1, 0) for i in infos], pa.int32()),
            })

    return df.mapInArrow(heads, out).withColumns(name_tokens(F.col("path")))
