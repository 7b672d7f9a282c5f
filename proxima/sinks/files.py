"""Outputs as single files in a given row order, written by many tasks (see ``parts``)."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship, stage_table
from .parts import write_files


def output_name(out_dir: str, path, prefix: str):
    """``<out_dir>/<prefix><base name of path>`` as a column."""
    return F.concat(F.lit(out_dir.rstrip("/") + "/" + prefix), F.element_at(F.split(path, "/"), -1))


def write_rnn_files(rnn: DataFrame, files: DataFrame, n: int, out_dir: str) -> int:
    """One binary file per snapshot, distances in the snapshot's row order.

    Two Fortran records: (row count, n) as int32 and the distances as float32.
    Needs fnum, row_idx, rnn and the file table; returns the rows written. A
    missing distance is written as NaN.
    """
    targets = stage_table(
        files.select("fnum", "n_parts", output_name(out_dir, F.col("path"), "rnn_").alias("out")),
        "rnn-targets",
    )

    def frame(batches):
        for b in batches:
            heads, tails = [], []
            for rows, out in zip(b.column("n_parts").to_pylist(), b.column("out").to_pylist()):
                body = 4 * rows
                if body >> 32:
                    raise ValueError(f"{out}: {rows} rows do not fit the 32-bit record length")
                tails.append(np.array([body], "<u4").tobytes())
                heads.append(np.array([8, rows, n, 8], "<u4").tobytes() + tails[-1])
            yield pa.RecordBatch.from_pydict({
                "out": b.column("out"), "head": pa.array(heads, pa.binary()), "tail": pa.array(tails, pa.binary()), "rows": b.column("n_parts")})

    def encode(batch):
        return batch.column("rnn").to_numpy(zero_copy_only=False).astype("<f4").tobytes()

    placed = (
        rnn.select("fnum", "row_idx", "rnn").join(targets.select("fnum", "out"), "fnum")
        .repartitionByRange("fnum", "row_idx").sortWithinPartitions("fnum", "row_idx").select("out", "rnn")
    )
    write_files(placed, encode, targets.mapInArrow(frame, "out string, head binary, tail binary, rows bigint"), out_dir)
    return targets.agg(F.sum("n_parts")).first()[0] or 0


def write_lines(lines: DataFrame, order: list[str], path: str, header: str) -> None:
    """A text file of the ``line`` column in the given order, after a header."""
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order).select(F.lit(path).alias("out"), "line")
    head = F.lit(header + "\n").cast("binary")
    frames = lines.sparkSession.range(1).select(
        F.lit(path).alias("out"), head.alias("head"), F.lit("").cast("binary").alias("tail"), F.lit(None).cast("bigint").alias("rows"))

    def encode(batch):
        return ("\n".join(batch.column("line").to_pylist()) + "\n").encode()

    write_files(ordered, encode, frames, path.rsplit("/", 1)[0] if "/" in path else ".")


BOX_HEADER = "# fileNumber boxIndex xmin ymin zmin xmax ymax zmax numParts"
SIDECAR_HEADER = "#ID FileInd BBoxInd"


def box_lines(boxes: DataFrame) -> DataFrame:
    corners = [F.col(c).cast("double") for c in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")]
    line = F.format_string("%d %d %e %e %e %e %e %e %d", "fnum", "ind", *corners, "np")
    return boxes.select("fnum", "ind", line.alias("line"))


def halo_lines(rnn: DataFrame) -> DataFrame:
    value = F.when(F.col("rnn").isNull(), "nan").otherwise(
        F.format_string("%f", F.col("rnn").cast("double"))
    )
    return rnn.select("halo_file_index", F.concat_ws(" ", F.col("id"), value).alias("line"))


def sidecar_lines(assigned: DataFrame) -> DataFrame:
    return assigned.select(
        "halo_file_index",
        F.concat_ws(" ", "id", "bbox_file_index", "bbox_index").alias("line"),
    )


def write_boxes(boxes: DataFrame, path: str) -> None:
    write_lines(box_lines(boxes), ["fnum", "ind"], path, BOX_HEADER)


def write_halo_rnn(rnn: DataFrame, n: int, path: str) -> None:
    write_lines(halo_lines(rnn), ["halo_file_index"], path, f"#ID Rnn [for N = {n}]")


def write_sidecar(assigned: DataFrame, path: str) -> None:
    write_lines(sidecar_lines(assigned), ["halo_file_index"], path, SIDECAR_HEADER)


ship(sys.modules[__name__])
