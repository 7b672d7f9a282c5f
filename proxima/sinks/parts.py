"""Single files written by many tasks and committed whole, on any file system Arrow knows.

Tasks write the stretches they hold as part files into a folder of their own beside
the outputs, by streams only: nothing is written at an offset, so object stores and
HDFS will do. Only parts that a finished task reports count, so those of failed or
repeated attempts don't. One task for each output then strings its parts together, between a head
and a tail, and the driver renames what is complete. The folder goes in any case: a job that
fails leaves no trace and no half file.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..session import ship, stage_table

COPY = 8 << 20


def place(path: str):
    """File system and path within it, of a URI or a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _parts_of(batches, folder: str, encode: Callable):
    """Rows in order of output to (out, task, rows, part): one part file for each output in this task."""
    from pyspark import TaskContext

    system, inner = place(folder)
    task, now, stream, done = TaskContext.get().partitionId(), None, None, None

    def report():
        stream.close()
        return pa.RecordBatch.from_pydict({
            "out": pa.array([now]), "task": pa.array([task], pa.int32()), "rows": pa.array([done[1]], pa.int64()), "part": pa.array([done[0]])})

    for batch in batches:
        outs, at = batch.column("out").to_pylist(), 0
        while at < len(outs):
            end = at + 1
            while end < len(outs) and outs[end] == outs[at]:
                end += 1
            if outs[at] != now:
                if stream is not None:
                    yield report()
                now, name = outs[at], f"part-{uuid.uuid4().hex}"
                stream, done = system.open_output_stream(f"{inner}/{name}"), [name, 0]
            stream.write(encode(batch.slice(at, end - at)))
            done[1] += end - at
            at = end
    if stream is not None:
        yield report()


def _string_together(batches, folder: str):
    system, inner = place(folder)
    for batch in batches:
        whole = []
        for x in batch.to_pylist():
            parts = sorted(x["parts"] or [], key=lambda p: p["task"])
            rows = sum(p["rows"] for p in parts)
            if x["rows"] is not None and rows != x["rows"]:
                raise ValueError(f"{x['out']}: {rows} rows in place of {x['rows']}")
            name = f"whole-{uuid.uuid4().hex}"
            with system.open_output_stream(f"{inner}/{name}") as to:
                to.write(x["head"])
                for p in parts:
                    with system.open_input_stream(f"{inner}/{p['part']}") as part:
                        while data := part.read(COPY):
                            to.write(data)
                to.write(x["tail"])
            whole.append(name)
        yield pa.RecordBatch.from_pydict({"out": batch.column("out"), "whole": pa.array(whole, pa.string())})


def write_files(ordered: DataFrame, encode: Callable, frames: DataFrame, out_dir: str) -> None:
    """Write each output of ``frames(out, head, tail, rows)`` with the rows of ``ordered`` between head and tail.

    ``ordered`` has ``out`` and is range-partitioned and sorted by it and the row order. ``encode``
    turns a batch of one output into bytes. ``rows``, unless NULL, is how many there must be.
    """
    system, inner = place(out_dir)
    system.create_dir(inner, recursive=True)
    folder = f"{out_dir.rstrip('/')}/.parts-{uuid.uuid4().hex}"
    system, inner = place(folder)
    system.create_dir(inner, recursive=True)
    try:
        manifest = stage_table(ordered.mapInArrow(
            lambda it: _parts_of(it, folder, encode), "out string, task int, rows bigint, part string"), "parts")
        # a part for each range partition that an output spans
        parts = manifest.groupBy("out").agg(F.collect_list(F.struct("task", "rows", "part")).alias("parts"))
        whole = stage_table(
            frames.join(parts, "out", "left").repartition("out").mapInArrow(lambda it: _string_together(it, folder), "out string, whole string"), "whole")
        # one row for each output file
        for row in whole.collect():
            target = place(row["out"])[1]
            if system.get_file_info(target).type == fs.FileType.File:
                system.delete_file(target)
            system.move(f"{inner}/{row['whole']}", target)
    finally:
        system.delete_dir(inner)


ship(sys.modules[__name__])
