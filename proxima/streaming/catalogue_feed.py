"""Catalogue jobs over a folder that keeps receiving catalogue files.

The chunk loop of a catalogue run as a stream: every trigger takes the files
that are new, answers their entries against the same block table, and appends
the result. The table is built once, before the first chunk, and kept for later runs.
A repeated batch overwrites its own folder, so nothing is doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geometry import is_periodic
from ..operators.stored import open_blocks, rnn_halos_stored, store_blocks
from ..session import scratch, stage_table
from ..sources.catalogue import catalogue_text, number_lines, parse_catalogue


def run_feed(spark: SparkSession, folder: str, layout: str, points: DataFrame, n: int,
             out: str, checkpoint: str, length=None, max_radius=None, files_per_chunk: int = 64,
             blocks: str | None = None):
    """Process all files now in ``folder``; returns the finished stream.

    Rows written: source file, entry id, rnn, certified. As in a batch job, the
    first line of each file is its header. ``blocks`` is the folder of the points'
    block table, by default beside ``out``; one that is there already is used as it is, so other
    points need another folder.
    """
    blocks = blocks or f"{out.rstrip('/')}-blocks"
    stored = open_blocks(spark, blocks)
    if stored is None:
        with scratch(spark):
            stored = store_blocks(points, blocks, length)
    elif stored.length != (float(length) if is_periodic(length) else None):
        raise ValueError(f"{blocks} was built with period {stored.length}, not {length}")
    lines = catalogue_text(spark.readStream.option("maxFilesPerTrigger", files_per_chunk).text(folder))

    def chunk(batch: DataFrame, number: int):
        with scratch(spark):
            batch = stage_table(
                number_lines(batch).filter(F.length(F.trim("value")) > 0)
                .withColumn("source", F.element_at(F.split("_file", "/"), -1)), "chunk")
            halos = parse_catalogue(batch.select("halo_file_index", "value"), layout, length)
            rnn = rnn_halos_stored(halos, stored, n, max_radius)
            named = rnn.join(batch.select("halo_file_index", "source"), "halo_file_index")
            named.select("source", "id", "rnn", "certified").write.mode("overwrite").parquet(
                f"{out}/chunk={number}"
            )

    query = (
        lines.writeStream.foreachBatch(chunk).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
