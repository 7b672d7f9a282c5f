"""The complete jobs a configuration file describes, and those that read part of the files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import RunConfig, read_config
from ..functions.geometry import is_periodic
from ..operators.boxes import assign_boxes, file_boxes, number_boxes, slices_near
from ..operators.knn import rnn_halos, rnn_particles, wrap_points
from ..operators.sky_ops import sky_file_overlap
from ..session import stage_table
from ..sinks.files import write_boxes, write_halo_rnn, write_rnn_files, write_sidecar
from ..sources.catalogue import check_ids, read_catalogue, read_sidecar
from ..sources.snapshot import (
    file_info, file_table, index_snapshot, listed_files, name_tokens, read_slices, read_snapshot, snapshot_files, snapshot_paths,
    snapshot_slices,
)


def period_of(config: RunConfig) -> float:
    """The period is the one in the first snapshot's header."""
    return file_info(snapshot_paths(config.snapshot_file_list)[0], config.simulation_type).period


def load_points(spark: SparkSession, config: RunConfig):
    length = period_of(config)
    points = read_snapshot(spark, config.snapshot_file_list, config.simulation_type)
    # parsed once: zone map, survey, positions and the join back all read them
    return stage_table(wrap_points(points, length) if is_periodic(length) else points, "points"), length


def run(spark: SparkSession, config: RunConfig | str, strict: bool = True,
        sidecar: bool | str = False) -> DataFrame:
    """Zone map, then distances for the particles or for a catalogue.

    The catalogue job runs when HaloFile is set. Files are written under
    OutputPath; the distances are returned as well. ``strict`` fails the job
    when a distance exceeds DomainBuffSize. ``sidecar`` true writes which box each
    entry belongs to; the path of such a file reads it back instead, checks its ids
    against the catalogue's and returns its columns with the distances.
    """
    if isinstance(config, str):
        config = read_config(config)
    points, length = load_points(spark, config)
    boxes = stage_table(number_boxes(file_boxes(points, config.n_div, length)), "boxes")
    write_boxes(boxes, config.bbox_output_file)
    if not config.halo_file:
        rnn = stage_table(
            rnn_particles(points, config.n_rnn, length, config.domain_buff_size, strict), "rnn"
        )
        files = snapshot_files(spark, config.snapshot_file_list, config.simulation_type)
        write_rnn_files(rnn, files, config.n_rnn, config.output_path)
        return rnn
    halos = stage_table(
        read_catalogue(spark, config.halo_file, config.halo_file_format, length), "halos"
    )
    base = os.path.basename(config.halo_file)
    if isinstance(sidecar, str):
        halos = stage_table(check_ids(halos, read_sidecar(spark, sidecar)), "placed-halos")
    elif sidecar:
        placed = halos.join(assign_boxes(halos, boxes), "halo_file_index")
        write_sidecar(placed, f"{config.output_path}/bbox_{base}")
    rnn = stage_table(
        rnn_halos(halos, points, config.n_rnn, length, config.domain_buff_size, strict), "rnn"
    )
    write_halo_rnn(rnn, config.n_rnn, f"{config.output_path}/rnn_{base}")
    if isinstance(sidecar, str):
        return rnn.join(halos.select("halo_file_index", "bbox_file_index", "bbox_index"), "halo_file_index")
    return rnn


def _trusted(rnn: DataFrame, strict: bool) -> DataFrame:
    rnn = stage_table(rnn, "rnn")
    if strict and not rnn.where(~F.col("certified")).isEmpty():
        raise ValueError("distance exceeds the search buffer or too few points")
    return rnn


def build_index(spark: SparkSession, config: RunConfig | str, path: str) -> DataFrame:
    """The snapshot's index for ``run_catalogue``: one row a slice, with its corners."""
    config = read_config(config) if isinstance(config, str) else config
    return index_snapshot(spark, config.snapshot_file_list, config.simulation_type, path)


def run_catalogue(spark: SparkSession, config: RunConfig | str, index: DataFrame | str, strict: bool = True) -> DataFrame:
    """Distances of a catalogue's entries from the slices within DomainBuffSize of them.

    Slices that no entry reaches are not opened. ``index`` is ``build_index``'s table or its folder.
    """
    config = read_config(config) if isinstance(config, str) else config
    length = period_of(config)
    slices = spark.read.parquet(index) if isinstance(index, str) else index
    halos = stage_table(read_catalogue(spark, config.halo_file, config.halo_file_format, length), "halos")
    points = read_slices(spark, slices_near(slices, halos, config.domain_buff_size, length))
    points = stage_table(wrap_points(points, length) if is_periodic(length) else points, "points")
    rnn = _trusted(rnn_halos(halos, points, config.n_rnn, length, config.domain_buff_size), strict)
    write_halo_rnn(rnn, config.n_rnn, f"{config.output_path}/rnn_{os.path.basename(config.halo_file)}")
    return rnn


def run_cone(spark: SparkSession, config: RunConfig | str, shells: list[int], file_order: int | None = None,
             strict: bool = True) -> DataFrame:
    """Distances of a light cone's particles in some of its shells.

    Shell and pixel of a file are in its name; which files can hold neighbours
    of those in ``shells`` follows from them, and only these are opened. ``file_order`` is the order of
    the files' pixels; without it all headers are read, for that alone.
    """
    config = read_config(config) if isinstance(config, str) else config
    files = listed_files(spark, config.snapshot_file_list)
    if file_order is None:
        files = file_table(files, config.simulation_type)
    else:
        files = files.withColumns(name_tokens(F.col("path"))).withColumn("forder", F.lit(file_order))
    files = stage_table(files, "files")
    targets = files.where(F.col("rbin").isin([int(s) for s in shells]))
    pairs = sky_file_overlap(files.select("fnum", "rbin", "hpix", "forder"), config.domain_buff_size)
    needed = pairs.join(targets.select("fnum"), "fnum").select(F.col("nbr_fnum").alias("fnum")).distinct()
    opened = stage_table(files.select("fnum", "path").join(needed, "fnum", "left_semi"), "opened")
    points = stage_table(read_slices(spark, snapshot_slices(opened, config.simulation_type)), "points")
    found = rnn_particles(points, config.n_rnn, None, config.domain_buff_size)
    rnn = _trusted(found.join(targets.select("fnum"), "fnum", "left_semi"), strict)
    heads = file_table(targets.select("fnum", "path"), config.simulation_type)
    write_rnn_files(rnn, heads, config.n_rnn, config.output_path)
    return rnn
