"""Numbers that run full must be refused, and rows without a place kept."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import brute_r2, clustered, make_halos, make_points
from pyspark.sql import functions as F

from proxima.operators import kernels
from proxima.operators.knn import _merge_shares, build_blocks, knn_pairs, rnn_halos, rnn_particles
from proxima.session import shared_dir
from proxima.sinks.files import write_rnn_files


def test_blocks_are_whole_curve_cells():
    rng = np.random.default_rng(0)
    keys = np.sort(np.concatenate([rng.integers(0, 1 << 12, 500), np.full(90, 77), rng.integers(1 << 11, (1 << 11) + 40, 300)]))
    at, before, sizes = 0, None, []
    while at < len(keys):
        size = kernels.run_length(keys[at:], 40, 12, None, None, before)
        low, high = keys[at], keys[at + size - 1]
        held = (keys >= low) & (keys <= high)
        # all rows between a block's ends are its own, unless one finest cell is over-full
        assert size <= 40 and (held.sum() == size or low == high)
        before, at = int(high), at + size
        sizes.append(size)
    assert sum(sizes) == len(keys)


def test_block_numbers_run_full(monkeypatch):
    monkeypatch.setattr(kernels, "SERIAL_BITS", 1)

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr("pyspark.TaskContext", Task)
    rows = 40
    columns = {c: np.linspace(0, 1, rows).astype(np.float32) for c in ("px", "py", "pz")}
    columns |= {c: np.ones(rows, np.int64) for c in ("nd", "nq", "ia", "ib")} | {"_key": np.arange(rows)}
    with pytest.raises(ValueError, match="blocks"):
        list(kernels.block_cutter(4, 1, -1.0, 6, True)(iter([pa.RecordBatch.from_pydict(columns)])))


@pytest.mark.parametrize("rows", [1, 70_000])
def test_block_rows_out_of_range(spark, rows):
    with pytest.raises(ValueError, match="block_rows"):
        rnn_particles(make_points(spark, clustered()), 3, block_rows=rows)


def test_record_length_runs_full(spark, tmp_path):
    files = spark.createDataFrame([(0, 1 << 30, "a")], "fnum int, n_parts long, path string")
    rnn = spark.createDataFrame([(0, 0, 1.0)], "fnum int, row_idx long, rnn float")
    with pytest.raises(Exception, match="32-bit record length"):
        write_rnn_files(rnn, files, 8, str(tmp_path))


def test_no_shared_folder():
    class Bare:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Bare)


def test_rows_without_a_place_stay(spark):
    xyz = clustered()[:200]
    points = make_points(spark, xyz)
    lost = points.where("row_idx < 3").withColumn("px", F.lit(None).cast("float")).withColumn("row_idx", F.col("row_idx") + 1000)
    same = points.where("row_idx < 2").withColumn("pz", F.lit(None).cast("float")).withColumn("row_idx", F.col("row_idx") + 2000)
    every = points.unionByName(lost).unionByName(same).unionByName(same.withColumn("row_idx", F.col("row_idx") + 50))
    got = rnn_particles(every, 4, block_rows=16).collect()
    assert len(got) == 207
    assert all(r["rnn"] is not None for r in got if r["row_idx"] < 1000)
    halos = make_halos(spark, xyz[:20]).withColumn("py", F.when(F.col("id") < 10, F.col("py")))
    assert rnn_halos(halos, points, 4, block_rows=16).count() == 20


@pytest.mark.parametrize("length", [None, 1.0])
def test_uneven_blocks_are_sent_few_rows(spark, length):
    """A dense cluster beside voids: no unit is shown much more than it holds."""
    rng = np.random.default_rng(4)
    xyz = np.concatenate([0.5 + 0.01 * rng.standard_normal((6000, 3)), rng.random((2000, 3))]).astype(np.float32) % 1
    from proxima.operators.knn import _positions, _survey, link_blocks

    points = make_points(spark, xyz)
    blocks = build_blocks(_positions(points, None, 5, False), _survey([points]), 5, length, 256)
    assert blocks.groupBy("block").count().agg(F.max("count")).first()[0] <= 256
    links, _ = link_blocks(blocks, 5, length, 1 << 16)
    shown = links.join(blocks.groupBy("block").count(), F.col("b") == F.col("block")).groupBy("a").agg(F.sum("count").alias("n"))
    assert shown.agg(F.percentile_approx("n", 0.9)).first()[0] <= 16 * 256
    got = {r["row_idx"]: r["rnn"] for r in rnn_particles(points, 5, length, block_rows=256).collect()}
    some = rng.choice(len(xyz), 200, replace=False)
    want = np.sqrt(np.partition(brute_r2(xyz[some], xyz, length), 5, axis=1)[:, 5])
    assert all(np.float32(got[int(i)]) == w for i, w in zip(some, want))


def test_shares_merge_a_few_at_a_time(spark):
    rows = [(0.0, 0.0, 0.0, 1, 1, 1, s, [(float(s + 20 * k), 1) for k in range(3)]) for s in range(20)]
    found = spark.createDataFrame(
        rows, "px float, py float, pz float, nq long, ia long, ib long, share int, near array<struct<r2: float, w: bigint>>")
    near = _merge_shares(found, 20, 5).first()["near"]
    assert [e["r2"] for e in near] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


@pytest.mark.parametrize("length", [None, 1.0])
def test_lists_over_many_blocks(spark, length):
    xyz = clustered()
    got = {}
    for r in knn_pairs(make_points(spark, xyz), 4, length, block_rows=32, ghost_rows=64).collect():
        got.setdefault(r["row_idx"], []).append((r["rank"], r["r2"], r["nbr_row_idx"]))
    r2 = brute_r2(xyz, xyz, length)
    for i in range(0, len(xyz), 37):
        order = [j for j in np.lexsort((np.arange(len(xyz)), r2[i])) if j != i][:4]
        assert [(n, j) for n, _, j in sorted(got[i])] == [(k + 1, j) for k, j in enumerate(order)]


def test_hot_positions_are_joined_apart(spark, monkeypatch):
    from proxima.operators import knn

    xyz = clustered()
    points = make_points(spark, xyz)
    halos = make_halos(spark, np.concatenate([xyz[-300:], xyz[:50]]))
    def answers():
        rows = lambda df: sorted(map(tuple, df.collect()))
        return [rows(knn.rnn_particles(points, 5)), rows(knn.rnn_halos(halos, points, 5)), rows(knn.knn_pairs(points, 3))]

    usual = answers()
    monkeypatch.setattr(knn, "HOT_ROWS", 50)
    assert answers() == usual
