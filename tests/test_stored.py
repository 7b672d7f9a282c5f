"""The block table that is built once and asked many times."""

import re

import numpy as np
import pytest

from conftest import brute_r2, clustered, make_halos, make_points
from proxima.operators import stored as T


def asked(h, x, n, length=None):
    """Rank n, not counting one point that is on the entry itself."""
    r2 = np.sort(brute_r2(h, x, length), axis=1).astype(np.float32)
    wanted = np.where(r2[:, 0] == 0, r2[:, n] if len(x) > n else np.nan, r2[:, n - 1])
    return np.sqrt(wanted)


@pytest.mark.parametrize("length", [None, 1.0])
def test_equals_brute_force(spark, tmp_path, length):
    x = clustered()
    rng = np.random.default_rng(9)
    h = np.concatenate([x[::40], rng.random((60, 3)), 0.3 + 0.001 * rng.standard_normal((200, 3))]).astype(np.float32)
    if not length:
        h = np.concatenate([h, [[9, 9, 9], [-3, 0.5, 0.5]]]).astype(np.float32)
    stored = T.store_blocks(make_points(spark, x), str(tmp_path / "t"), length, block_rows=32)
    h %= np.float32(length) if length else np.float32(1e9)
    if not length:
        h[-1] = [-3, 0.5, 0.5]
    x = x % np.float32(1) if length else x
    for ghosts in (1 << 16, 100):
        got = T.rnn_halos_stored(make_halos(spark, h), stored, 7, block_rows=16, ghost_rows=ghosts).toPandas().sort_values("halo_file_index")
        np.testing.assert_array_equal(got.rnn.to_numpy(np.float32), asked(h, x, 7, length))
        assert got.certified.all()


def test_only_reached_ranges_are_read(spark, tmp_path):
    x = np.random.default_rng(3).random((6000, 3)).astype(np.float32)
    T.store_blocks(make_points(spark, x), str(tmp_path / "t"), block_rows=64)
    stored = T.open_blocks(spark, str(tmp_path / "t"))
    links = stored.table("extents").where("d_x1 < 0.2 and d_y1 < 0.2 and d_z1 < 0.2").withColumnRenamed("block", "b")
    shown = stored.shown(links)
    ranges = {r[0] for r in stored.table("blocks").select("range").distinct().collect()}
    # the filter is one on the scan's folders, and some folders are outside of it
    assert re.search(r"PartitionFilters: \[.*\(range#\d+ = 0\)\]", shown._jdf.queryExecution().executedPlan().toString())
    assert 0 < shown.count() < 6000 and len(ranges) > 1
    h = np.array([[0.1, 0.1, 0.1]], np.float32)
    got = T.rnn_halos_stored(make_halos(spark, h), stored, 5).collect()[0]
    assert np.float32(got["rnn"]) == asked(h, x, 5)[0]


def test_few_points_and_search_buffer(spark, tmp_path):
    x = np.array([[0.1, 0.1, 0.1], [0.2, 0.1, 0.1], [0.9, 0.9, 0.9]], np.float32)
    h = np.array([[0.1, 0.1, 0.1], [0.5, 0.5, 0.5]], np.float32)
    stored = T.store_blocks(make_points(spark, x), str(tmp_path / "t"))
    rows = {r["id"]: r for r in T.rnn_halos_stored(make_halos(spark, h), stored, 3).collect()}
    # the entry on a point has only two others
    assert (rows[7]["rnn"], rows[7]["certified"]) == (None, False)
    assert np.float32(rows[8]["rnn"]) == asked(h[1:], x, 3)[0] and rows[8]["certified"]
    near = {r["id"]: r["certified"] for r in T.rnn_halos_stored(make_halos(spark, h), stored, 1, max_radius=0.2).collect()}
    assert near == {7: True, 8: False}


def test_entries_without_a_place_and_empty_tables(spark, tmp_path):
    halos = spark.createDataFrame(
        [(0, 5, 0.5, 0.5, 0.5), (1, 6, None, 0.5, 0.5), (2, 7, float("nan"), 0.5, 0.5)],
        "halo_file_index long, id long, px float, py float, pz float")
    points = make_points(spark, clustered())
    stored = T.store_blocks(points, str(tmp_path / "t"))
    found = {r["id"]: r["certified"] for r in T.rnn_halos_stored(halos, stored, 4).collect()}
    assert found == {5: True, 6: False, 7: False}
    assert T.rnn_halos_stored(halos.limit(0), stored, 4).count() == 0
    empty = T.store_blocks(points.limit(0), str(tmp_path / "e"))
    assert [r["certified"] for r in T.rnn_halos_stored(halos, empty, 4).collect()] == [False] * 3
    assert T.open_blocks(spark, str(tmp_path / "nothing")) is None
