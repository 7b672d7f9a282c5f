import numpy as np
import pytest

from conftest import brute_r2, clustered, make_halos, make_points
from proxima.operators.knn import knn_join, knn_pairs, rnn_halos, rnn_particles
from proxima.operators.radius import radius_counts, radius_pairs


def root(r2):
    return np.sqrt(r2.astype(np.float64)).astype(np.float32)


@pytest.mark.parametrize("length", [None, 1.0])
@pytest.mark.parametrize("n,block,ghost", [(1, 64, 10**6), (8, 64, 90), (40, 5000, 10**6)])
def test_particles(spark, length, n, block, ghost):
    x = clustered()
    got = rnn_particles(make_points(spark, x), n, length, block_rows=block, ghost_rows=ghost)
    got = got.toPandas().sort_values("row_idx")
    want = root(np.sort(brute_r2(x, x, length), axis=1)[:, n])
    assert len(got) == len(x) and got.certified.all()
    np.testing.assert_array_equal(got.rnn.to_numpy(np.float32), want)


@pytest.mark.parametrize("length", [None, 1.0])
def test_halos_coincident_and_offset(spark, length):
    x = clustered()
    h = np.concatenate([np.random.default_rng(5).random((80, 3)), x[::40], x[-1:]]).astype(np.float32)
    got = rnn_halos(make_halos(spark, h), make_points(spark, x), 4, length, block_rows=64, ghost_rows=200)
    got = got.toPandas().sort_values("halo_file_index")
    s = np.sort(brute_r2(h, x, length), axis=1)
    want = root(np.where(s[:, 0] == 0, s[:, 4], s[:, 3]))
    np.testing.assert_array_equal(got.rnn.to_numpy(np.float32), want)


@pytest.mark.parametrize("ghost", [10**6, 90])
def test_lists_break_ties_by_id(spark, ghost):
    x, k = clustered(), 5
    got = knn_pairs(make_points(spark, x), k, 1.0, block_rows=64, ghost_rows=ghost)
    got = got.toPandas().sort_values(["row_idx", "rank"])
    r2 = brute_r2(x, x, 1.0)
    np.fill_diagonal(r2, np.inf)
    order = np.argsort(r2, axis=1, kind="stable")[:, :k]
    np.testing.assert_array_equal(got.nbr_row_idx.to_numpy(), order.ravel())
    np.testing.assert_array_equal(
        got.r2.to_numpy(np.float32), np.take_along_axis(r2, order, 1).ravel()
    )


def test_join_of_two_sets(spark):
    x = clustered()
    q = np.random.default_rng(9).random((60, 3)).astype(np.float32) * 3 - 1  # some far outside
    got = knn_join(make_halos(spark, q), make_points(spark, x), 3, block_rows=64)
    got = got.toPandas().sort_values(["halo_file_index", "rank"])
    order = np.argsort(brute_r2(q, x), axis=1, kind="stable")[:, :3]
    np.testing.assert_array_equal(got.nbr_row_idx.to_numpy(), order.ravel())


def test_outliers_and_empty_space(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((600, 3)), rng.standard_normal((20, 3)) * 400])
    x = x.astype(np.float32)
    got = rnn_particles(make_points(spark, x), 6, block_rows=50, ghost_rows=150)
    got = got.toPandas().sort_values("row_idx")
    np.testing.assert_array_equal(
        got.rnn.to_numpy(np.float32), root(np.sort(brute_r2(x, x), axis=1)[:, 6])
    )


def test_buffer_and_too_few_points(spark):
    x = clustered()
    cut = np.float32(0.05)
    got = rnn_particles(make_points(spark, x), 8, None, max_radius=0.05, block_rows=64).toPandas()
    want = root(np.sort(brute_r2(x, x), axis=1)[:, 8])
    assert got.certified.sum() == (want <= cut).sum()
    assert got.rnn.isna().sum() == (want > cut).sum()
    few = rnn_particles(make_points(spark, x[:3]), 8).toPandas()
    assert few.rnn.isna().all() and not few.certified.any()
    with pytest.raises(Exception, match="search buffer"):
        rnn_particles(make_points(spark, x), 8, None, max_radius=0.05, strict=True).collect()


def test_files_do_not_change_the_answer(spark):
    x = clustered()
    one = rnn_particles(make_points(spark, x), 8, 1.0, block_rows=64).toPandas()
    many = rnn_particles(make_points(spark, x, np.arange(len(x)) % 7), 8, 1.0, block_rows=100).toPandas()
    a = one.sort_values("row_idx").rnn.to_numpy()
    np.testing.assert_array_equal(a, many.sort_values("row_idx").rnn.to_numpy())


@pytest.mark.parametrize("length,radius", [(None, 0.2), (1.0, 0.2), (1.0, 0.35), (1.0, 0.6)])
def test_radius(spark, length, radius):
    x = clustered()[::3]
    got = radius_pairs(make_points(spark, x), radius, length, cell_rows=40).toPandas()
    r2 = brute_r2(x, x, length)
    hit = r2 <= np.float32(radius) * np.float32(radius)
    assert len(got) == hit.sum() == len(got.drop_duplicates(["row_idx", "nbr_row_idx"]))
    i, j = got.row_idx.to_numpy(), got.nbr_row_idx.to_numpy()
    np.testing.assert_array_equal(got.r2.to_numpy(np.float32), r2[i, j])
    counts = radius_counts(make_points(spark, x), radius, length).toPandas().sort_values("row_idx")
    np.testing.assert_array_equal(counts.n_within.to_numpy(), hit.sum(1))


def test_no_nested_loop_in_the_search(spark):
    x = clustered()
    plan = rnn_particles(make_points(spark, x), 8, 1.0, block_rows=64)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_radius_search_sends_few_copies(spark, monkeypatch):
    """A query is sent once and a point a few times, not once for each of 27 cells around it."""
    import pyarrow as pa

    from proxima.operators import radius as R

    def counted(*_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.float32())] * 3 + [pa.array([b.num_rows])], names=["qx", "qy", "qz", "n_within"])
        return run

    x = make_points(spark, np.random.default_rng(2).random((4000, 3)))
    asked = x.selectExpr("px AS qx", "py AS qy", "pz AS qz")
    folded = x.selectExpr("px", "py", "pz", "1L AS m")
    monkeypatch.setattr(R.kernels, "near_pairs", counted)
    sent = R._searched(asked, folded, 0.02, None, 20_000, "m").groupBy().sum("n_within").first()[0]
    assert 2 * 4000 <= sent <= 6 * 4000


@pytest.mark.parametrize("length", [None, 1.0])
def test_counts_over_shares_and_gathered_places(spark, monkeypatch, length):
    x = clustered()[::2]
    lost = make_points(spark, x[:3]).selectExpr("fnum", "row_idx + 9000 AS row_idx", "CAST('NaN' AS float) AS px", "py", "CAST(NULL AS float) AS pz")
    points = make_points(spark, x).unionByName(lost)
    for radius in (0.03, 0.2):
        got = radius_counts(points, radius, length, cell_rows=30).toPandas().sort_values("row_idx")
        want = (brute_r2(x, x, length) <= np.float32(radius) * np.float32(radius)).sum(1)
        np.testing.assert_array_equal(got.n_within.to_numpy(), want)
