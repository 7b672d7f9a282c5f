import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import clustered, make_halos, make_points
from proxima.functions import curve, geometry as G
from proxima.model import BOX_COLS
from proxima.operators import boxes as B
from proxima.operators.overlap import overlap_join


def test_wrap_keeps_both_ends(spark):
    values = [0.0, 10.0, -0.5, 10.5, 20.0, -10.0, 25.0, 3.25]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p float")
    got = df.select("i", G.wrap_position(F.col("p"), 10.0).alias("w")).orderBy("i").collect()
    assert [r.w for r in got] == [0.0, 10.0, 9.5, 0.5, 10.0, 0.0, 5.0, 3.25]


def test_peano_golden_and_unit_steps(spark):
    golden = {(0, 0, 0): 0, (1, 2, 3): 50, (16384, 0, 0): 14764870430134,
              (12345, 23456, 31000): 26873856273585, (32767, 32767, 32767): 22618524914249}
    df = spark.createDataFrame(list(golden), "x int, y int, z int")
    cols = [F.col(c) for c in "xyz"]
    rows = df.select("x", "y", "z", curve.peano_key(*cols).alias("k")).collect()
    assert {(r.x, r.y, r.z): r.k for r in rows} == golden
    for bits in (1, 2, 4):
        cells = list(itertools.product(range(1 << bits), repeat=3))
        df = spark.createDataFrame(cells, "x int, y int, z int")
        rows = df.select("x", "y", "z", curve.peano_key(*cols, bits=bits).alias("k")).orderBy("k").collect()
        assert [r.k for r in rows] == list(range(8 ** bits))
        at = np.array([(r.x, r.y, r.z) for r in rows])
        assert (np.abs(np.diff(at, axis=0)).sum(1) == 1).all()


def test_curve_order_is_total(spark):
    x = clustered()
    rows = curve.curve_order(make_points(spark, x)).select("ph_key", "row_idx").collect()
    keys = [(r.ph_key, r.row_idx) for r in rows]
    assert keys == sorted(keys) and len(keys) == len(x)


def test_pieces_stay_inside_and_cover(spark):
    rng = np.random.default_rng(0)
    lo = rng.uniform(-2, 2, (60, 3)).astype(np.float32)
    hi = (lo + rng.uniform(0, 1.4, (60, 3))).astype(np.float32)
    pdf = pd.DataFrame(np.c_[lo, hi], columns=list(BOX_COLS)).assign(i=range(60))
    df = spark.createDataFrame(pdf, ", ".join(f"{c} float" for c in BOX_COLS) + ", i long")
    pieces = B.decompose_periodic(df, 1.0).toPandas()
    corners = pieces[list(BOX_COLS)].to_numpy()
    assert corners.min() >= 0 and corners.max() <= 1
    p = rng.random((200, 3))
    for i in range(60):
        mine = corners[pieces.i == i]
        got = ((mine[:, None, :3] <= p) & (p <= mine[:, None, 3:])).all(2).any(0)
        shifts = np.array(list(itertools.product(range(-4, 5), repeat=3)))
        q = p[:, None] + shifts
        want = ((lo[i] <= q) & (q <= hi[i])).all(2).any(1)
        assert (got == want).all()


def test_overlap_join_equals_all_pairs(spark):
    rng = np.random.default_rng(1)

    def boxes(n, tag):
        lo = rng.random((n, 3)) * 10
        size = 10 ** rng.uniform(-4, 1, (n, 1)) * rng.random((n, 3))
        lo[: n // 4], size[: n // 4] = 3.0, 0.0  # many coincident points
        a = np.c_[lo, lo + size]
        cols = [f"{tag}{i}" for i in range(6)]
        pdf = pd.DataFrame(a, columns=cols).assign(**{f"{tag}id": range(n)})
        return spark.createDataFrame(pdf), a, cols

    l, la, lc = boxes(120, "l")
    r, ra, rc = boxes(150, "r")
    for salts in (1, 3):
        got = overlap_join(l, r, lc, rc, [1.0] * 3, [8.0] * 3, salts).select("lid", "rid").toPandas()
        hit = ((la[:, None, :3] <= ra[None, :, 3:]) & (ra[None, :, :3] <= la[:, None, 3:])).all(2)
        assert len(got) == hit.sum()
        assert set(zip(got.lid, got.rid)) == set(zip(*map(list, np.nonzero(hit))))


def test_boxes_hold_all_points_and_flat_files(spark):
    x = np.concatenate([clustered(), [[5, 5, 5]], np.c_[np.random.default_rng(2).random((50, 2)), np.zeros(50)]])
    fnum = np.r_[np.zeros(1204), [1], np.full(50, 2)]
    got = B.number_boxes(B.file_boxes(make_points(spark, x, fnum), 3)).toPandas().sort_values("box_id")
    assert list(got.box_id) == list(range(len(got)))
    assert got.groupby("fnum").np.sum().tolist() == [1204, 1, 50]
    for f, g in got.groupby("fnum"):
        assert g.ind.tolist() == list(range(len(g)))


def test_assignment_outside_every_box(spark):
    x = clustered()
    boxes = B.number_boxes(B.file_boxes(make_points(spark, x, np.arange(len(x)) % 3), 2))
    h = np.array([[0.5, 0.5, 0.5], [40, -3, 2], [1.5, 0.2, 0.2], [0.7, 0.1, 0.99]], np.float32)
    got = B.assign_boxes(make_halos(spark, h), boxes).toPandas().sort_values("halo_file_index")
    b = boxes.toPandas().sort_values("box_id")
    lo, hi = b[list(BOX_COLS[:3])].to_numpy(), b[list(BOX_COLS[3:])].to_numpy()
    for i, p in enumerate(h):
        held = ((lo <= p) & (p <= hi)).all(1)
        if held.any():
            want = np.where(held, (hi - lo).prod(1), -1).argmax()
        else:
            want = np.square(np.maximum(np.maximum(lo - p, p - hi), 0)).sum(1).argmin()
        assert got.bbox_index.iloc[i] == want


def test_a_far_entry_widens_no_other_search(spark):
    """Many small boxes, entries just outside them, and one entry far from all."""
    rng = np.random.default_rng(9)
    low = np.concatenate([rng.random((300, 3)), 0.5 + 0.001 * rng.random((300, 3))]).astype(np.float32)
    high = (low + 0.004 * rng.random((600, 3))).astype(np.float32)
    boxes = spark.createDataFrame(
        [(i % 7, i, i, *map(float, low[i]), *map(float, high[i]), 1) for i in range(600)],
        "fnum int, ind int, box_id long, xmin float, ymin float, zmin float, xmax float, ymax float, zmax float, np long")
    h = np.concatenate([high[:200] + 0.001, rng.random((100, 3)), [[40, 40, 40]]]).astype(np.float32)
    got = B.assign_boxes(make_halos(spark, h), boxes).orderBy("halo_file_index").collect()
    assert len(got) == len(h)
    volume = np.prod(high - low, axis=1, dtype=np.float32)
    for row, p in zip(got, h):
        gap = np.maximum(np.maximum(low - p, p - high), np.float32(0)).astype(np.float64)
        d2 = (gap * gap).sum(1)
        held = np.flatnonzero((low <= p).all(1) & (p <= high).all(1))
        if len(held):
            assert volume[row.bbox_index] == volume[held].max()
        else:
            assert np.sqrt(d2[row.bbox_index]) <= np.sqrt(d2.min()) * (1 + 1e-5) + 1e-9
        assert row.bbox_file_index == row.bbox_index % 7


def test_busy_cells_are_dealt_over_shares(spark):
    from proxima.operators import overlap

    keys = ["_lv", "_cx", "_cy", "_cz"]
    cell = {k: F.when(F.col("id") < 900, 1).otherwise(F.col("id") % 7).alias(k) for k in keys}
    left = spark.range(1000).select(F.col("id").alias("lid"), *cell.values())
    right = spark.range(700, 1000).select(F.col("id").alias("rid"), *cell.values())
    l, r = overlap._shared_out(left, right, ["lid"], ["rid"], keys, 50)
    both = [*keys, "_l_share", "_r_share"]
    for side in (l, r):
        assert side.groupBy(*both).count().agg(F.max("count")).first()[0] < 100
    pairs = l.join(r, both).select("lid", "rid")
    assert pairs.exceptAll(left.join(right, keys).select("lid", "rid")).count() == 0 and pairs.count() == left.join(right, keys).count()


def test_rows_of_busy_cells_stay_where_they_are(spark, monkeypatch):
    """Counts reach the rows by broadcast; where they are too many, no task gets a whole large cell."""
    from proxima.operators import overlap

    keys = ["_lv", "_cx", "_cy", "_cz"]
    cell = {k: F.when(F.col("id") < 900, 1).otherwise(F.col("id") % 7).alias(k) for k in keys}
    left = spark.range(1000).select(F.col("id").alias("lid"), *cell.values())
    right = spark.range(700, 1000).select(F.col("id").alias("rid"), *cell.values())
    l, _ = overlap._shared_out(left, right, ["lid"], ["rid"], keys, 50)
    plan = l._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(overlap, "CELL_TASK_ROWS", 100)
    l, r = overlap._shared_out(left, right, ["lid"], ["rid"], keys, 50)
    pairs, want = l.join(r, [*keys, "_l_share", "_r_share"]).select("lid", "rid"), left.join(right, keys).select("lid", "rid")
    assert pairs.count() == want.count() and pairs.exceptAll(want).count() == 0


def test_points_are_sent_to_levels_in_use(spark):
    """Points have a cell of their own only where the other side has rows so fine."""
    from proxima.operators import overlap

    rows = overlap._emit(make_points(spark, clustered()[:50]), ["px", "py", "pz"] * 2, [0.0] * 3, 1.0, [1, 3], "l")
    assert sorted(r["_lv"] for r in rows.select("_lv").distinct().collect()) == [1, 3] and rows.count() == 100
