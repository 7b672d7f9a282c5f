import numpy as np
import pytest

from conftest import brute_r2, clustered, make_points
from proxima.streaming import catalogue_feed
from proxima.streaming.catalogue_feed import run_feed


def test_feed_equals_batch_with_one_build(spark, tmp_path, monkeypatch):
    builds, build = [], catalogue_feed.store_blocks
    monkeypatch.setattr(catalogue_feed, "store_blocks", lambda *a: builds.append(a) or build(*a))
    x = clustered()
    h = np.random.default_rng(6).random((45, 3)).astype(np.float32)
    folder = tmp_path / "in"
    folder.mkdir()
    for f in range(3):
        rows = range(f * 15, f * 15 + 15)
        (folder / f"c{f}.txt").write_text("#h\n" + "".join(
            f"{i} 1 0 0 0 0 0 0 {float(h[i, 0])!r} {float(h[i, 1])!r} {float(h[i, 2])!r} 0 0 0 5\n"
            for i in rows
        ))
    out = str(tmp_path / "out")
    run_feed(spark, str(folder), "SKELETON", make_points(spark, x), 4, out,
             str(tmp_path / "cp"), files_per_chunk=1)
    got = spark.read.parquet(out).toPandas().sort_values("id")
    want = np.sqrt(np.sort(brute_r2(h, x), axis=1)[:, 3].astype(float)).astype(np.float32)
    assert sorted(set(got.chunk)) == [0, 1, 2]
    np.testing.assert_array_equal(got.rnn.to_numpy(np.float32), want)
    assert len(builds) == 1
    # a later run over new files takes the same table
    (folder / "c3.txt").write_text("#h\n99 1 0 0 0 0 0 0 0.5 0.5 0.5 0 0 0 5\n")
    run_feed(spark, str(folder), "SKELETON", make_points(spark, x), 4, out, str(tmp_path / "cp"), files_per_chunk=1)
    assert len(builds) == 1 and spark.read.parquet(out).where("id = 99 and certified").count() == 1
    with pytest.raises(ValueError, match="period"):
        run_feed(spark, str(folder), "SKELETON", make_points(spark, x), 4, out, str(tmp_path / "cp"), length=1.0)
