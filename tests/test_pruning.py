"""Files that cannot matter are not opened: pushed-down filters, catalogue and light-cone jobs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import brute_r2
from proxima.config import parse_config
from proxima.plans.jobs import build_index, run_catalogue, run_cone
from proxima.sources.snapshot import SKY_HEADER, index_snapshot, read_points, read_slices, read_snapshot
from test_files import snapshot_list, write_gadget


def slabs(tmp_path, n=6, rows=90, seed=3):
    """Files that each hold a slab of the box along x."""
    rng = np.random.default_rng(seed)
    parts = [(rng.random((rows, 3)) * [10 / n, 10, 10] + [10 / n * i, 0, 0]).astype(np.float32) for i in range(n)]
    paths = [tmp_path / f"slab_{i}" for i in range(n)]
    for p, x in zip(paths, parts):
        write_gadget(p, x, 10.0)
    return parts, paths, snapshot_list(tmp_path, paths)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_slices_are_pruned_before_files_are_opened(spark, tmp_path):
    parts, paths, files = slabs(tmp_path)
    index = str(tmp_path / "index")
    index_snapshot(spark, files, "LGADGET", index, rows_per_partition=40)
    whole = spark.createDataFrame(read_slices(spark, index).toPandas(), read_slices(spark, index).schema)
    tests = [
        (dict(files=[1, 2]), F.col("fnum").isin(1, 2), {1, 2}), (dict(high=(1.5, None, None)), F.col("px") <= 1.5, {0}),
        (dict(low=(9, None, None)), F.col("px") >= 9, {5}), (dict(low=(4, 2, None), high=(4.9, None, 3)), F.expr("px between 4 and 4.9 and py >= 2 and pz <= 3"), {2}),
        (dict(files=[0, 4], low=(7, None, None)), F.expr("fnum in (0, 4) and px >= 7"), {4}), (dict(low=(100, None, None)), F.lit(False), set()),
    ]
    for bounds, test, opened in tests:
        want = rows_of(whole.where(test))
        hidden = [p for i, p in enumerate(paths) if i not in opened]
        for p in hidden:
            os.rename(p, f"{p}.away")
        try:
            assert rows_of(read_points(spark, index, **bounds)) == want, bounds
        finally:
            for p in hidden:
                os.rename(f"{p}.away", p)
    os.rename(paths[0], f"{paths[0]}.away")
    with pytest.raises(Exception):
        read_points(spark, index).collect()


def test_index_equals_the_scan(spark, tmp_path):
    parts, paths, files = slabs(tmp_path, n=3)
    index = index_snapshot(spark, files, "LGADGET", str(tmp_path / "index"), rows_per_partition=25)
    assert rows_of(read_slices(spark, index)) == rows_of(read_snapshot(spark, files, "LGADGET"))
    for r in index.collect():
        held = parts[r["fnum"]][r["first"]:r["first"] + r["rows"]]
        assert [r[c] for c in ("xmin", "ymin", "zmin")] == list(held.min(0)) and [r[c] for c in ("xmax", "ymax", "zmax")] == list(held.max(0))


def test_catalogue_job_opens_what_entries_reach(spark, tmp_path):
    parts, paths, files = slabs(tmp_path)
    h = (np.random.default_rng(5).random((30, 3)) * [0.8, 10, 10]).astype(np.float32)  # in the first slab, next to the last
    (tmp_path / "my.halos").write_text("#h\n" + "".join(
        f"{100 + i} 1 0 0 0 0 0 0 {float(a)!r} {float(b)!r} {float(c)!r} 0 0 0 5\n" for i, (a, b, c) in enumerate(h)))
    config = parse_config(f"""OutputPath {tmp_path}/out
    NumTasksIOInParallel 1
    SimulationType LGADGET
    SnapshotFileList {files}
    BBoxOutputFile {tmp_path}/boxes.txt
    DomainBuffSize 2.4
    NRnn 3
    Ndiv 3
    HaloFile {tmp_path}/my.halos
    HaloFileFormat SKELETON
    HaloChunkSizeMB 1
    """)
    build_index(spark, config, str(tmp_path / "index"))
    for i in (2, 3):
        os.rename(paths[i], f"{paths[i]}.away")
    got = run_catalogue(spark, config, str(tmp_path / "index")).orderBy("halo_file_index").collect()
    want = np.sqrt(np.sort(brute_r2(h, np.concatenate(parts), 10.0), axis=1)[:, 2].astype(float)).astype(np.float32)
    assert [r["rnn"] for r in got] == list(want)
    assert len((tmp_path / "out" / "rnn_my.halos").read_text().splitlines()) == 31


def test_cone_job_opens_the_files_of_the_overlap_list(spark, tmp_path):
    rng = np.random.default_rng(6)
    order, paths, parts = 1, [], []
    pixels = rng.integers(48, size=6000)  # dealt to files by direction below
    v = rng.standard_normal((6000, 3))
    v /= np.sqrt((v * v).sum(1))[:, None]
    radius = rng.random(6000) * 150
    del pixels
    from proxima.functions import sky as S

    held = spark.createDataFrame([(int(i), *map(float, v[i])) for i in range(6000)], "id long, x double, y double, z double")
    pix = dict(held.select("id", S.vec2nest(F.col("x"), F.col("y"), F.col("z"), order)).collect())
    xyz = (v * radius[:, None]).astype("<f4")
    for shell in range(6):
        for p in range(48):
            mine = xyz[[i for i in range(6000) if pix[i] == p and int(radius[i] // 25) == shell]]
            head = np.zeros(1, SKY_HEADER)
            head["npart"], head["nside"], head["filenside"] = len(mine), 1, 1 << order
            path = tmp_path / f"cone_{shell}_{p}"
            path.write_bytes(head.tobytes() + np.arange(12, dtype="<i8").tobytes() + mine.tobytes())
            paths.append(path)
            parts.append(mine)
    config = parse_config(f"""OutputPath {tmp_path}/out
    NumTasksIOInParallel 1
    SimulationType LGADGETBCCLC
    SnapshotFileList {snapshot_list(tmp_path, paths)}
    BBoxOutputFile {tmp_path}/boxes.txt
    DomainBuffSize 20
    NRnn 2
    Ndiv 3
    """)
    for i, path in enumerate(paths):
        if i // 48 < 4:  # shells 0 to 3 cannot touch shell 5 within the buffer
            os.rename(path, f"{path}.away")
    rnn = run_cone(spark, config, [5], file_order=order, strict=False)
    got = {(r["fnum"], r["row_idx"]): (r["rnn"], r["certified"]) for r in rnn.collect()}
    mine = np.concatenate([p for i, p in enumerate(parts) if i // 48 == 5])
    names = [(i, k) for i, p in enumerate(parts) if i // 48 == 5 for k in range(len(p))]
    want = np.sqrt(np.sort(brute_r2(mine, np.concatenate(parts)), axis=1)[:, 2].astype(float)).astype(np.float32)
    assert set(got) == set(names)
    for name, d in zip(names, want):
        assert got[name] == ((d, True) if d <= 20 else (None, False))
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"rnn_cone_5_{p}" for p in range(48))
