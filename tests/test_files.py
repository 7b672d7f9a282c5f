import os

import numpy as np
import pytest

from conftest import brute_r2
from proxima.config import parse_config
from proxima.plans.jobs import run
from proxima.sinks.files import write_lines
from proxima.sources.catalogue import check_ids, read_catalogue
from proxima.sources.snapshot import GADGET_HEADER, SKY_HEADER, read_snapshot, snapshot_files


def write_gadget(path, xyz, box, npart=None):
    head = np.zeros(1, GADGET_HEADER)
    head["npart"][0] = npart or [0, len(xyz), 0, 0, 0, 0]
    head["BoxSize"] = box
    mark = np.array([256], "<i4").tobytes()
    body = np.asarray(xyz, "<f4").tobytes()
    with open(path, "wb") as f:
        f.write(mark + head.tobytes() + mark + np.array([len(body)], "<i4").tobytes() + body)
        f.write(b"velocities that must not be read")


def snapshot_list(tmp_path, paths, end="\n"):
    out = tmp_path / "list.txt"
    out.write_text("\n".join(map(str, paths)) + end)
    return str(out)


def test_gadget_wraps_and_skips_type_five(spark, tmp_path):
    xyz = np.array([[-1, 0, 10], [10.5, 5, 25], [3, 20, 4], [1, 1, 1], [9, 9, 9]], np.float32)
    write_gadget(tmp_path / "a", xyz, 10.0, [1, 2, 0, 1, 1, 3])
    write_gadget(tmp_path / "b", np.zeros((0, 3)), 10.0)
    files = snapshot_list(tmp_path, [tmp_path / "a", tmp_path / "b"], end="")
    got = read_snapshot(spark, files, "LGADGET", rows_per_partition=2)
    got = got.toPandas().sort_values("row_idx")
    want = np.array([[9, 0, 10], [0.5, 5, 5], [3, 10, 4], [1, 1, 1], [9, 9, 9]], np.float32)
    np.testing.assert_array_equal(got[["px", "py", "pz"]].to_numpy(), want)
    info = snapshot_files(spark, files, "LGADGET").toPandas().sort_values("fnum")
    assert list(info.n_parts) == [5, 0] and list(info.box_size) == [10.0, 10.0]
    cone = read_snapshot(spark, files, "LGADGETLC").toPandas().sort_values("row_idx")
    np.testing.assert_array_equal(cone[["px", "py", "pz"]].to_numpy(), xyz)
    assert list(snapshot_files(spark, files, "LGADGETLC").toPandas().box_size) == [-1.0, -1.0]
    with pytest.raises(ValueError, match="simulation type"):
        read_snapshot(spark, files, "OTHER")


def test_sky_cone(spark, tmp_path):
    xyz = np.random.default_rng(0).random((7, 3)).astype("<f4")
    head = np.zeros(1, SKY_HEADER)
    head["npart"], head["nside"], head["filenside"] = 7, 2, 4
    path = tmp_path / "cone_3_17"
    path.write_bytes(head.tobytes() + np.arange(48, dtype="<i8").tobytes() + xyz.tobytes())
    files = snapshot_list(tmp_path, [path])
    got = read_snapshot(spark, files, "LGADGETBCCLC").toPandas().sort_values("row_idx")
    np.testing.assert_array_equal(got[["px", "py", "pz"]].to_numpy(), xyz)
    info = snapshot_files(spark, files, "LGADGETBCCLC").first()
    assert (info.hpix, info.rbin, info.forder, info.n_parts) == (17, 3, 2, 7)
    assert info.base_name == "cone_3_17" and info.box_size == -1.0


def skeleton_line(i, xyz):
    return f"  {i} 1 0 0 0 0 0 0 {xyz[0]:.7g} {xyz[1]:.7g}\t{xyz[2]:.7g} 0 0 0 5"


def test_catalogues(spark, tmp_path):
    rows = [(11, (1, 2, 3)), (12, (-0.5, 10.5, 4))]
    sk = tmp_path / "sk.halos"
    sk.write_text("# header\n" + "\n".join(skeleton_line(i, x) for i, x in rows))
    got = read_catalogue(spark, str(sk), "SKELETON", 10.0).toPandas().sort_values("halo_file_index")
    assert list(got.id) == [11, 12] and list(got.halo_file_index) == [0, 1]
    np.testing.assert_array_equal(got[["px", "py", "pz"]].to_numpy(np.float32), [[1, 2, 3], [9.5, 0.5, 4]])
    sub = tmp_path / "sub.halos"
    sub.write_text("h\n1.0 42 " + "0 " * 15 + "7 8 9 " + "0 " * 7 + "\n")
    one = read_catalogue(spark, str(sub), "SUB").first()
    assert (one.id, one.px, one.py, one.pz) == (42, 7.0, 8.0, 9.0)
    with pytest.raises(ValueError, match="not supported"):
        read_catalogue(spark, str(sub), "NONE")
    halos = read_catalogue(spark, str(sk), "SKELETON")
    side = halos.selectExpr("halo_file_index", "id + 1 as id", "0L as bbox_file_index", "0L as bbox_index")
    with pytest.raises(Exception, match="ids differ"):
        check_ids(halos, side).collect()


def test_config():
    good = """
    # comment
    outputpath /out # here
    NumTasksIOInParallel\t1
    SimulationType LGADGET#x
    SnapshotFileList l
    BBoxOutputFile b
    HaloFile
    DomainBuffSize 10.0 #in code units!
    NRNN 120
    Ndiv 3
    """
    c = parse_config(good)
    assert (c.output_path, c.simulation_type, c.n_rnn, c.domain_buff_size) == ("/out", "LGADGET", 120, 10.0)
    assert c.halo_file == ""
    with pytest.raises(ValueError, match="not found"):
        parse_config(good + "Other 1\n")
    with pytest.raises(ValueError, match="NRnn"):
        parse_config(good.replace("NRNN 120", ""))


def test_lines_in_order(spark, tmp_path):
    path = str(tmp_path / "out.txt")
    write_lines(spark.range(1000).selectExpr("id", "concat('row ', id) as line"), ["id"], path, "#h")
    assert open(path).read() == "#h\n" + "".join(f"row {i}\n" for i in range(1000))


@pytest.fixture()
def job(tmp_path):
    rng = np.random.default_rng(2)
    parts = [rng.random((n, 3)).astype(np.float32) * 10 for n in (300, 0, 150)]
    paths = [tmp_path / f"snap_{i}" for i in range(3)]
    for p, x in zip(paths, parts):
        write_gadget(p, x, 10.0)
    text = f"""OutputPath {tmp_path}/out
    NumTasksIOInParallel 1
    SimulationType LGADGET
    SnapshotFileList {snapshot_list(tmp_path, paths)}
    BBoxOutputFile {tmp_path}/boxes.txt
    DomainBuffSize 5.0
    NRnn 8
    Ndiv 3
    """
    return tmp_path, parts, text


def test_particle_job(spark, job):
    tmp, parts, text = job
    run(spark, parse_config(text))
    x = np.concatenate(parts)
    want = np.sqrt(np.sort(brute_r2(x, x, 10.0), axis=1)[:, 8].astype(float)).astype(np.float32)
    at = 0
    for i, p in enumerate(parts):
        raw = (tmp / "out" / f"rnn_snap_{i}").read_bytes()
        n = len(p)
        head = np.array([8, n, 8, 8, 4 * n], "<i4").tobytes()
        assert raw == head + want[at:at + n].tobytes() + np.array([4 * n], "<i4").tobytes()
        at += n
    lines = (tmp / "boxes.txt").read_text().splitlines()
    assert lines[0].startswith("# fileNumber boxIndex")
    assert sum(int(line.split()[-1]) for line in lines[1:]) == len(x)


def test_halo_job(spark, job):
    tmp, parts, text = job
    x = np.concatenate(parts)
    h = np.concatenate([x[:5], np.random.default_rng(4).random((40, 3)) * 10]).astype(np.float32)
    cat = tmp / "my.halos"
    cat.write_text("#h\n" + "".join(
        f"{100 + i} 1 0 0 0 0 0 0 {float(a)!r} {float(b)!r} {float(c)!r} 0 0 0 5\n"
        for i, (a, b, c) in enumerate(h)
    ))
    text += f"HaloFile {cat}\nHaloFileFormat SKELETON\nHaloChunkSizeMB 1\n"
    run(spark, parse_config(text), sidecar=True)
    s = np.sort(brute_r2(h, x, 10.0), axis=1)
    want = np.sqrt(np.where(s[:, 0] == 0, s[:, 8], s[:, 7]).astype(float)).astype(np.float32)
    lines = (tmp / "out" / "rnn_my.halos").read_text().splitlines()
    assert lines[0] == "#ID Rnn [for N = 8]"
    assert lines[1:] == [f"{100 + i} {float(v):f}" for i, v in enumerate(want)]
    side = (tmp / "out" / "bbox_my.halos").read_text().splitlines()
    assert side[0] == "#ID FileInd BBoxInd" and len(side) == len(h) + 1
    assert os.path.exists(tmp / "boxes.txt")
    again = run(spark, parse_config(text), sidecar=str(tmp / "out" / "bbox_my.halos")).orderBy("halo_file_index").collect()
    assert [f"{r['id']} {r['bbox_file_index']} {r['bbox_index']}" for r in again] == side[1:]
    (tmp / "other").write_text("\n".join([side[0], *side[2:], side[1]]) + "\n")
    with pytest.raises(Exception, match="ids differ"):
        run(spark, parse_config(text), sidecar=str(tmp / "other"))


def test_catalogue_folder_has_a_header_in_each_file(spark, tmp_path):
    for name, ids in (("a", (1, 2, 3)), ("b", (4,)), ("c", ())):
        rows = "".join(f"{i} 1 0 0 0 0 0 0 {i}.5 2 3 0 0 0 5\n" for i in ids)
        (tmp_path / name).write_text("anything\n" + rows)
    got = read_catalogue(spark, str(tmp_path), "SKELETON").orderBy("halo_file_index").collect()
    assert [(r["halo_file_index"], r["id"], r["px"]) for r in got] == [(0, 1, 1.5), (1, 2, 2.5), (2, 3, 3.5), (3, 4, 4.5)]


def test_outputs_on_a_uri_and_nothing_left_of_a_failed_job(spark, tmp_path):
    from proxima.sinks.files import write_rnn_files

    n = [700, 0, 50]
    files = spark.createDataFrame([(i, f"/sim/snap_{i}", k) for i, k in enumerate(n)], "fnum int, path string, n_parts long")
    rnn = spark.range(750).selectExpr("cast(if(id < 700, 0, 2) as int) as fnum", "if(id < 700, id, id - 700) as row_idx",
                                      "if(id = 3, null, cast(id as float)) as rnn")
    out = tmp_path / "there"
    assert write_rnn_files(rnn, files, 8, f"file://{out}") == 750
    assert sorted(os.listdir(out)) == ["rnn_snap_0", "rnn_snap_1", "rnn_snap_2"]
    for i, k in enumerate(n):
        raw = (out / f"rnn_snap_{i}").read_bytes()
        values = np.frombuffer(raw[20:20 + 4 * k], "<f4")
        assert raw[:20] == np.array([8, k, 8, 8, 4 * k], "<i4").tobytes() and raw[20 + 4 * k:] == np.array([4 * k], "<i4").tobytes()
        want = np.arange(700, dtype="f4") if i == 0 else np.arange(700, 700 + k, dtype="f4")
        if i == 0:
            assert np.isnan(values[3])
            want[3] = values[3]
        np.testing.assert_array_equal(values, want[:k])
    again = tmp_path / "other"
    with pytest.raises(Exception, match="rows in place of"):
        write_rnn_files(rnn.where("not (fnum = 2 and row_idx = 49)"), files,
                        8, str(again))
    assert os.listdir(again) == []
