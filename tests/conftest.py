import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from proxima.session import scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(shared))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    with scratch(session):
        yield session
    assert not [p for p in shared.rglob("*") if p.is_file()]
    session.stop()


def brute_r2(q, c, length=None):
    """All squared distances in float32, x then y then z."""
    total = None
    for axis in range(3):
        d = np.abs(q[:, axis, None] - c[None, :, axis])
        if length:
            d = np.where(d > np.float32(length / 2), np.float32(length) - d, d)
        total = d * d if total is None else total + d * d
    return total


def make_points(spark, xyz, fnum=None):
    xyz = np.asarray(xyz, np.float32)
    pdf = pd.DataFrame({
        "fnum": np.zeros(len(xyz), np.int32) if fnum is None else np.asarray(fnum, np.int32),
        "row_idx": np.arange(len(xyz)),
        "px": xyz[:, 0], "py": xyz[:, 1], "pz": xyz[:, 2],
    })
    return spark.createDataFrame(pdf, "fnum int, row_idx long, px float, py float, pz float")


def make_halos(spark, xyz):
    xyz = np.asarray(xyz, np.float32)
    pdf = pd.DataFrame({
        "halo_file_index": np.arange(len(xyz)), "id": np.arange(len(xyz)) + 7,
        "px": xyz[:, 0], "py": xyz[:, 1], "pz": xyz[:, 2],
    })
    return spark.createDataFrame(pdf, "halo_file_index long, id long, px float, py float, pz float")


def clustered(seed=1):
    """Uniform points, a tight cluster, a crowded position, and the box corners."""
    rng = np.random.default_rng(seed)
    return np.concatenate([
        rng.random((500, 3)),
        0.3 + 0.001 * rng.standard_normal((300, 3)),
        np.repeat([[0.7, 0.1, 0.99]], 400, 0),
        [[0, 0, 0], [1, 1, 1], [0, 0.5, 1], [1, 0.5, 0]],
    ]).astype(np.float32)
