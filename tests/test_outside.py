"""Vectors whose components lie beyond the unit box give the rows of the DuckDB twins."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def beyond(tmp_path_factory):
    folder = tmp_path_factory.mktemp("beyond")
    rng = np.random.default_rng(8)
    xyz = (0.2 * rng.standard_normal((120, 4))).astype(np.float32)
    xyz[:4] = [[0.55, 0.1, 0.1, 0], [-0.53, 0.1, 0.1, 0], [0.52, 0.51, -0.6, 0], [0.1, 0.5, -0.5, 0]]
    rows = pd.DataFrame({"vec_id": np.arange(120), "embedding": list(xyz), "label": np.arange(120) % 4})
    rows.to_parquet(folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["buffered_read", "file_overlap_periodic"])
def test_points_beyond_the_unit_box(spark, beyond, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{beyond}/embeddings.parquet'")
    got = entry.queries()[name](spark, beyond)
    want = con.execute(entry.oracle_sql()[name]).df()[got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))
