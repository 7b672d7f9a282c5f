"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proxima.session import ship, stage_table  # noqa: F401  (re-exported)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def held_out(doc_id: Column) -> Column:
    """True for documents set aside for testing; false when the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    """True for documents a model may be fitted on; false when the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def uniform(doc_id: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) for each id, independent of the crc32 split."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def ship_module(name: str) -> None:
    """Send this module and the caller's to the workers by value."""
    ship(sys.modules[__name__])
    ship(sys.modules[name])


#: A-Z become a-z; 0-9, a-z and all bytes of characters beyond ASCII stay; the rest separates.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and anything beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_PLAIN).split() if text else []
