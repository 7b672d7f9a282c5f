"""SimHash near-duplicates: fingerprints, tiled exact comparison, linked groups.

Fingerprints of all documents are reduced to the different ones. These are put
in cells by the population counts of their two halves (33 x 33 cells at most) and
cells are cut into tiles of about ``TILE`` fingerprints. Counts of a half differ
by no more than its bits differ, so two tiles are compared only if the counts of
their cells differ by no more than the radius in all; within two tiles the same
bound on quarters skips runs of sorted fingerprints. What is left is compared
bit for bit with numpy exclusive-or and bit counts. A pair of tiles answers with
a spanning forest of its links, so no group of copies is ever written as pairs,
and no link between different fingerprints is lost.

Defined results: a null or empty text has no words and fingerprint zero, which
links like any other. Documents with a null id take part; a group's id is its
smallest id that is not null, null if there is none. Repeated rows come out
repeated, each with the same group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import free_name, ship_module, stage_table, table
from proxima.llm.graph import components

WORDS = 4
RADIUS = 4
SEED = 42
TILE = 16384
RUN = 256
#: Shingles that are counted at once, which bounds a task's memory for a long text.
CHUNK = 1 << 16
#: Links that are merged at once within a pair of tiles.
PENDING = 1 << 18


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64 majority bits of the shingles' hashes, as a signed number."""
    tokens = text.encode("utf-8", "replace").lower().split() if text else []
    if not tokens:
        return 0
    size = min(words, len(tokens))
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:len(tokens) - size + 1].tolist()
    ends = ends[size - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    majority = np.packbits(ones * 2 > len(starts), bitorder="little")
    return int(majority.view("<i8")[0])


def _printed(text: Column, words: int) -> Column:
    ship_module(__name__)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return of(text)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint long) of every row."""
    return docs.select("doc_id", _printed(F.col("text"), words).alias("fingerprint"))


def _flatten(root: np.ndarray) -> None:
    while True:
        further = root[root]
        if np.array_equal(further, root):
            return
        root[:] = further


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the groups of i and j; ``root`` stays flat."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        _flatten(root)


def _quarters(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values.view("<u2").reshape(-1, 4)).astype(np.int16)


def _runs(values: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """The values sorted by the counts of their quarters, and runs with the range of these."""
    counts = _quarters(values)
    order = np.lexsort(counts.T[::-1])
    values, counts = values[order], counts[order]
    return values, [
        (at, min(at + RUN, len(values)), counts[at:at + RUN].min(0), counts[at:at + RUN].max(0))
        for at in range(0, len(values), RUN)
    ]


def link_forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles of different values, or within one."""
    a, runs_a = _runs(left)
    b, runs_b = (a, runs_a) if right is None else _runs(right)
    shift = 0 if right is None else len(a)
    nodes = a if right is None else np.concatenate([a, b])
    root = np.arange(len(nodes))
    low_b = np.array([r[2] for r in runs_b])
    high_b = np.array([r[3] for r in runs_b])
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for k, (start, end, low, high) in enumerate(runs_a):
        gap = np.maximum(0, np.maximum(low_b - high, low - high_b)).sum(1)
        for m in np.flatnonzero(gap <= radius):
            if right is None and m < k:
                continue
            first, last = runs_b[m][:2]
            near = np.bitwise_count(a[start:end, None] ^ b[None, first:last]) <= radius
            i, j = np.nonzero(near)
            i, j = i + start, j + first + shift
            apart = root[i] != root[j]
            if apart.any():
                pending.append((i[apart], j[apart]))
                waiting += len(pending[-1][0])
                if waiting > PENDING:
                    _merge(root, *map(np.concatenate, zip(*pending)))
                    pending, waiting = [], 0
    if pending:
        _merge(root, *map(np.concatenate, zip(*pending)))
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (left list, right list or null) to rows (u, v)."""
    for batch in batches:
        for left, right in zip(batch.column(0), batch.column(1)):
            one = left.values.to_numpy(zero_copy_only=False).view(np.uint64)
            two = right.values.to_numpy(zero_copy_only=False).view(np.uint64) if right.is_valid else None
            u, v = link_forest(one, two, radius)
            if len(u):
                yield pa.record_batch({"u": u.view(np.int64), "v": v.view(np.int64)})


def tile_pairs(different: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Rows (left, right) of tiles that can hold links; right is null for a tile and itself."""
    spark = different.sparkSession
    half = (1 << 32) - 1
    placed = different.select(
        "fingerprint",
        F.bit_count(F.col("fingerprint").bitwiseAND(F.lit(half))).alias("x"),
        F.bit_count(F.shiftrightunsigned("fingerprint", 32)).alias("y"),
    )
    # one row per cell: 1,089 at most, whatever the input
    cells = placed.groupBy("x", "y").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("n")).collect()
    cells = spark.createDataFrame([tuple(r) for r in cells], "x int, y int, n int")
    tiles = (
        placed.join(F.broadcast(cells), ["x", "y"])
        .withColumn("t", F.pmod(F.xxhash64("fingerprint"), F.col("n")).cast("int"))
        .groupBy("x", "y", "t").agg(F.collect_list("fingerprint").alias("held"))
    )
    steps = [(dx, dy) for dx in range(radius + 1) for dy in range(-radius, radius + 1)
             if dx + abs(dy) <= radius and (dx > 0 or dy >= 0)]
    step = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps)))
    other = F.broadcast(cells.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("n").alias("n2")))
    pairs = (
        cells.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("step", step)
        .select("x", "y", "t", (F.col("x") + F.col("step.dx")).alias("x2"), (F.col("y") + F.col("step.dy")).alias("y2"))
        .join(other, ["x2", "y2"])
        .withColumn("t2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
        .where("x <> x2 or y <> y2 or t <= t2").drop("n2")
    )
    tiles = stage_table(tiles, "tiles")
    second = tiles.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("t").alias("t2"), F.col("held").alias("right"))
    same = F.expr("x = x2 and y = y2 and t = t2")
    return (
        pairs.join(tiles.withColumnRenamed("held", "left"), ["x", "y", "t"])
        .join(second, ["x2", "y2", "t2"])
        .select("left", F.when(~same, F.col("right")).alias("right"))
    )


def _rooted(printed: DataFrame, radius: int, tile: int) -> DataFrame:
    """(fingerprint, least, root) of every different fingerprint: its smallest id, and its group."""
    ship_module(__name__)
    different = stage_table(printed.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "different")
    edges = tile_pairs(different, radius, tile).mapInArrow(lambda it: _compare(it, radius), "u long, v long")
    roots = components(edges).select(F.col("node").alias("fingerprint"), "root")
    return stage_table(different.join(roots, "fingerprint", "left")
                       .withColumn("root", F.coalesce("root", "fingerprint")), "rooted")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint long, component_id) of every row of ``docs``."""
    printed = stage_table(fingerprints(docs, words), "fingerprints")
    rooted = _rooted(printed, radius, tile)
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage_table(rooted.join(groups, "root").select("fingerprint", "component_id"), "named")
    return printed.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """The documents, all their columns, with one row left of each group.

    The row with the group's id stays, a row without an id where the group has
    none. An id may stand on different texts, so rows are told apart by id and
    fingerprint: groups with the same id keep one row each. Of rows alike in
    both, which are of one group, one stays.
    """
    key, mark, kept_mark = (free_name(docs, n) for n in ("kept_id", "print", "kept_print"))
    # written with the documents, so that no text is read for its fingerprint twice
    marked = stage_table(docs.withColumn(mark, _printed(docs["text"], words)), "marked")
    rooted = _rooted(marked.select("doc_id", F.col(mark).alias("fingerprint")), radius, tile)
    # ids before null, then the smallest id, then the smallest fingerprint that has it
    first = F.min(F.struct(F.col("least").isNull().alias("nameless"), "least", "fingerprint")).alias("first")
    kept = stage_table(rooted.groupBy("root").agg(first).select(
        F.col("first.least").alias(key), F.col("first.fingerprint").alias(kept_mark)), "kept")
    same = marked["doc_id"].eqNullSafe(kept[key]) & (marked[mark] == kept[kept_mark])
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", mark]).drop(mark)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
