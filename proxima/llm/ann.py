"""Approximate nearest neighbours: inverted lists scanned dimension block by block.

Centroids fitted on a bounded sample deal all vectors into lists. Vectors are
turned by a random rotation, which spreads every difference evenly over the
dimensions, and are stored in column blocks. Within a probed list a scan adds up
squared differences block by block and drops a candidate as soon as a hypothesis
test says that its distance exceeds the tenth best so far: after d of D
dimensions a true distance r shows up as at least r sqrt(d / D) / (1 + EPSILON /
sqrt(d)) with high probability. Survivors are measured again on the original
vectors in double precision, so every score is exact.

Lists are cut into tiles and the queries of a list into blocks, both of bounded
size, so a list with a third of all rows is many units of work. A query that met
too few candidates in its lists is asked again in all of them.

Defined results: vectors that are null, zero, of another length than most, or
that hold null or non-finite components take no part, nor do rows with a null
id. Rows that repeat a query's id are its own and no candidates; such a query
is asked once, with its smallest vector. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxima.llm.common import ship_module, stage_table, table, uniform

NEAREST = 10
#: Sample bound for fitting centroids; the lists are about the square root of the rows, up to MOST_LISTS.
SAMPLE = 20_000
MOST_LISTS = 1024
STEPS = 8
#: Share of the lists that each query probes; recall against brute force is measured in the tests.
PROBED = 0.65
EPSILON = 2.1
BLOCKS = 4
TILE = 4096
QUERY_BLOCK = 256
CHUNK = 1024
SEED = 4


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select("vec_id", v.alias("vector")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (common["d"] if common else 0))


def centroids_of(sample: np.ndarray, lists: int, seed: int = SEED) -> np.ndarray:
    """Lloyd's steps from random different rows of the sample; an emptied list keeps its place."""
    start = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centre = start[rng.permutation(len(start))[:lists]]
    for _ in range(STEPS):
        near = nearest_lists(sample, centre, 1)[:, 0]
        size = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    return centre


def nearest_lists(rows: np.ndarray, centre: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((len(rows), n), np.int64)
    for at in range(0, len(rows), 2048):
        far = (centre * centre).sum(1) - 2.0 * rows[at:at + 2048] @ centre.T
        out[at:at + 2048] = np.argmin(far, 1)[:, None] if n == 1 else np.argsort(far, 1, kind="stable")[:, :n]
    return out


def rotation_of(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def _deal(batches, centre: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, vector) to rows (list, vec_id, vector, serial), one for each of the nearest lists."""
    serial = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        near = nearest_lists(_matrix(batch.column(1), centre.shape[1]), centre, probes)
        again = np.repeat(np.arange(batch.num_rows), probes)
        rows = batch.take(pa.array(again))
        yield pa.record_batch({
            "list": near.ravel().astype(np.int32), "vec_id": rows.column(0), "vector": rows.column(1),
            "serial": np.arange(serial, serial + len(again)),
        })
        serial += len(again)


def _pack(group: pa.Table, rotation: np.ndarray) -> pa.Table:
    """The rows of one part of a list as a single row: ids, rotated column blocks, originals."""
    d = len(rotation)
    ids = group.column("vec_id").to_numpy()
    vectors = _matrix(group.column("vector").combine_chunks(), d)
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    turned = (vectors @ rotation).astype(np.float32)
    blocks = [np.ascontiguousarray(b).tobytes() for b in np.array_split(turned, min(BLOCKS, d), axis=1)]
    return pa.table({
        "list": group.column("list")[:1], "part": group.column("part")[:1],
        "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
        "blocks": pa.array([blocks], pa.list_(pa.binary())), "vectors": pa.array([vectors.tobytes()], pa.binary()),
    })


PACKED = "list int, part int, ids binary, blocks array<binary>, vectors binary"


def scan(query: np.ndarray, turned: list[np.ndarray], own: int, ids: np.ndarray, blocks: list[np.ndarray],
         vectors: np.ndarray, nearest: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and ids of the nearest rows of a tile, by (distance, id)."""
    d = vectors.shape[1]
    best, names = np.zeros(0), np.zeros(0, np.int64)
    for at in range(0, len(ids), CHUNK):
        alive = np.flatnonzero(ids[at:at + CHUNK] != own) + at
        limit = best[-1] if len(best) == nearest else np.inf
        partial, seen = np.zeros(len(alive), np.float32), 0
        for block, part in zip(blocks, turned):
            gap = block[alive] - part
            partial = partial + np.einsum("ij,ij->i", gap, gap)
            seen += len(part)
            # the last test is the plain comparison, with room for the blocks' single precision
            bound = limit * (seen / d * (1 + epsilon / np.sqrt(seen)) ** 2 if seen < d else 1 + 1e-5) + 1e-9
            stay = partial <= bound
            alive, partial = alive[stay], partial[stay]
        if len(alive) > nearest:
            stay = partial <= np.partition(partial, nearest - 1)[nearest - 1] * (1 + 1e-5) + 1e-9
            alive = alive[stay]
        gap = vectors[alive] - query
        best = np.concatenate([best, (gap * gap).sum(1)])
        names = np.concatenate([names, ids[alive]])
        order = np.lexsort((names, best))[:nearest]
        best, names = best[order], names[order]
    return best, names


def _scan_units(batches, d: int, nearest: int) -> Iterator[pa.RecordBatch]:
    """Rows of a tile and a block of queries to rows (query_id, vec_id, score)."""
    def matrix(cell, kind=np.float64):
        return np.frombuffer(cell.as_py(), kind)

    widths = [len(x) for x in np.array_split(np.arange(d), min(BLOCKS, d))]
    for batch in batches:
        for row in range(batch.num_rows):
            ids, query_ids = matrix(batch.column("ids")[row], np.int64), matrix(batch.column("query_ids")[row], np.int64)
            vectors, queries = (matrix(batch.column(c)[row]).reshape(-1, d) for c in ("vectors", "queries"))
            blocks, turned = ([np.frombuffer(b, np.float32).reshape(-1, w) for b, w in zip(batch.column(c)[row].as_py(), widths)]
                              for c in ("blocks", "query_blocks"))
            asked, found, score = [], [], []
            for q, own in enumerate(query_ids):
                far, names = scan(queries[q], [b[q] for b in turned], own, ids, blocks, vectors, nearest)
                asked.append(np.full(len(names), own))
                found.append(names)
                score.append(np.sqrt(far))
            yield pa.record_batch({"query_id": np.concatenate(asked), "vec_id": np.concatenate(found),
                                   "score": np.concatenate(score)})


def _parts(dealt: DataFrame, size: int) -> DataFrame:
    """``dealt`` with a part number, so that each (list, part) has about ``size`` rows."""
    # one row per list, and lists are MOST_LISTS at most
    counts = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("parts"))
    return dealt.join(F.broadcast(counts), "list").withColumn("part", F.pmod("serial", "parts").cast("int"))


class Index:
    """Packed tiles of every row, in the shared folder, with the model that dealt them."""

    def __init__(self, rows: DataFrame, probed: float = PROBED):
        ship_module(__name__)
        self.rows, self.spark = rows, rows.sparkSession
        self.count = rows.count()
        if not self.count:
            return
        part = rows.where(uniform(F.col("vec_id"), SEED) < min(1.0, SAMPLE / self.count)).select("vector")
        sample = np.array([r[0] for r in part.collect()])
        if not len(sample):
            sample = np.array([r[0] for r in rows.select("vector").limit(1000).collect()])
        self.d = sample.shape[1]
        self.centre = centroids_of(sample, int(np.clip(np.sqrt(self.count), 1, MOST_LISTS)))
        self.rotation = rotation_of(self.d)
        self.probes = max(1, int(np.ceil(probed * len(self.centre))))
        self.tiles = stage_table(self._packed(rows, 1, TILE), "tiles")

    def _packed(self, rows: DataFrame, probes: int, size: int) -> DataFrame:
        centre, rotation = self.centre, self.rotation
        dealt = rows.select("vec_id", "vector").mapInArrow(
            lambda it: _deal(it, centre, probes), "list int, vec_id long, vector array<double>, serial long")
        parts = _parts(stage_table(dealt, "dealt"), size)
        return parts.groupBy("list", "part").applyInArrow(lambda t: _pack(t, rotation), PACKED)

    def _ask(self, queries: DataFrame, probes: int, nearest: int) -> DataFrame:
        asked = stage_table(self._packed(queries, probes, QUERY_BLOCK), "asked")
        blocks = asked.select("list", F.col("part").alias("block"), F.col("ids").alias("query_ids"),
                              F.col("blocks").alias("query_blocks"), F.col("vectors").alias("queries"))
        # every tile meets every block of its list; units are dealt out one by one
        of = lambda df, name: df.groupBy("list").agg((F.max(name) + 1).alias(f"{name}s"))
        sizes = of(self.tiles, "part").join(of(blocks, "block"), "list")
        units = sizes.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "blocks").select(
            "list", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        d = self.d
        found = units.join(self.tiles, ["list", "part"]).join(blocks, ["list", "block"]).mapInArrow(
            lambda it: _scan_units(it, d, nearest), "query_id long, vec_id long, score double")
        return stage_table(found, "found")

    def search(self, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
        """(query_id, rank, vec_id, score) for each row of ``queries(vec_id, vector)``."""
        if not self.count:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
        found = self._ask(queries, self.probes, nearest)
        if self.probes < len(self.centre):
            met = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= nearest)
            few = stage_table(queries.join(met, F.col("vec_id") == F.col("query_id"), "left_anti"), "few")
            if not few.isEmpty():
                again = self._ask(few, len(self.centre), nearest)
                found = found.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
        return ranked(found, nearest)


def ranked(found: DataFrame, nearest: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select(
        "query_id", "rank", "vec_id", "score")


def is_query(vec_id: Column) -> Column:
    return vec_id % 100 == 0


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return Index(rows).search(rows.where(is_query(F.col("vec_id"))))
