"""Hard-negative mining with rotated one-bit codes and deterministic intervals.

A score is the integer inner product of two whole-number vectors. An anchor's
positives are its best rows of the same label; its hard negatives are the best
rows of other labels whose score lies in a band below a positive's.

Rows are dealt into tiles of about TILE rows. A tile keeps its mean c; what is left of
a row, w, is turned by one rotation and coded by the signs of its dimensions, x (one
bit each). Beside the code two numbers are stored: how far w goes along the code
vector, ``along`` = <x, w> / sqrt(d), and what it has across it, ``across`` =
sqrt(|w|^2 - along^2). For a turned anchor q and t = <x, q> / sqrt(d),

    <q, w> lies in along * t +- across * sqrt(|q|^2 - t^2)        (Cauchy-Schwarz)

with certainty, so filtering loses nothing. t comes from population counts: q is
rounded to PLANES bits a dimension, t is a weighted sum of counts of code AND plane,
and the rounding's exact L1 error widens the interval. A row whose interval can't
reach the anchor's worst kept score, or misses every band, is never looked at again;
the others are scored in whole numbers.

How much that spares depends on the data: the interval is 0.6 |q| |w| to either side
for a typical w, so tiles of near vectors are mostly passed over and vectors spread
over a sphere of few dimensions are mostly scored. Results are the same.

Tiles are made within groups of labels, so positives only meet tiles of their group, and a
label that holds a third of all rows is many tiles. Within a group rows lie in order of the first
KEY_BITS bits of their turned vectors, so that a tile holds near ones; a key that many rows share is
cut by row number. Anchors lie in blocks of
ANCHORS rows. A unit of work is a block and about the square root of all tiles, which
pass one by one through a task with the block's best rows so far; it gives up at most
POSITIVES or NEGATIVES rows for each anchor and band. The stated anchors meet all rows in blocks;
nothing is broadcast.

Defined results. Rows take no part whose id, label or vector is null, that hold a null
or non-finite component, whose vector is empty or of another length than most, or with a component beyond
sqrt(2^62 / d), whose scores no long holds. An anchor whose id is on several rows is
the least of them, and all rows of that id are its own, neither positives nor negatives. Other
rows that repeat each count. Ties go to the smaller vec_id. An anchor without positives, and
a positive with an empty band, give no rows. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxima.llm.common import ship_module, stage_table, table

POSITIVES = 5
NEGATIVES = 10
#: Of a positive's score, in hundredths.
LOWEST, HIGHEST = 30, 90
LABEL_GROUPS = 64
TILE = 1024
ANCHORS = 256
KEY_BITS = 10
PLANES = 7
SEED = 12
#: For the rounding of the bounds themselves.
SLACK = 1e-9


def whole_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, components floor(256 x) as doubles."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x * 256))
    most = F.sqrt(F.lit(float(2**62)) / F.size(v))
    rows = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine)
    rows = rows.where(F.forall(scaled, lambda x: F.abs(x.cast("double")) < most)).select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), scaled.cast("array<double>").alias("vector"))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (common["d"] if common else 0))


def rotation_of(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encode(vectors: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, ...]:
    """(centre, codes, along, across) of a tile."""
    centre = vectors.mean(0)
    turned = (vectors - centre) @ rotation
    along = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
    across = np.sqrt(np.maximum((turned * turned).sum(1) - along * along, 0.0))
    return centre, _words(turned >= 0), along, across


def keys_of(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """The first bits of each turned vector as one number."""
    bits = vectors @ rotation[:, :KEY_BITS] >= 0
    return bits @ (1 << np.arange(bits.shape[1])[::-1])


class Asked:
    """A block of anchors, rounded for population counts."""

    def __init__(self, vectors: np.ndarray, rotation: np.ndarray):
        self.vectors, self.d = vectors, vectors.shape[1]
        turned = vectors @ rotation
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / (2**PLANES - 1), 1e-300)
        level = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, 2**PLANES - 1).astype(np.int64)
        self.planes = [_words((level >> k & 1).astype(bool)) for k in range(PLANES)]
        self.total = level.sum(1)
        self.error = np.abs(turned - self.low[:, None] - self.step[:, None] * level).sum(1) / math.sqrt(self.d)
        self.norm = np.sqrt((vectors * vectors).sum(1))

    def intervals(self, centre, codes, along, across) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of every score, [anchor, row]."""
        ones = np.bitwise_count(codes).sum(1).astype(np.int64)
        held = np.zeros((len(self.vectors), len(codes)), np.int64)
        for k, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                held += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.int64) << k
        # signs are twice the bit less one
        t = (self.step[:, None] * (2 * held - self.total[:, None]) + self.low[:, None] * (2 * ones - self.d)[None, :]) / math.sqrt(self.d)
        error = self.error[:, None] * (1 + SLACK) + SLACK * self.norm[:, None]
        nearest = np.maximum(np.abs(t) - error, 0.0)
        width = error * along + across * np.sqrt(np.maximum((self.norm * self.norm)[:, None] - nearest * nearest, 0.0))
        middle = (self.vectors @ centre)[:, None] + along * t
        width += SLACK * self.norm[:, None] * (np.sqrt(centre @ centre) + along + across) + SLACK
        return middle - width, middle + width

    def scores(self, at: int, rows: np.ndarray) -> np.ndarray:
        """Exact scores of anchor ``at``, in whole numbers."""
        q = self.vectors[at]
        most = np.sqrt((rows * rows).sum(1).max(initial=0.0)) * self.norm[at]
        # sums of doubles are exact below 2^53, and no partial sum exceeds the product of the norms
        return (rows @ q if most < 2.0**52 else rows.astype(np.int64) @ q.astype(np.int64)).astype(np.int64)


class _Tile:
    def __init__(self, row: dict, d: int):
        read = lambda name, kind=np.float64: np.frombuffer(row[name], kind)
        self.ids, self.labels = read("ids", np.int64), read("labels", np.int64)
        self.vectors = read("vectors").reshape(-1, d)
        self.code = (read("centre"), read("codes", np.uint64).reshape(len(self.ids), -1), read("along"), read("across"))


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:n]


class Nearest:
    """A block's best rows of the same label, over the tiles it has seen."""

    NAMES = ("anchor_id", "positive_id", "positive_score")

    def __init__(self, row: dict, d: int, rotation: np.ndarray):
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.asked = Asked(np.frombuffer(row["vectors"], np.float64).reshape(-1, d), rotation)
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.ids]
        self.seen = self.scored = 0

    def see(self, tile: _Tile) -> None:
        low, high = self.asked.intervals(*tile.code)
        fit = (tile.labels[None, :] == self.labels[:, None]) & (tile.ids[None, :] != self.ids[:, None])
        floor = np.array([s[POSITIVES - 1] if len(s) >= POSITIVES else -np.inf for s, _ in self.kept])
        if len(tile.ids) >= POSITIVES:
            sure = np.partition(np.where(fit, low, -np.inf), -POSITIVES, axis=1)[:, -POSITIVES]
            floor = np.maximum(floor, sure)
        stay = fit & (high >= floor[:, None])
        self.seen, self.scored = self.seen + int(fit.sum()), self.scored + int(stay.sum())
        for at in np.flatnonzero(stay.any(1)):
            held = np.flatnonzero(stay[at])
            scores = np.concatenate([self.kept[at][0], self.asked.scores(at, tile.vectors[held])])
            ids = np.concatenate([self.kept[at][1], tile.ids[held]])
            order = _best(scores, ids, POSITIVES)
            self.kept[at] = scores[order], ids[order]

    def rows(self) -> tuple[np.ndarray, ...]:
        n = [len(s) for s, _ in self.kept]
        return np.repeat(self.ids, n), np.concatenate([i for _, i in self.kept]), np.concatenate([s for s, _ in self.kept])


class Banded:
    """A block's best rows of other labels within the bands of its positives."""

    NAMES = ("anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score")

    def __init__(self, row: dict, d: int, rotation: np.ndarray):
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.asked = Asked(np.frombuffer(row["vectors"], np.float64).reshape(-1, d), rotation)
        # [anchor, place], empty bands where there is no positive
        shape = (len(self.ids), POSITIVES)
        self.positive = np.frombuffer(row["positive_ids"], np.int64).reshape(shape)
        self.score = np.frombuffer(row["positive_scores"], np.int64).reshape(shape)
        there = np.arange(POSITIVES) < np.frombuffer(row["positives"], np.int64)[:, None]
        # whole parts first, as hundredfold scores need not fit
        part = lambda hundredths: self.score // 100 * hundredths + self.score % 100 * hundredths // 100
        rest = self.score % 100 * LOWEST % 100
        self.low, self.high = part(LOWEST) + (rest > 0), np.where(there, part(HIGHEST), np.iinfo(np.int64).min)
        self.floor = self.low.astype(np.float64)
        self.kept = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * POSITIVES for _ in self.ids]
        self.seen = self.scored = 0

    def see(self, tile: _Tile) -> None:
        low, high = self.asked.intervals(*tile.code)
        fit = (tile.labels[None, :] != self.labels[:, None]) & (tile.ids[None, :] != self.ids[:, None])
        stay = np.zeros_like(fit)
        for k in range(POSITIVES):
            open_ = self.low[:, k] <= self.high[:, k]
            stay |= (high >= self.floor[:, k, None]) & (low <= self.high[:, k, None]) & open_[:, None]
        stay &= fit
        self.seen, self.scored = self.seen + int(fit.sum()), self.scored + int(stay.sum())
        for at in np.flatnonzero(stay.any(1)):
            held = np.flatnonzero(stay[at])
            scores, ids = self.asked.scores(at, tile.vectors[held]), tile.ids[held]
            for k in range(POSITIVES):
                fine = (scores >= max(self.low[at, k], self.floor[at, k])) & (scores <= self.high[at, k])
                if not fine.any():
                    continue
                s, i = (np.concatenate(x) for x in zip(self.kept[at][k], (scores[fine], ids[fine])))
                order = _best(s, i, NEGATIVES)
                self.kept[at][k] = s[order], i[order]
                if len(order) == NEGATIVES:
                    self.floor[at, k] = s[order[-1]]

    def rows(self) -> tuple[np.ndarray, ...]:
        n = np.array([[len(s) for s, _ in bands] for bands in self.kept])
        place = np.broadcast_to(np.arange(POSITIVES), n.shape)
        each = lambda x: np.repeat(x.ravel(), n.ravel())
        flat = [b for bands in self.kept for b in bands]
        return (each(np.broadcast_to(self.ids[:, None], n.shape)), each(place), each(self.positive), each(self.score),
                np.concatenate([i for _, i in flat]), np.concatenate([s for s, _ in flat]))


# ---- dealing tiles and blocks

def _bytes(a: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())


def _matrix(column, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def _pack_tile(group: pa.Table, rotation: np.ndarray) -> pa.Table:
    vectors = _matrix(group.column("vector"), len(rotation))
    centre, codes, along, across = encode(vectors, rotation)
    return pa.table({
        "grp": group.column("grp")[:1], "part": group.column("part")[:1],
        "ids": _bytes(group.column("vec_id").to_numpy()), "labels": _bytes(group.column("label").to_numpy()),
        "vectors": _bytes(vectors), "centre": _bytes(centre), "codes": _bytes(codes), "along": _bytes(along), "across": _bytes(across),
    })


TILES = "grp int, part int, ids binary, labels binary, vectors binary, centre binary, codes binary, along binary, across binary"


def _pack_block(group: pa.Table, d: int) -> pa.Table:
    n = group.num_rows
    out = {
        "grp": group.column("grp")[:1], "part": group.column("part")[:1],
        "ids": _bytes(group.column("vec_id").to_numpy()), "labels": _bytes(group.column("label").to_numpy()),
        "vectors": _bytes(_matrix(group.column("vector"), d)),
    }
    found = group.column("found").to_pylist() if "found" in group.column_names else [None] * n
    ids, scores = np.zeros((n, POSITIVES), np.int64), np.zeros((n, POSITIVES), np.int64)
    for at, row in enumerate(found):
        for place, x in enumerate(row or ()):
            ids[at, place], scores[at, place] = x["positive_id"], x["positive_score"]
    out |= {"positives": _bytes(np.array([len(x or ()) for x in found], np.int64)), "positive_ids": _bytes(ids), "positive_scores": _bytes(scores)}
    return pa.table(out)


BLOCKS = "grp int, part int, ids binary, labels binary, vectors binary, positives binary, positive_ids binary, positive_scores binary"


def _pass_tiles(batches, kind: type, d: int, rotation: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks, each before the tiles of its unit, to the rows that a unit keeps."""
    names = kind.NAMES

    def out(block) -> Iterator[pa.RecordBatch]:
        if block is not None:
            yield pa.record_batch([pa.array(c.astype(np.int64)) for c in block.rows()], names=names)

    block = None
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if row["codes"] is None:
                yield from out(block)
                block = kind(row, d, rotation)
            else:
                block.see(_Tile(row, d))
    yield from out(block)


def _keyed(batches, rotation: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield batch.append_column("key", pa.array(keys_of(vectors, rotation).astype(np.int32)))


class _Deal:
    """Sizes of the label groups, as parts of about ``size`` rows; LABEL_GROUPS entries, whatever the data."""

    def __init__(self, rows: DataFrame, size: int):
        counts = {r["grp"]: r["n"] for r in rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.parts = [-(-counts.get(g, 0) // size) for g in range(LABEL_GROUPS)]
        self.first = [sum(self.parts[:g]) for g in range(LABEL_GROUPS)]
        self.total = sum(self.parts)

    @staticmethod
    def at(values: list[int]) -> Column:
        return F.get(F.array(*(F.lit(int(v)) for v in values)), F.col("grp"))

    def numbered(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.pmod("serial", self.at(self.parts)).cast("int"))


class Miner:
    """``rows(vec_id, label, vector)`` of whole numbers, packed once in the shared folder."""

    def __init__(self, rows: DataFrame, anchors: Column):
        ship_module(__name__)
        self.spark = rows.sparkSession
        first = rows.select(F.size("vector").alias("d")).first()
        self.d = first["d"] if first else 0
        self.rotation = rotation = rotation_of(max(self.d, 1))
        grouped = rows.select("vec_id", "label", "vector", F.pmod(F.hash("label"), F.lit(LABEL_GROUPS)).cast("int").alias("grp")).mapInArrow(
            lambda it: _keyed(it, rotation), "vec_id long, label long, vector array<double>, grp int, key int")
        self.rows = stage_table(grouped.withColumn("serial", F.monotonically_increasing_id()), "vectors")
        chosen = self.rows.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "vector", "grp")).alias("v")).select("vec_id", "v.*")
        self.anchors = stage_table(chosen.withColumn("serial", F.monotonically_increasing_id()), "anchors")
        self.deal, self.asked = _Deal(self.rows, TILE), _Deal(self.anchors, ANCHORS)
        # one row for each group and key, LABEL_GROUPS * 2^KEY_BITS at most
        before = Window.partitionBy("grp").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        places = self.rows.groupBy("grp", "key").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        part = F.floor((F.col("start") + F.pmod("serial", "n")) / TILE).cast("int")
        self.tiles = stage_table(
            self.rows.join(F.broadcast(places), ["grp", "key"]).select("grp", part.alias("part"), "vec_id", "label", "vector")
            .groupBy("grp", "part").applyInArrow(lambda t: _pack_tile(t, rotation), TILES), "tiles")

    def _search(self, anchors: DataFrame, kind: type, own_group: bool) -> DataFrame:
        """Every block of anchors past the tiles of its group, or of all groups."""
        d, rotation, deal, asked = self.d, self.rotation, self.deal, self.asked
        blocks = asked.numbered(anchors).groupBy("grp", "part").applyInArrow(lambda t: _pack_block(t, d), BLOCKS)
        number = asked.at(asked.first) + F.col("part")
        if own_group:
            shards = [math.isqrt(n) for n in deal.parts]
            met, shard = F.transform(F.sequence(F.lit(0), asked.at(asked.parts) - 1), lambda k: k + asked.at(asked.first)), F.col("part")
            tiles = self.tiles.where(asked.at(asked.parts) > 0)
            shard_of, shards_of = F.pmod(shard, deal.at(shards)), deal.at(shards)
        else:
            n = max(1, math.isqrt(deal.total))
            met, tiles = F.sequence(F.lit(0), F.lit(asked.total - 1)), self.tiles
            shard_of, shards_of = F.pmod(deal.at(deal.first) + F.col("part"), F.lit(n)), F.lit(n)
        unit = ["block", "shard"]
        heads = blocks.withColumn("block", number).withColumn("shard", F.explode(F.sequence(F.lit(0), shards_of - 1)))
        passing = tiles.withColumn("shard", shard_of).withColumn("block", F.explode(met))
        units = heads.unionByName(passing, allowMissingColumns=True).drop("grp", "part").repartition(*unit)
        return units.sortWithinPartitions(*unit, F.col("codes").isNotNull()).mapInArrow(
            lambda it: _pass_tiles(it, kind, d, rotation), ", ".join(f"{c} long" for c in kind.NAMES))

    def positives(self) -> DataFrame:
        """(anchor_id, place, positive_id, positive_score), place from 0."""
        if not self.asked.total:
            return self.spark.createDataFrame([], "anchor_id long, place int, positive_id long, positive_score long")
        order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        found = self._search(self.anchors, Nearest, True).withColumn("place", F.row_number().over(order) - 1)
        return found.where(F.col("place") < POSITIVES).select("anchor_id", "place", "positive_id", "positive_score")

    def negatives(self) -> DataFrame:
        """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
        if not self.asked.total:
            return self.spark.createDataFrame(
                [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        found = self.positives().groupBy(F.col("anchor_id").alias("vec_id")).agg(
            F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("found"))
        order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
        kept = self._search(self.anchors.join(found, "vec_id", "left"), Banded, False).withColumn("rank", F.row_number().over(order))
        return kept.where(F.col("rank") <= NEGATIVES).select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    rows = whole_vectors(table(spark, sf_dir, "embeddings"))
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return Miner(rows.withColumn("label", noisy), F.col("vec_id") % 100 == 0).negatives()
