"""Exact k-nearest-neighbour joins and N-th neighbour distances.

The plan, in Spark terms:

1. Coincident rows are folded into one position with a multiplicity
   (partial aggregation before the shuffle), so a position shared by a third of
   all rows is one row from here on.
2. Positions are range-partitioned and sorted along the Peano-Hilbert curve and
   cut into blocks at aligned ranges of the curve, which are boxes in space: each
   block is the largest such box with at most ``block_rows`` rows, and holds
   all the rows of its box. Rows of a cluster never lie inside the box of a
   sparse block next to it. While a block is cut, each of
   its queries learns a distance within which enough points are already known.
   The block table is written once to the shared folder.
3. One row per block (corners, counts, largest query bound) is joined with
   itself by ``overlap_join`` to find which blocks can matter to which. Bounds
   are tightened with what that join found.
   A query that knows only a distant bound is linked on its own.
4. Points near a block's queries are sent to it next to its own rows, and each
   block answers its queries. When the points sent to one block would exceed
   ``ghost_rows`` they are spread over several shares of it, each returns the
   nearest it saw, and the shares are merged. Nothing is dropped.

A block's answer is exact because every point within its queries' bounds is
sent to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import axis_gap, axis_reach, f32, is_periodic, periodic_pieces, square_sum, wrap_position
from ..functions.curve import curve_cell, peano_key
from ..model import XYZ
from ..session import ship, stage_table
from . import kernels
from .overlap import overlap_join

ship(kernels)

CURVE_BITS = 18
BLOCK_ROWS = 2048
MOST_BLOCK_ROWS = 65000
GHOST_ROWS = 65536
PARTITION_ROWS = 1 << 20
MERGED_SHARES = 8
# Positions with more rows than this, and than a MOST_HOT-th of all, are joined by broadcast.
HOT_ROWS = 1 << 20
MOST_HOT = 10_000
SLACK = 1 + 1e-5


def _cols(prefix):
    return [f"{prefix}_{c}" for c in ("x0", "y0", "z0", "x1", "y1", "z1")]


def _bounds(prefix, when):
    lows = [F.min(F.when(when, F.col(c))).alias(n) for c, n in zip(XYZ, _cols(prefix)[:3])]
    highs = [F.max(F.when(when, F.col(c))).alias(n) for c, n in zip(XYZ, _cols(prefix)[3:])]
    return lows + highs


def wrap_points(df: DataFrame, length) -> DataFrame:
    if not is_periodic(length):
        return df
    return df.withColumns({c: wrap_position(F.col(c), length) for c in XYZ})


def _positions(data, queries, n, with_ids) -> DataFrame:
    """Distinct positions with how many data rows and queries sit there.

    With ids, data rows stay single but at most ``n + 1`` of them are kept per
    position: the lowest ids are the only ones a list of ``n + 1`` can show.
    """
    same = queries is None
    if not with_ids:
        if same:
            return data.groupBy(*XYZ).agg(
                F.count("*").alias("nd"),
                F.count("*").alias("nq"),
                F.min(F.struct("fnum", "row_idx")).alias("_first"),
            ).select(*XYZ, "nd", "nq", F.col("_first.fnum").cast("bigint").alias("ia"), F.col("_first.row_idx").alias("ib"))
        zero = F.lit(0).cast("bigint")
        one = F.lit(1).cast("bigint")
        d = data.select(*XYZ, one.alias("nd"), zero.alias("nq"), zero.alias("ib"))
        q = queries.select(*XYZ, zero.alias("nd"), one.alias("nq"), F.col("halo_file_index").alias("ib"))
        return d.unionByName(q).groupBy(*XYZ).agg(
            F.sum("nd").alias("nd"),
            F.sum("nq").alias("nq"),
            F.min(F.when(F.col("nq") > 0, F.col("ib"))).alias("ib"),
        ).select(*XYZ, "nd", "nq", zero.alias("ia"), "ib")
    first = Window.partitionBy(*XYZ).orderBy("fnum", "row_idx")
    d = (
        data.select(*XYZ, "fnum", "row_idx", F.row_number().over(first).alias("_r"))
        .filter(F.col("_r") <= n + 1)
        .select(
            *XYZ,
            F.lit(1).cast("bigint").alias("nd"),
            F.lit(0).cast("bigint").alias("nq"),
            F.col("fnum").cast("bigint").alias("ia"),
            F.col("row_idx").alias("ib"),
        )
    )
    q = (data if same else queries).groupBy(*XYZ).agg(F.count("*").alias("nq")).select(
        *XYZ, F.lit(0).cast("bigint").alias("nd"), "nq",
        F.lit(-1).cast("bigint").alias("ia"), F.lit(-1).cast("bigint").alias("ib"),
    )
    return d.unionByName(q)


def _survey(tables):
    """Total row count and common extent: one pass over the raw rows, no shuffle."""
    total, lows, highs = 0, [], []
    for df in tables:
        row = df.agg(F.count("*"), *[F.min(c) for c in XYZ], *[F.max(c) for c in XYZ]).first()
        total += row[0]
        if row[0]:
            lows.append(row[1:4])
            highs.append(row[4:7])
    lo = [float(min(v)) for v in zip(*lows)] or [0.0] * 3
    hi = [float(max(v)) for v in zip(*highs)] or [0.0] * 3
    return total, lo, hi


def build_blocks(positions, survey, n, length, block_rows, max_radius=None) -> DataFrame:
    """Curve-ordered blocks of ``block_rows`` positions, written once."""
    blocks = cut_blocks(positions, survey, n, length, block_rows)
    if max_radius is not None:
        cap = (float(max_radius) * SLACK) ** 2
        blocks = blocks.withColumn("bound2", F.least(F.col("bound2"), F.lit(cap).cast("float")))
    return stage_table(blocks, "blocks")


def cut_blocks(positions, survey, n, length, block_rows) -> DataFrame:
    spark = positions.sparkSession
    row_count, lo, hi = survey
    length = float(length) if is_periodic(length) else -1.0
    if length > 0:
        lo, hi = [0.0] * 3, [length] * 3
    # One scale for all axes, so that blocks are compact in true distance.
    side = max(b - a for a, b in zip(lo, hi))
    hi = [a + side for a in lo]
    cells = [
        curve_cell(F.col(c), f32(a), f32(b), CURVE_BITS) for c, a, b in zip(XYZ, lo, hi)
    ]
    # Rows without a place come first.
    key = F.coalesce(peano_key(*cells, bits=CURVE_BITS), F.lit(-1).cast("bigint"))
    keyed = positions.withColumn("_key", key)
    # As many partitions as the rows call for; small tables still use every core.
    parts = max(1, -(-row_count // PARTITION_ROWS),
                min(spark.sparkContext.defaultParallelism, row_count // (4 * block_rows)))
    order = ["_key", *XYZ, "ia", "ib"]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = "px float, py float, pz float, nd bigint, nq bigint, ia bigint, ib bigint, bound2 float, block bigint, unit bigint, solo boolean"
    cutter = kernels.block_cutter(block_rows, n, length, 3 * CURVE_BITS, parts == 1)
    return ordered.mapInArrow(cutter, schema)


def _grown(ask: DataFrame, per, scale) -> DataFrame:
    """The asking boxes grown by their reach, cut into pieces where the volume is periodic."""
    grown = {}
    for i, axis in enumerate("xyz"):
        low = F.col(_cols("q")[i]).cast("double") - F.col("reach")
        high = F.col(_cols("q")[i + 3]).cast("double") + F.col("reach")
        grown[axis] = (low, high)
    probe = ask
    if per:
        for axis, (low, high) in grown.items():
            # More than one turn covers the axis completely.
            whole = F.array(F.struct(f32(0.0).alias("lo"), f32(per).alias("hi")))
            parts = F.when(high - low >= per, whole).otherwise(
                periodic_pieces(low.cast("float"), high.cast("float"), per)
            )
            probe = probe.withColumn(f"_p{axis}", F.explode(parts))
        eps = 1e-6 * scale
        probe = probe.select(
            *ask.columns,
            *[(F.col(f"_p{a}.lo").cast("double") - eps).alias(f"g_{a}0") for a in "xyz"],
            *[(F.col(f"_p{a}.hi").cast("double") + eps).alias(f"g_{a}1") for a in "xyz"],
        )
    else:
        probe = probe.select(
            *ask.columns,
            *[grown[a][0].alias(f"g_{a}0") for a in "xyz"],
            *[grown[a][1].alias(f"g_{a}1") for a in "xyz"],
        )
    return probe


def link_blocks(blocks, n, length, ghost_rows, max_radius=None):
    """Which blocks' points must be shown to which blocks' queries.

    Returns (links, heavy): links has one row per pair with the reach of the
    asking block and the share the pair belongs to; heavy lists the asking
    blocks that need more than one share, or is None.
    """
    per = float(length) if is_periodic(length) else None
    asks = (F.col("nq") > 0) & ~F.col("solo")
    meta = blocks.groupBy("block").agg(
        *_bounds("d", F.col("nd") > 0),
        *_bounds("q", asks),
        F.coalesce(F.sum("nd"), F.lit(0)).alias("weight"),
        F.count(F.when(F.col("nd") > 0, 1)).alias("rows"),
        F.max(F.when(asks, F.sqrt(F.col("bound2").cast("double")))).alias("reach"),
    )
    meta = stage_table(meta, "block-extents")
    edge = meta.agg(
        *[F.min(c) for c in _cols("d")[:3]], *[F.max(c) for c in _cols("d")[3:]],
        F.max_by(F.struct(*_cols("d")), F.when(F.col("weight") > n, F.col("weight"))),
        F.count("*"),
    ).first()
    if edge[0] is None or edge[7] == 1:
        return None, None
    lo, hi = ([0.0] * 3, [per] * 3) if per else ([float(v) for v in edge[:3]], [float(v) for v in edge[3:6]])
    diag = sum((h - l) ** 2 for l, h in zip(lo, hi)) ** 0.5
    scale = per or max(abs(v) for v in (*lo, *hi))

    # A block that met too few points while it was cut knows no bound yet: any
    # full block gives one, else everything is in reach.
    qlo, qhi = [F.col(c) for c in _cols("q")[:3]], [F.col(c) for c in _cols("q")[3:]]
    dlo, dhi = [F.col(c) for c in _cols("d")[:3]], [F.col(c) for c in _cols("d")[3:]]
    everything = square_sum(
        F.greatest(F.lit(h) - a.cast("double"), b.cast("double") - F.lit(l), F.lit(0.0))
        for a, b, l, h in zip(qlo, qhi, lo, hi)
    )
    if edge[6] is not None:
        full = list(edge[6])
        any_full = square_sum(
            axis_reach(a, b, F.lit(full[i]), F.lit(full[i + 3]), per)
            for i, (a, b) in enumerate(zip(qlo, qhi))
        )
    else:
        any_full = everything
    unbounded = F.sqrt(F.least(any_full, everything)) * SLACK
    if max_radius is not None:
        unbounded = F.least(unbounded, F.lit(float(max_radius) * SLACK))
    reach = F.when(F.col("reach") < F.lit(float("inf")), F.col("reach")).otherwise(unbounded)
    outliers = blocks.filter("solo").select(
        F.col("unit").alias("block"),
        *[F.col(c).alias(n) for c, n in zip(XYZ * 2, _cols("q"))],
        F.sqrt(F.col("bound2").cast("double")).alias("reach"),
    )
    asking = meta.select("block", *_cols("q"), "reach").unionByName(outliers)
    ask = asking.filter(F.col("reach").isNotNull()).select(
        F.col("block").alias("a"),
        *_cols("q"),
        (reach * F.lit(SLACK) + F.lit(1e-6 * scale)).alias("reach"),
    )
    have = meta.filter(F.col("rows") > 0).select(
        F.col("block").alias("b"), *_cols("d"), "weight", "rows"
    )
    probe = _grown(ask, per, scale)
    met = overlap_join(probe, have, _cols("g"), _cols("d"), lo, hi)
    met = met.withColumn(
        "gap2", square_sum(axis_gap(a, b, c, d, per) for a, b, c, d in zip(qlo, qhi, dlo, dhi))
    ).withColumn(
        "far2", square_sum(axis_reach(a, b, c, d, per) for a, b, c, d in zip(qlo, qhi, dlo, dhi))
    ).filter(F.col("gap2") <= F.col("reach") * F.col("reach"))
    if per:
        met = met.groupBy("a", "b").agg(*[
            F.first(c).alias(c)
            for c in ("reach", "gap2", "far2", "weight", "rows", *_cols("q"))
        ])
    met = stage_table(
        met.select("a", "b", "reach", "gap2", "far2", "weight", "rows", *_cols("q")), "block-pairs"
    )
    tight = met.groupBy("a").agg(
        F.min(F.when(F.col("weight") > n, F.sqrt("far2"))).alias("_t")
    )
    links = (
        met.join(tight, "a")
        .withColumn(
            "reach",
            F.least("reach", F.coalesce(F.col("_t") * SLACK + 1e-6 * scale, F.col("reach"))),
        )
        .filter(
            (F.col("gap2") <= F.col("reach") * F.col("reach")) & (F.col("a") != F.col("b"))
        )
        .select("a", "b", "reach", "rows", *_cols("q"))
    )
    return _dealt(links, ghost_rows)


def _dealt(links: DataFrame, ghost_rows: int):
    """Links with the share each belongs to, and the units that need more than one, or None."""
    load = links.groupBy("a").agg(
        F.ceil(F.sum("rows") / F.lit(ghost_rows)).cast("int").alias("shares")
    )
    links = stage_table(
        links.join(load, "a").select(
            "a", "b", "reach", "shares", *_cols("q"),
            F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"),
        ),
        "block-links",
    )
    heavy = links.filter(F.col("shares") > 1).select("a", "shares").distinct()
    return links, (heavy if heavy.limit(1).count() else None)


def _search(blocks, own, links, n, length, ids, lists, shared=False) -> DataFrame:
    """Answer the queries of ``own``, shown the points that ``links`` names."""
    per = float(length) if is_periodic(length) else None
    payload = [*XYZ, "nd", "nq", "ia", "ib", "bound2"]
    rows = own.select("a", *payload, F.lit(False).alias("ghost"), "share")
    if links is not None:
        gap2 = square_sum(
            axis_gap(F.col(c), F.col(c), F.col(lo), F.col(hi), per)
            for c, lo, hi in zip(XYZ, _cols("q")[:3], _cols("q")[3:])
        )
        ghosts = (
            blocks.filter(F.col("nd") > 0)
            .withColumnRenamed("block", "b")
            .join(links, "b")
            .filter(gap2 <= F.col("reach") * F.col("reach"))
            .select("a", *payload, F.lit(True).alias("ghost"), "share")
        )
        rows = rows.unionByName(ghosts)
    schema = "px float, py float, pz float, nq bigint, ia bigint, ib bigint, "
    if lists:
        inner = "r2: float, w: bigint"
        if ids:
            inner = "r2: float, ia: bigint, ib: bigint, w: bigint"
        schema += f"near array<struct<{inner}>>"
        if shared:
            schema += ", share int"
    else:
        schema += "first_r2 float, nth_r2 float, next_r2 float"
    return rows.groupBy("a", "share").applyInArrow(
        kernels.group_search(n, per or -1.0, ids, lists, shared), schema
    )


def _answer(blocks, links, heavy, n, length, ids, lists) -> DataFrame:
    """All queries: most blocks in one piece, heavy ones share by share."""
    whole = F.lit(0).alias("share")
    if links is None:
        own = blocks.select("*", F.col("block").alias("a"), whole)
        return _search(blocks, own, None, n, length, ids, lists)
    # An outlier is a point of its block but asks as a unit of its own, to
    # which its block is linked like any other.
    none = F.lit(0).cast("bigint")
    own = blocks.withColumns({
        "a": F.col("block"), "nq": F.when(F.col("solo"), none).otherwise(F.col("nq"))
    }).unionByName(
        blocks.filter("solo").withColumns({"a": F.col("unit"), "nd": none})
    )
    return _by_shares(blocks, own, links, heavy, n, length, ids, lists)


def _by_shares(blocks, own, links, heavy, n, length, ids, lists) -> DataFrame:
    whole = F.lit(0).alias("share")
    if heavy is None:
        return _search(blocks, own.select("*", whole), links, n, length, ids, lists)
    light = _search(
        blocks, own.join(heavy, "a", "left_anti").select("*", whole),
        links.filter(F.col("shares") == 1), n, length, ids, lists,
    )
    split = own.join(heavy, "a").withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    )
    most = heavy.agg(F.max("shares")).first()[0]
    merged = _merge_shares(
        _search(blocks, split, links.filter(F.col("shares") > 1), n, length, ids, True, True), most, n
    )
    if lists:
        return light.unionByName(merged)
    return light.unionByName(merged.select(
        *XYZ, "nq", "ia", "ib",
        F.get("near", F.lit(0))["r2"].alias("first_r2"),
        _weighted_rank(F.col("near"), n).alias("nth_r2"),
        _weighted_rank(F.col("near"), n + 1).alias("next_r2"),
    ))


def _merge_shares(found: DataFrame, shares: int, n: int) -> DataFrame:
    """Join the lists of a block's shares into the n + 1 nearest per position.

    A few shares at a time, so that no row ever holds more than a few lists.
    """
    while True:
        shares = -(-shares // MERGED_SHARES)
        found = found.withColumn("share", F.floor(F.col("share") / MERGED_SHARES).cast("int")).groupBy(*XYZ, "share").agg(
            F.first("nq").alias("nq"), F.first("ia").alias("ia"), F.first("ib").alias("ib"),
            F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, n + 1).alias("near"),
        )
        if shares <= 1:
            return found.drop("share")


def _weighted_rank(near: Column, rank: int) -> Column:
    """r2 at which the running weight of a sorted list first reaches ``rank``."""
    end = F.aggregate(
        near,
        F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("float").alias("r2")),
        lambda acc, e: F.struct(
            (acc["seen"] + e["w"]).alias("seen"),
            F.when(acc["seen"] >= rank, acc["r2"]).otherwise(e["r2"]).alias("r2"),
        ),
    )
    return F.when(end["seen"] >= rank, end["r2"])


def rank_distances(data, queries, n, length=None, max_radius=None,
                   block_rows=BLOCK_ROWS, ghost_rows=GHOST_ROWS):
    """Squared distances at ranks 1, n, n+1 per distinct query position.

    Returns (result, blocks).
    """
    data = wrap_points(data, length)
    queries = wrap_points(queries, length) if queries is not None else None
    blocks, links, heavy = _prepare(
        data, queries, n, length, False, max_radius, block_rows, ghost_rows
    )
    return _answer(blocks, links, heavy, n, length, False, False), blocks


def _prepare(data, queries, n, length, ids, max_radius, block_rows, ghost_rows):
    if not 2 <= block_rows <= MOST_BLOCK_ROWS:
        raise ValueError(f"block_rows must be between 2 and {MOST_BLOCK_ROWS}, not {block_rows}")
    survey = _survey([data] if queries is None else [data, queries])
    blocks = build_blocks(_positions(data, queries, n, ids), survey, n, length, block_rows, max_radius)
    return (blocks, *link_blocks(blocks, n, length, ghost_rows, max_radius))


def _finish(df: DataFrame, r2: Column, max_radius, strict: bool) -> DataFrame:
    """Distance, and whether it can be trusted, from a squared distance.

    A distance beyond the search buffer, or with too few points to rank, is
    NULL and uncertified; ``strict`` makes it an error instead.
    """
    rnn = F.sqrt(r2).cast("float")
    ok = rnn.isNotNull()
    if max_radius is not None:
        ok = ok & (rnn <= f32(max_radius))
    if strict:
        rnn = F.when(ok, rnn).otherwise(
            F.raise_error(F.lit("distance exceeds the search buffer or too few points"))
        )
    return df.withColumn("rnn", F.when(ok, rnn) if not strict else rnn).withColumn("certified", ok)


def _same_place(other: DataFrame) -> tuple[DataFrame, Column]:
    """``other`` with its coordinates renamed, and the condition that joins it; nulls equal nulls."""
    same = F.lit(True)
    for c in XYZ:
        same &= F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    return other.withColumnsRenamed({c: f"_at_{c}" for c in XYZ}), same


def _at_positions(rows: DataFrame, found: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` with what was found for their position, unknown places included.

    A position shared by very many rows would be one task of the join. There
    are at most ``MOST_HOT`` of those beyond ``HOT_ROWS``, so their results are
    broadcast and their rows stay where they are; only the others are shuffled.
    """
    def meet(left, right, how="inner"):
        right, same = _same_place(right)
        return left.join(right, same, how).drop(*(f"_at_{c}" for c in XYZ))

    total, most = blocks.agg(F.sum("nq"), F.max("nq")).first()
    limit = max(HOT_ROWS, (total or 0) // MOST_HOT)
    if (most or 0) <= limit:
        return meet(rows, found)
    found = stage_table(found, "found")
    hot = F.broadcast(blocks.filter(F.col("nq") > limit).select(*XYZ))
    return meet(rows, F.broadcast(meet(found, hot, "left_semi"))).unionByName(
        meet(meet(rows, hot, "left_anti"), meet(found, hot, "left_anti"))
    )


def rnn_particles(points: DataFrame, n: int, length=None, max_radius=None, strict=False,
                  block_rows=BLOCK_ROWS, ghost_rows=GHOST_ROWS) -> DataFrame:
    """Distance from every point to its ``n``-th nearest other point.

    Coincident other points count at distance 0. Returns
    (fnum, row_idx, rnn, certified).
    """
    points = wrap_points(points, length)
    found, blocks = rank_distances(points, None, n, length, max_radius, block_rows, ghost_rows)
    out = ["fnum", "row_idx", "rnn", "certified"]
    found = _finish(found, F.col("next_r2"), max_radius, strict)
    named = [F.col("ia").cast("int").alias("fnum"), F.col("ib").alias("row_idx"), "rnn", "certified"]
    if not blocks.filter(F.col("nq") > 1).limit(1).count():
        # Every position is one point, named in the block table: no join back.
        return found.select(*named)
    # Only shared positions go back to their points; usually they are few.
    found = stage_table(found, "found")
    shared = found.filter(F.col("nq") > 1).select(*XYZ, "rnn", "certified")
    return found.filter(F.col("nq") == 1).select(*named).unionByName(
        _at_positions(points, shared, blocks).select(*out)
    )


def rnn_halos(halos: DataFrame, points: DataFrame, n: int, length=None, max_radius=None,
              strict=False, block_rows=BLOCK_ROWS, ghost_rows=GHOST_ROWS) -> DataFrame:
    """Distance from every catalogue entry to its ``n``-th nearest point.

    If a point sits exactly on the entry it is taken to be the entry itself:
    the rank is then counted without one such point.
    """
    halos = wrap_points(halos, length)
    found, blocks = rank_distances(points, halos, n, length, max_radius, block_rows, ghost_rows)
    r2 = F.when(F.col("first_r2") == f32(0.0), F.col("next_r2")).otherwise(F.col("nth_r2"))
    found = _finish(found, r2, max_radius, strict).select(*XYZ, "rnn", "certified")
    return _at_positions(halos, found, blocks).select("halo_file_index", "id", "rnn", "certified")


def _emit_lists(rows: DataFrame, found: DataFrame, blocks: DataFrame, keep: list[str], k: int, drop_self: bool):
    near = F.col("near")
    if drop_self:
        near = F.filter(
            near,
            lambda e: ~(
                (e["ia"] == F.col("fnum").cast("bigint")) & (e["ib"] == F.col("row_idx"))
            ),
        )
    joined = _at_positions(rows, found.select(*XYZ, "near"), blocks)
    return joined.select(*keep, F.posexplode(F.slice(near, 1, k)).alias("_p", "_e")).select(
        *keep,
        (F.col("_p") + 1).cast("bigint").alias("rank"),
        F.col("_e.ia").cast("int").alias("nbr_fnum"),
        F.col("_e.ib").alias("nbr_row_idx"),
        F.col("_e.r2").alias("r2"),
    )


def knn_pairs(points: DataFrame, k: int, length=None, block_rows=BLOCK_ROWS,
              ghost_rows=GHOST_ROWS) -> DataFrame:
    """The ``k`` nearest other points of every point, ties by (fnum, row_idx).

    Of the points at one position only the first k + 1 by (fnum, row_idx) are
    searched: no list can show another, since they tie at every distance.
    """
    points = wrap_points(points, length)
    blocks, links, heavy = _prepare(points, None, k, length, True, None, block_rows, ghost_rows)
    found = _answer(blocks, links, heavy, k, length, True, True)
    return _emit_lists(points, found, blocks, ["fnum", "row_idx"], k, drop_self=True)


def knn_join(queries: DataFrame, points: DataFrame, k: int, length=None,
             block_rows=BLOCK_ROWS, ghost_rows=GHOST_ROWS) -> DataFrame:
    """The ``k`` nearest points of every catalogue entry, coincident ones too."""
    queries, points = wrap_points(queries, length), wrap_points(points, length)
    blocks, links, heavy = _prepare(
        points, queries, k, length, True, None, block_rows, ghost_rows
    )
    found = _answer(blocks, links, heavy, k, length, True, True)
    return _emit_lists(queries, found, blocks, ["halo_file_index", "id"], k, drop_self=False)
