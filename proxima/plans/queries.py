"""Named queries over the given tables, one per operator or function family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curve, geometry as G, sky as S, sky_grid as SG
from ..functions.stages import spread, staged
from ..model import BOX_COLS, XYZ
from ..operators import boxes as B, knn as K, radius as R, sky_ops as SO, stored as T
from ..sinks import files as W
from ..sources.snapshot import name_tokens
from . import views as V

N = 8
NDIV = 3
BUFFER = 0.05
ORDER = 6
LOW, HIGH = BOX_COLS[:3], BOX_COLS[3:]


def c(*names):
    return [F.col(n) for n in names]


# --- distances to the N-th neighbour ------------------------------------------------

def rnn_particles_open(spark, sf):
    return K.rnn_particles(V.points(spark, sf), N)


def rnn_particles_periodic(spark, sf):
    return K.rnn_particles(V.points_periodic(spark, sf), N, 1.0)


def rnn_particles_buffer(spark, sf):
    return K.rnn_particles(V.points(spark, sf), N, max_radius=0.1)


def rnn_ties_events(spark, sf):
    return K.rnn_particles(V.points_events(spark, sf), 5)


def rnn_crowded_lineitem(spark, sf):
    return K.rnn_particles(V.points_lineitem(spark, sf), 120)


def rnn_halos_coincident(spark, sf):
    return K.rnn_halos(V.halos(spark, sf), V.points(spark, sf), N)


def rnn_halos_offset(spark, sf):
    return K.rnn_halos(V.halos(spark, sf, 3), V.points(spark, sf), N)


def knn_pairs_open(spark, sf):
    return K.knn_pairs(V.points(spark, sf), 5)


def knn_pairs_periodic(spark, sf):
    return K.knn_pairs(V.points_periodic(spark, sf), 5, 1.0)


def knn_join_halos(spark, sf):
    return K.knn_join(V.halos(spark, sf, 3), V.points(spark, sf), 5)


# The same questions cut into many small blocks with few rows per share, so that
# links, outliers and merged shares all take part.
SMALL = {"block_rows": 32, "ghost_rows": 128}


def rnn_blocks_open(spark, sf):
    return K.rnn_particles(V.points(spark, sf), N, **SMALL)


def rnn_blocks_periodic(spark, sf):
    return K.rnn_particles(V.points_periodic(spark, sf), N, 1.0, **SMALL)


def rnn_halos_blocks_open(spark, sf):
    return K.rnn_halos(V.halos(spark, sf, 3), V.points(spark, sf), N, **SMALL)


def rnn_halos_blocks_periodic(spark, sf):
    halos, points = V.points_periodic(spark, sf), V.points_periodic(spark, sf)
    halos = halos.select(F.col("row_idx").alias("halo_file_index"), (F.col("row_idx") + 1000).alias("id"), *XYZ)
    return K.rnn_halos(halos, points, N, 1.0, **SMALL)


def rnn_halos_stored_open(spark, sf):
    stored = T.store_blocks(V.points(spark, sf), block_rows=16)
    return T.rnn_halos_stored(V.halos(spark, sf, 3), stored, N, **SMALL)


def rnn_halos_stored_periodic(spark, sf):
    halos, points = V.points_periodic(spark, sf), V.points_periodic(spark, sf)
    halos = halos.select(F.col("row_idx").alias("halo_file_index"), (F.col("row_idx") + 1000).alias("id"), *XYZ)
    return T.rnn_halos_stored(halos, T.store_blocks(points, length=1.0, block_rows=16), N, **SMALL)


def knn_pairs_blocks_open(spark, sf):
    return K.knn_pairs(V.points(spark, sf), 5, **SMALL)


def knn_pairs_blocks_periodic(spark, sf):
    return K.knn_pairs(V.points_periodic(spark, sf), 5, 1.0, **SMALL)


def knn_join_blocks_open(spark, sf):
    return K.knn_join(V.halos(spark, sf, 3), V.points(spark, sf), 5, **SMALL)


# --- fixed radius ----------------------------------------------------------------------

def radius_pairs_open(spark, sf):
    return R.radius_pairs(V.points(spark, sf), 0.1)


def radius_pairs_periodic(spark, sf):
    return R.radius_pairs(V.points_periodic(spark, sf), 0.1, 1.0)


def radius_counts(spark, sf):
    return R.radius_counts(V.points_events(spark, sf), 2.5)


# --- scalar geometry -------------------------------------------------------------------

def wrap_positions(spark, sf):
    p = (F.col("l_extendedprice") - 50000.0).cast("float")
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", G.wrap_position(p, 10000.0).alias("wrapped")
    )


def pair_distance_periodic(spark, sf):
    a = [F.col(n).cast("float") for n in ("l_quantity", "l_discount", "l_tax")]
    b = [
        x.cast("float")
        for x in (F.col("l_linenumber"), F.col("l_suppkey") % 51, F.col("l_partkey") % 51)
    ]
    return V.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        G.squared_distance(a, b, 50.0).alias("r2_periodic"),
        G.squared_distance(a, b).alias("r2_open"),
    )


# --- boxes --------------------------------------------------------------------------------

def _boxes(spark, sf):
    return B.number_boxes(B.file_boxes(V.points(spark, sf), NDIV))


def _boxes_periodic(spark, sf):
    # Vectors aren't bounded, so some points can lie beyond the unit box. Boxes round the period take
    # part as the twins have them; the check that a snapshot lies in its primary image is for files.
    return B.number_boxes(B.file_boxes(V.points_periodic(spark, sf), NDIV))


def bbox_grid(spark, sf):
    return B.file_cells(V.points_events(spark, sf), NDIV)


def bbox_coalesced(spark, sf):
    return _boxes(spark, sf).withColumn("volume", G.box_volume(c(*LOW), c(*HIGH)))


def bbox_index_text(spark, sf):
    return W.box_lines(_boxes(spark, sf))


def box_decompose_periodic(spark, sf):
    pieces = B.buffered_pieces(_boxes_periodic(spark, sf), 0.2, 1.0)
    return pieces.select("box_id", *BOX_COLS)


def point_in_box_buffered(spark, sf):
    b = _boxes_periodic(spark, sf).select("fnum", "box_id", *BOX_COLS)
    p = V.points_periodic(spark, sf).select("fnum", "row_idx", *XYZ)
    return p.join(b, "fnum").select(
        "box_id", "row_idx",
        G.point_in_grown_box(c(*XYZ), c(*LOW), c(*HIGH), 0.1, 1.0).alias("inside_periodic"),
        G.point_in_grown_box(c(*XYZ), c(*LOW), c(*HIGH), 0.1).alias("inside_open"),
    )


def box_pairs_touch(spark, sf):
    b = _boxes_periodic(spark, sf).select("box_id", "ind", *BOX_COLS)
    other = b.select(F.col("box_id").alias("other_id"), "ind", *[F.col(x).alias(f"o_{x}") for x in BOX_COLS])
    mine, theirs = (c(*LOW), c(*HIGH)), (c(*[f"o_{x}" for x in LOW]), c(*[f"o_{x}" for x in HIGH]))
    return b.join(other, "ind").select(
        "box_id", "other_id",
        G.grown_boxes_touch(*mine, *theirs, 0.1, 0.05, 1.0).alias("touch_periodic"),
        G.boxes_touch(*mine, *theirs).alias("touch_open"),
    )


def file_overlap(spark, sf):
    return B.file_overlap(_boxes(spark, sf), BUFFER)


def file_overlap_periodic(spark, sf):
    return B.file_overlap(_boxes_periodic(spark, sf), BUFFER, 1.0)


def buffered_read(spark, sf):
    return B.buffered_read(
        V.points_periodic(spark, sf), _boxes_periodic(spark, sf), BUFFER, 1.0
    ).select("for_fnum", "own", "fnum", "row_idx")


def buffered_read_skewed(spark, sf):
    """Crowded positions: most cells hold more rows than may meet in one place."""
    p = V.points_events(spark, sf)
    near = B.buffered_read(p, B.file_boxes(p, NDIV), 2.0, spread=200)
    return near.select("for_fnum", "own", "fnum", "row_idx")


def halo_box_assign(spark, sf):
    return B.assign_boxes(V.halos(spark, sf, 3), _boxes(spark, sf))


def halo_box_growth(spark, sf):
    h, b = V.halos(spark, sf, 3), _boxes(spark, sf)
    return B.grow_to_halos(b, h, B.assign_boxes(h, b)).select("box_id", *BOX_COLS)


def halo_work_units(spark, sf):
    h = V.halos(spark, sf, 3)
    return B.work_units(B.assign_boxes(h, _boxes(spark, sf)))


def nearest_face(spark, sf):
    b = _boxes(spark, sf).select("fnum", "box_id", *BOX_COLS)
    return V.points(spark, sf).join(b, "fnum").select(
        "box_id", "row_idx",
        G.nearest_face_distance2(c(*XYZ), c(*LOW), c(*HIGH)).alias("d2"),
    )


# --- curve order ------------------------------------------------------------------------

def ph_key_order(spark, sf):
    return curve.with_peano_key(V.points_events(spark, sf))


def ph_key_by_file(spark, sf):
    return curve.with_peano_key(V.points_events(spark, sf), ["fnum"])


# --- text and names ------------------------------------------------------------------------

def halo_text_format(spark, sf):
    rnn = V.halos(spark, sf).withColumn("rnn", F.col("px") * F.col("px"))
    return W.halo_lines(rnn)


def filename_tokens(spark, sf):
    path = F.concat(F.lit("/sim/cone_"), F.col("label"), F.lit("_"), F.col("vec_id"))
    t = name_tokens(path)
    return V.table(spark, sf, "embeddings").select("vec_id", *[v.alias(k) for k, v in t.items()])


def file_union_distinct(spark, sf):
    a = V.points(spark, sf).select("fnum")
    return a.unionByName(V.points_events(spark, sf).select("fnum")).distinct()


# --- sky ---------------------------------------------------------------------------------------

def _angles(spark, sf):
    return V.sky(spark, sf).select(
        "id", S.vec_theta(*c(*"xyz")).alias("theta"), S.vec_phi(*c(*"xyz")).alias("phi")
    )


def hp_vec2ang(spark, sf):
    a = _angles(spark, sf)
    v = S.ang2vec(*c("theta", "phi"))
    return a.withColumn("_v", v).select(
        "id", F.round("theta", 9).alias("theta"), F.round("phi", 9).alias("phi"),
        *[F.round(F.col("_v")[i], 9).alias(n) for i, n in enumerate(("ux", "uy", "uz"))],
    )


def hp_radec(spark, sf):
    d = V.sky(spark, sf).withColumn("_d", S.vec2radec(*c(*"xyz")))
    d = d.withColumn("_a", S.radec2ang(F.col("_d.ra"), F.col("_d.dec")))
    names = {"ra": "_d.ra", "dec": "_d.dec", "theta": "_a.theta", "phi": "_a.phi"}
    return d.select("id", *[F.round(F.col(v), 8).alias(k) for k, v in names.items()])


def hp_ang2ring(spark, sf):
    return staged(_angles(spark, sf), pix=lambda: S.ang2ring(*c("theta", "phi"), ORDER)).select("id", "pix")


def hp_ang2nest(spark, sf):
    return staged(
        V.sky(spark, sf), pix=lambda: S.vec2nest(*c(*"xyz"), ORDER), ring_pix=lambda: S.vec2ring(*c(*"xyz"), ORDER)
    ).select("id", "pix", "ring_pix")


def _centre(spark, sf, fn, vec):
    d = staged(V.pixels(spark, sf, ORDER), _a=lambda: fn(F.col("pix"), ORDER), _v=lambda: vec(F.col("pix"), ORDER))
    return d.select(
        "id", F.round("_a.theta", 9).alias("theta"), F.round("_a.phi", 9).alias("phi"),
        F.round(F.col("_v")[2], 9).alias("z"),
    )


def hp_pix2ang_nest(spark, sf):
    return _centre(spark, sf, S.nest2ang, S.nest2vec)


def hp_pix2ang_ring(spark, sf):
    return _centre(spark, sf, S.ring2ang, S.ring2vec)


def hp_nest_ring(spark, sf):
    pix, ring, xyf = F.col("pix"), F.col("ring"), [F.col(f"_x_{k}") for k in ("ix", "iy", "face")]
    d = staged(V.pixels(spark, sf, ORDER), ring=lambda: S.nest2ring(pix, ORDER), _x=lambda: S._nest2xyf(pix, ORDER))
    d = staged(d, _r=lambda: S._ring2xyf(ring, ORDER), back=lambda: S.ring2nest(ring, ORDER), ring_again=lambda: S.xyf2ring(*xyf, ORDER))
    d = staged(d, nest_again=lambda: S.xyf2nest(*(F.col(f"_r_{k}") for k in ("ix", "iy", "face")), ORDER))
    return d.select("id", "pix", "ring", "back", *(x.alias(k) for x, k in zip(xyf, ("ix", "iy", "face"))), "nest_again", "ring_again")


def hp_parent_children(spark, sf):
    d = V.pixels(spark, sf, ORDER).withColumn("parent", S.lower_nest(F.col("pix"), ORDER, 4))
    return d.select("id", "parent", F.explode(S.higher_nest(F.col("pix"), ORDER, 7)).alias("child"))


def hp_grid_sizes(spark, sf):
    d = V.table(spark, sf, "orders").select((F.col("o_orderkey") % 30).alias("ord"), F.col("o_orderkey").alias("id"))
    npix = S.order2npix(F.col("ord"))
    return d.select(
        "id", S.order2nside(F.col("ord")).alias("nside"), npix.alias("npix"),
        S.npix2nside(npix).alias("nside_back"),
        S.nside2order(S.order2nside(F.col("ord"))).alias("order_back"),
        S.isqrt(F.col("id")).alias("root"), S.ilog2(F.col("id")).alias("log2"),
        S.imodulo(F.col("id") - 1000, F.lit(7)).alias("mod7"),
        S.ifloor((F.col("id") - 1000) / F.lit(16.0)).alias("floored"),
    )


def hp_ring_info(spark, sf):
    d = staged(V.pixels(spark, sf, ORDER), ring=lambda: S.ring_number(F.col("pix"), ORDER))
    d = staged(d, _i=lambda: S.ring_info(F.col("ring"), ORDER))
    return d.select(
        "id", "ring", F.col("_i.startpix").alias("startpix"), F.col("_i.ringpix").alias("ringpix"),
        F.round("_i.costheta", 9).alias("costheta"), F.round("_i.sintheta", 9).alias("sintheta"),
        F.col("_i.shifted").alias("shifted"),
    )


def hp_ring_above(spark, sf):
    return V.sky(spark, sf).select("id", S.ring_above(F.col("z"), ORDER).alias("ring"))


def hp_peano_roundtrip(spark, sf):
    d = V.pixels(spark, sf, ORDER).withColumn("key", S.nest2peano(F.col("pix"), ORDER))
    return d.select("id", "pix", "key", S.peano2nest(F.col("key"), ORDER).alias("back"))


def hp_neighbors(spark, sf):
    d = SO.neighbor_rows(V.pixels(spark, sf, ORDER), F.col("pix"), ORDER)
    return d.select("id", F.col("direction").cast("bigint").alias("direction"), "nbr")


def hp_neighbors_ring(spark, sf):
    d = staged(V.pixels(spark, sf, ORDER), ring=lambda: S.nest2ring(F.col("pix"), ORDER))
    d = staged(SO.neighbor_rows(d, F.col("ring"), ORDER, "ring"), nbr=lambda: S.ring2nest(F.col("nbr"), ORDER))
    return d.select("id", F.col("direction").cast("bigint").alias("direction"), "nbr")


def hp_query_disc(spark, sf):
    return SO.disc_rows(_angles(spark, sf), *c("theta", "phi"), F.lit(0.2), 3).select("id", "pix")


def hp_interpol(spark, sf):
    d = staged(_angles(spark, sf), _w=lambda: SG.interpol4(*c("theta", "phi"), ORDER)).select("id", spread(F.col("_w")).alias("_w"))
    return d.select("id", F.col("_w.pix").alias("pix"), F.round("_w.wgt", 9).alias("wgt"))


def hp_triangles(spark, sf):
    d = staged(V.pixels(spark, sf, ORDER), _t=lambda: SG.triangles(F.col("pix"), ORDER)).select("id", spread(F.col("_t")).alias("_t"))
    return d.select("id", *[F.col("_t")[i].alias(f"v{i}") for i in range(3)])


def hp_interp_tri(spark, sf):
    d = SO.interp_triangle(_angles(spark, sf), "id", "theta", "phi", 4)
    return d.select(
        "id", *[F.col("pix")[i].alias(f"pix{i}") for i in range(3)],
        *[F.round(F.col("wgt")[i], 9).alias(f"wgt{i}") for i in range(3)],
    )


def hp_interp_poly(spark, sf):
    d = staged(_angles(spark, sf), _w=lambda: SG.interp_polygon(*c("theta", "phi"), 4)).select("id", spread(F.col("_w")).alias("_w"))
    return d.select("id", F.col("_w.pix").alias("pix"), F.round("_w.wgt", 9).alias("wgt"))


def hp_finitediff(spark, sf):
    d = staged(V.pixels(spark, sf, 3), _f=lambda: SG.finite_difference(F.col("pix"), 3))
    m = F.col("_f.minv")
    return d.select(
        "id", F.round(m[0][0], 7).alias("m00"), F.round(m[0][1] + 0.0, 7).alias("m01"),
        F.round(m[1][1], 7).alias("m11"),
    )


def sky_file_overlap(spark, sf):
    files = (
        V.table(spark, sf, "embeddings")
        .select(
            F.col("label").cast("int").alias("rbin"),
            *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("xyz")],
        )
    )
    files = (
        staged(files, hpix=lambda: S.vec2nest(*c(*"xyz"), 2))
        .select("rbin", "hpix")
        .distinct()
        .select(
            (F.col("rbin") * 192 + F.col("hpix")).cast("int").alias("fnum"), "rbin", "hpix",
            F.lit(2).alias("forder"),
        )
    )
    return SO.sky_file_overlap(files, 10.0)


def alm_index(spark, sf):
    i = F.col("o_orderkey")
    d = V.table(spark, sf, "orders").select(i.alias("id"), S.index2alm(i).alias("_a"))
    l, m = F.col("_a.l"), F.col("_a.m")
    return d.select(
        "id", l.alias("l"), m.alias("m"), S.alm2index(l, m).alias("back"), S.num_alms(l).alias("n")
    )


QUERIES = {
    f.__name__: f
    for f in (
        rnn_particles_open, rnn_particles_periodic, rnn_particles_buffer, rnn_ties_events,
        rnn_crowded_lineitem, rnn_halos_coincident, rnn_halos_offset, knn_pairs_open,
        knn_pairs_periodic, knn_join_halos, rnn_blocks_open, rnn_blocks_periodic,
        rnn_halos_blocks_open, rnn_halos_blocks_periodic, rnn_halos_stored_open, rnn_halos_stored_periodic, knn_pairs_blocks_open,
        knn_pairs_blocks_periodic, knn_join_blocks_open, radius_pairs_open, radius_pairs_periodic,
        radius_counts, wrap_positions, pair_distance_periodic, bbox_grid, bbox_coalesced,
        bbox_index_text, box_decompose_periodic, point_in_box_buffered, box_pairs_touch,
        file_overlap, file_overlap_periodic, buffered_read, buffered_read_skewed, halo_box_assign, halo_box_growth,
        halo_work_units, nearest_face, ph_key_order, ph_key_by_file, halo_text_format,
        filename_tokens, file_union_distinct, hp_vec2ang, hp_radec, hp_ang2ring, hp_ang2nest,
        hp_pix2ang_nest, hp_pix2ang_ring, hp_nest_ring, hp_parent_children, hp_grid_sizes,
        hp_ring_info, hp_ring_above, hp_peano_roundtrip, hp_neighbors, hp_neighbors_ring,
        hp_query_disc, hp_interpol, hp_triangles, hp_interp_tri, hp_interp_poly, hp_finitediff,
        sky_file_overlap, alm_index,
    )
}
