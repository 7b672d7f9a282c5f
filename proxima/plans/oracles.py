"""DuckDB statements that answer the named queries by other means.

Distances come from joining everything with everything, boxes and pixels from
the defining formulas, so each statement is independent of how the Spark query
is planned. Curve keys are walked level by level with the same fixed values as the engine's.
"""

from __future__ import annotations

import math

from ..functions import curve, sky

N, NDIV, BUFFER, ORDER = 8, 3, 0.05, 6
PI = math.pi


def f(x):
    return f"CAST({x} AS FLOAT)"


P = f"""SELECT label AS fnum, vec_id AS row_idx, {f('embedding[1]')} AS px,
 {f('embedding[2]')} AS py, {f('embedding[3]')} AS pz FROM embeddings"""
PP = f"""SELECT fnum, row_idx, {f(f"px + {f('0.5')}")} AS px, {f(f"py + {f('0.5')}")} AS py,
 {f(f"pz + {f('0.5')}")} AS pz FROM ({P})"""
EV = f"""SELECT CAST(ascii(event_type) AS INTEGER) AS fnum, event_id AS row_idx,
 {f('user_id')} AS px, {f('value')} AS py, {f('hour(ts)')} AS pz FROM events"""
LI = f"""SELECT l_linenumber AS fnum, l_orderkey AS row_idx, {f('l_quantity')} AS px,
 {f('l_discount')} AS py, {f('l_tax')} AS pz FROM lineitem"""


def H(first=1):
    xyz = ", ".join(f"{f(f'embedding[{first + i}]')} AS p{a}" for i, a in enumerate("xyz"))
    return f"SELECT vec_id AS halo_file_index, vec_id + 1000 AS id, {xyz} FROM embeddings"


def r2(a="a", b="b", length=None):
    def sep(x):
        d = f"abs({a}.{x} - {b}.{x})"
        if length is None:
            return d
        return f"(CASE WHEN {d} > {f(length / 2)} THEN {f(length)} - {d} ELSE {d} END)"

    return " + ".join(f"{sep(x)} * {sep(x)}" for x in ("px", "py", "pz"))


OTHER = "(a.fnum <> b.fnum OR a.row_idx <> b.row_idx)"


def particles(points, n, length=None):
    return f"""WITH p AS ({points})
 SELECT a.fnum, a.row_idx, CAST(sqrt((min({r2(length=length)}, {n}))[{n}]) AS FLOAT) AS rnn,
 TRUE AS certified FROM p a JOIN p b ON {OTHER} GROUP BY a.fnum, a.row_idx"""


def halos(h, n, points=P, length=None):
    near = f"min({r2(length=length)}, {n + 1})"
    return f"""WITH p AS ({points}), h AS ({h})
 SELECT halo_file_index, id, CAST(sqrt(CASE WHEN v[1] = 0 THEN v[{n + 1}] ELSE v[{n}] END) AS FLOAT) AS rnn,
 TRUE AS certified
 FROM (SELECT a.halo_file_index, a.id, {near} AS v FROM h a CROSS JOIN p b GROUP BY a.halo_file_index, a.id)"""


def pairs(points, k, length=None):
    return f"""WITH p AS ({points}), d AS (
 SELECT a.fnum, a.row_idx, b.fnum AS nbr_fnum, b.row_idx AS nbr_row_idx, {r2(length=length)} AS r2
 FROM p a JOIN p b ON {OTHER})
 SELECT fnum, row_idx, row_number() OVER w AS rank, nbr_fnum, nbr_row_idx, r2 FROM d
 WINDOW w AS (PARTITION BY fnum, row_idx ORDER BY r2, nbr_fnum, nbr_row_idx) QUALIFY rank <= {k}"""


def within(points, radius, length=None):
    return f"""WITH p AS ({points})
 SELECT a.fnum, a.row_idx, b.fnum AS nbr_fnum, b.row_idx AS nbr_row_idx, {r2(length=length)} AS r2
 FROM p a CROSS JOIN p b WHERE {r2(length=length)} <= {f(radius)} * {f(radius)}"""


LOW, HIGH = ("xmin", "ymin", "zmin"), ("xmax", "ymax", "zmax")
BOX = LOW + HIGH


def cells(points):
    at = []
    for a in "xyz":
        width = f"CAST(CAST(hi_{a} - lo_{a} AS DOUBLE) / {NDIV} AS FLOAT)"
        q = f"CAST(CAST(p{a} - lo_{a} AS DOUBLE) / CAST({width} AS DOUBLE) AS FLOAT)"
        at.append(f"CASE WHEN {width} > 0 THEN greatest(0, least({NDIV - 1}, CAST(trunc({q}) AS INTEGER))) ELSE 0 END")
    key = f"(({at[0]}) * {NDIV} + ({at[1]})) * {NDIV} + ({at[2]})"
    ext = ", ".join(f"min(p{a}) AS lo_{a}, max(p{a}) AS hi_{a}" for a in "xyz")
    tight = ", ".join(
        [f"min(p{a}) AS {n}" for a, n in zip("xyz", LOW)] + [f"max(p{a}) AS {n}" for a, n in zip("xyz", HIGH)]
    )
    return f"""SELECT fnum, CAST(row_number() OVER (PARTITION BY fnum ORDER BY cell) - 1 AS INTEGER) AS ind,
 {', '.join(BOX)}, np FROM (SELECT fnum, cell, {tight}, count(*) AS np FROM (
 SELECT p.*, {key} AS cell FROM ({points}) p JOIN (SELECT fnum, {ext} FROM ({points}) GROUP BY fnum) e USING (fnum))
 GROUP BY fnum, cell)"""


VOLUME = "(xmax - xmin) * (ymax - ymin) * (zmax - zmin)"


def boxes(points):
    whole = ", ".join([f"min({c}) AS w_{c}" for c in LOW] + [f"max({c}) AS w_{c}" for c in HIGH])
    total = "(w_xmax - w_xmin) * (w_ymax - w_ymin) * (w_zmax - w_zmin)"
    ratio = f"CAST(CAST({total} AS DOUBLE) / CAST(s AS DOUBLE) AS FLOAT)"
    one = f"coalesce(s <> 0 AND abs({ratio} - 1.0) < 0.1, FALSE)"
    pick = ", ".join(f"CASE WHEN one THEN w_{c} ELSE {c} END AS {c}" for c in BOX)
    return f"""SELECT fnum, ind, {pick}, CAST(CASE WHEN one THEN wnp ELSE np END AS BIGINT) AS np,
 row_number() OVER (ORDER BY fnum, ind) - 1 AS box_id FROM (
 SELECT *, {one} AS one FROM ({cells(points)}) JOIN (
 SELECT fnum, {whole}, sum(np) AS wnp, CAST(sum(CAST({VOLUME} AS DOUBLE)) AS FLOAT) AS s
 FROM ({cells(points)}) GROUP BY fnum) USING (fnum)) WHERE NOT one OR ind = 0"""


def grown(src, by):
    return f"""SELECT * REPLACE ({', '.join([f'{c} - {f(by)} AS {c}' for c in LOW] + [f'{c} + {f(by)} AS {c}' for c in HIGH])}) FROM ({src})"""


def parts(lo, hi):
    """Pieces of [lo, hi] inside [0, 1], as a list of structs."""
    turns = f"CAST(ceil(CAST({hi} AS DOUBLE)) - 1 AS FLOAT)"
    top, bottom = f"({hi} - {turns})", f"({lo} - {turns})"
    wraps = f"CAST(ceil(-CAST({bottom} AS DOUBLE)) AS INTEGER)"

    def piece(a, b):
        return f"{{'lo': {f(a)}, 'hi': {f(b)}}}"

    return f"""CASE WHEN {bottom} >= 0 THEN [{piece(bottom, top)}]
 WHEN {wraps} = 1 THEN [{piece(0, top)}, {piece(f'{bottom} + 1', 1)}]
 ELSE list_concat([{piece(0, top)}], list_concat(list_transform(range({wraps} - 1), lambda i: {piece(0, 1)}),
 [{piece(f'{bottom} + {wraps}', 1)}])) END"""


def decomposed(src):
    q = f"SELECT * FROM ({src})"
    for a in "xyz":
        q = f"SELECT * EXCLUDE (s) REPLACE (s.lo AS {a}min, s.hi AS {a}max) FROM (SELECT *, unnest({parts(f'{a}min', f'{a}max')}) AS s FROM ({q}))"
    return q


def touch(a, b):
    return " AND ".join(f"{a}.{x}min <= {b}.{x}max AND {b}.{x}min <= {a}.{x}max" for x in "xyz")


def inside(p, b):
    return " AND ".join(f"{b}.{x}min <= {p}.p{x} AND {p}.p{x} <= {b}.{x}max" for x in "xyz")


def overlap(points, periodic):
    src = grown(boxes(points), BUFFER)
    src = decomposed(src) if periodic else src
    return f"""WITH b AS ({boxes(points)}), g AS ({src})
 SELECT DISTINCT g.fnum, b.fnum AS nbr_fnum FROM g CROSS JOIN b WHERE {touch('g', 'b')}
 UNION SELECT fnum, fnum FROM b"""


def face_distance(p, b):
    """Squared distance to the closest point of the surface, found by clamping."""
    inside_ = " AND ".join(f"{p}.p{x} BETWEEN {b}.{x}min AND {b}.{x}max" for x in "xyz")
    close = [f"(greatest({b}.{x}min, least({b}.{x}max, {p}.p{x})) - {p}.p{x})" for x in "xyz"]
    away = " + ".join(f"{c} * {c}" for c in close)
    depth = "least(" + ", ".join(f"abs({p}.p{x} - {b}.{x}{e})" for x in "xyz" for e in ("min", "max")) + ")"
    return f"(CASE WHEN {inside_} THEN {depth} * {depth} ELSE {away} END)"


ASSIGN = f"""SELECT halo_file_index, fnum AS bbox_file_index, box_id AS bbox_index FROM (
 SELECT h.halo_file_index, b.fnum, b.box_id, {inside('h', 'b')} AS held,
 {face_distance('h', 'b')} AS d2, {VOLUME} AS vol FROM ({H(4)}) h CROSS JOIN ({boxes(P)}) b)
 QUALIFY row_number() OVER (PARTITION BY halo_file_index ORDER BY held DESC,
 CASE WHEN held THEN -vol ELSE d2 END, box_id) = 1"""

# --- sky -----------------------------------------------------------------------------

SKY = "SELECT row_idx AS id, CAST(px AS DOUBLE) AS x, CAST(py AS DOUBLE) AS y, CAST(pz AS DOUBLE) AS z FROM (" + P + ")"
ANGLES = f"""SELECT id, acos(z / sqrt(x*x + y*y + z*z)) AS theta, z / sqrt(x*x + y*y + z*z) AS nz,
 CASE WHEN x = 0 AND y = 0 THEN 0 WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END AS phi FROM ({SKY})"""


def pixels(order=ORDER):
    return f"SELECT o_orderkey AS id, o_orderkey % {12 << 2 * order} AS pix FROM orders"


def nest_xyf(src, order, pix="pix"):
    """Adds ix, iy, face of a nested pixel, bit by bit."""
    bit = lambda s: " + ".join(f"((({pix} >> {2 * i + s}) & 1) << {i})" for i in range(order))
    return f"SELECT *, {bit(0)} AS ix, {bit(1)} AS iy, {pix} >> {2 * order} AS face FROM ({src})"


def all_pixels(order):
    """Every pixel from the geometry of the flat layout: pix (nested), jr, ring_pix, cz, cphi, ctheta, u, v.

    RING numbers are the rank of the centres from north to south, then eastwards.
    """
    n = 1 << order
    flat = f"""SELECT pix, face % 4 + (CASE WHEN face // 4 = 1 THEN 0 ELSE 0.5 END) + (ix - iy) / {2.0 * n} AS u,
 (1 - face // 4) * 0.5 + (ix + iy + 1 - {n}) / {2.0 * n} AS v
 FROM ({nest_xyf(f"SELECT unnest(range({12 * n * n})) AS pix", order)})"""
    ball = f"""SELECT pix, u, v, {sphere_z('u', 'v')} AS cz, {sphere_phi('u', 'v')} AS cphi FROM ({flat})"""
    return f"""SELECT *, acos(cz) AS ctheta, dense_rank() OVER (ORDER BY round(cz, 12) DESC) AS jr,
 row_number() OVER (ORDER BY round(cz, 12) DESC, cphi) - 1 AS ring_pix FROM ({ball})"""


def sphere_z(u, v):
    """Height of a place in the flat layout."""
    return f"(CASE WHEN abs({v}) <= 0.5 THEN {v} * 4 / 3.0 ELSE sign({v}) * (1 - 4 * (1 - abs({v})) * (1 - abs({v})) / 3.0) END)"


def sphere_phi(u, v):
    """Longitude of a place in the flat layout."""
    gore = f"(floor({u}) + 0.5)"
    turned = f"(CASE WHEN abs({v}) <= 0.5 THEN {u} ELSE {gore} + ({u} - {gore}) / (2 * (1 - abs({v}))) END)"
    return f"((({turned}) - 4 * floor(({turned}) / 4)) * pi() / 2)"


def centres(src, order):
    return f"SELECT * FROM ({src}) JOIN ({all_pixels(order)}) USING (pix)"


def holding(src, order):
    """Rows (theta, phi, ...) with the pixel whose square in the flat layout holds the direction."""
    cap = "abs(cos(theta)) > 2 / 3.0"
    width = "sqrt(3 * (1 - abs(cos(theta))))"
    t = "(phi * 2 / pi())"
    u = f"CASE WHEN {cap} THEN floor({t}) + 0.5 + ({t} - floor({t}) - 0.5) * {width} ELSE {t} END"
    v = f"CASE WHEN {cap} THEN sign(cos(theta)) * (1 - {width} / 2) ELSE 0.75 * cos(theta) END"
    apart = "least(abs(s.su - a.u), abs(4 - abs(s.su - a.u))) + abs(s.sv - a.v)"
    return f"""SELECT s.*, a.* FROM (SELECT *, {u} AS su, {v} AS sv FROM ({src})) s JOIN ({all_pixels(order)}) a
 ON {apart} <= {1 / (2 << order)} + 1e-12 QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY {apart}) = 1"""


def neighbours(order):
    """(pix, nbr, direction): pixels that share corners, named by the corners they share."""
    half = 1 / (2 << order)
    corners = " UNION ALL ".join(
        f"SELECT pix, '{name}' AS corner, u + {du} AS cu, v + {dv} AS cv, u FROM px"
        for name, du, dv in (("N", 0.0, half), ("E", half, 0.0), ("S", 0.0, -half), ("W", -half, 0.0)))
    # a gore's edges and its pole belong to the gore, whose middle is that of its pixels
    gore = "(floor(u) + 0.5)"
    lon = f"""(CASE WHEN abs(cv) >= 1 - 1e-12 THEN 0 WHEN abs(cv) <= 0.5 THEN cu ELSE {gore} + (cu - {gore}) / (2 * (1 - abs(cv))) END)"""
    z = sphere_z("cu", "cv")
    point = f"""SELECT pix, corner, round(sqrt(greatest(0, 1 - z * z)) * cos(lon * pi() / 2), 8) + 0.0 AS x,
 round(sqrt(greatest(0, 1 - z * z)) * sin(lon * pi() / 2), 8) + 0.0 AS y, round(z, 8) + 0.0 AS z
 FROM (SELECT pix, corner, {z} AS z, {lon} AS lon FROM c)"""
    return f"""WITH px AS ({all_pixels(order)}), c AS ({corners}), k AS ({point}),
 met AS (SELECT a.pix, b.pix AS nbr, string_agg(a.corner, '' ORDER BY a.corner) AS shared
 FROM k a JOIN k b ON a.x = b.x AND a.y = b.y AND a.z = b.z AND a.pix <> b.pix GROUP BY ALL)
 SELECT pix, nbr, CAST(list_position(['SW', 'W', 'NW', 'N', 'EN', 'E', 'ES', 'S'], shared) - 1 AS BIGINT) AS direction FROM met"""


def bilinear(src, order):
    """(id, pix, wgt): two pixels of the ring above and two of that below, the pole being the mean of its four."""
    n = 1 << order
    return f"""WITH d AS ({src}), rings AS (SELECT jr, min(ring_pix) AS start, count(*) AS size, any_value(ctheta) AS rt,
 any_value(cz) AS rz, min(cphi) > 1e-9 AS shifted FROM ({all_pixels(order)}) GROUP BY jr),
 above AS (SELECT d.id, any_value(d.theta) AS theta, any_value(d.phi) AS phi, count(r.jr) AS up
 FROM d LEFT JOIN rings r ON r.rz >= cos(d.theta) GROUP BY d.id),
 met AS (SELECT a.*, r.*, a.phi / (2 * pi()) * r.size - (CASE WHEN r.shifted THEN 0.5 ELSE 0 END) AS pos, r.jr = a.up AS is_up,
 CASE WHEN a.up = 0 THEN 0 ELSE u.rt END AS t0, CASE WHEN a.up = {4 * n - 1} THEN pi() ELSE w.rt END AS t1
 FROM above a JOIN rings r ON r.jr IN (a.up, a.up + 1) LEFT JOIN rings u ON u.jr = a.up LEFT JOIN rings w ON w.jr = a.up + 1),
 part AS (SELECT *, CASE WHEN is_up THEN (t1 - theta) / (t1 - t0) ELSE (theta - t0) / (t1 - t0) END AS share FROM met),
 each AS (SELECT id, start + ((CAST(floor(pos) AS BIGINT) % size) + size) % size AS pix, (1 - pos + floor(pos)) * share AS wgt FROM part
 UNION ALL SELECT id, start + ((CAST(floor(pos) AS BIGINT) + 1) % size + size) % size, (pos - floor(pos)) * share FROM part
 UNION ALL SELECT id, start + i, (1 - share) / 4 FROM part, unnest(range(4)) AS q(i) WHERE up IN (0, {4 * n - 1}))
 SELECT id, CAST(pix AS BIGINT) AS pix, round(sum(wgt), 9) AS wgt FROM each GROUP BY id, pix"""


def moments(src, order):
    """Inverse moment matrix of the neighbours' offsets on the tangent plane."""
    vec = "[sin(ctheta) * cos(cphi), sin(ctheta) * sin(cphi), cos(ctheta)]"
    south = "[cos(c.ctheta) * cos(c.cphi), cos(c.ctheta) * sin(c.cphi), -sin(c.ctheta)]"
    east = "[-sin(c.cphi), cos(c.cphi), 0.0]"
    return f"""WITH c AS (SELECT *, {vec} AS vec FROM ({all_pixels(order)})), nb AS ({neighbours(order)}),
 off AS (SELECT nb.pix, list_dot_product({south}, o.vec) - list_dot_product({south}, c.vec) AS t,
 list_dot_product({east}, o.vec) - list_dot_product({east}, c.vec) AS p FROM nb JOIN c USING (pix) JOIN c o ON o.pix = nb.nbr),
 m AS (SELECT pix, sum(t * t) AS tt, sum(t * p) AS tp, sum(p * p) AS pp FROM off GROUP BY pix)
 SELECT id, round(pp / (tt * pp - tp * tp), 7) AS m00, round(-tp / (tt * pp - tp * tp) + 0.0, 7) AS m01,
 round(tt / (tt * pp - tp * tp), 7) AS m11 FROM ({src}) JOIN m USING (pix)"""


def zipped(order):
    """(pix, v0, v1, v2): triangles between adjacent rings, from the longitudes of their centres, and the lids."""
    last = (12 << 2 * order) - 1
    wrap = lambda v: f"(a_start + (({v}) % a_size + a_size) % a_size)"
    return f"""SELECT pix, CAST(v0 AS BIGINT) AS v0, CAST(v1 AS BIGINT) AS v1, CAST(v2 AS BIGINT) AS v2 FROM (
 WITH c AS (SELECT jr, ring_pix, cphi FROM ({all_pixels(order)})),
 r AS (SELECT jr, min(ring_pix) AS start, count(*) AS size, min(cphi) AS west FROM c GROUP BY jr),
 e AS (SELECT c.ring_pix, r.start, r.size, a.start AS a_start, a.size AS a_size,
 CAST(ceil((c.cphi + pi() / r.size - a.west) * a.size / (2 * pi()) - 0.5 - 1e-7) AS BIGINT) AS leaving,
 CAST(ceil((c.cphi - pi() / r.size - a.west) * a.size / (2 * pi()) - 0.5 - 1e-7) AS BIGINT) AS reaching
 FROM c JOIN r ON c.jr = r.jr JOIN r a ON a.jr = c.jr - 1)
 SELECT ring_pix AS pix, ring_pix AS v0, start + (ring_pix - start + 1) % size AS v1, {wrap('leaving')} AS v2 FROM e
 UNION ALL SELECT ring_pix, ring_pix, {wrap('leaving - k')}, {wrap('leaving - k - 1')} FROM e, unnest(range(4)) AS q(k) WHERE k < leaving - reaching
 UNION ALL VALUES (0, 0, 2, 3), (2, 2, 0, 1), ({last}, {last}, {last - 2}, {last - 3}), ({last - 2}, {last - 2}, {last - 1}, {last}))"""


def dot3(a, b):
    return f"({a}[1] * {b}[1] + {a}[2] * {b}[2] + {a}[3] * {b}[3])"


def cross3(a, b):
    part = lambda i, j: f"{a}[{i}] * {b}[{j}] - {a}[{j}] * {b}[{i}]"
    return f"[{part(2, 3)}, {part(3, 1)}, {part(1, 2)}]"


def held_by_triangle(src, order):
    """(id, pix0.., wgt0..): all triangles tried on all directions (theta, phi)."""
    return f"""WITH c AS (SELECT ring_pix, [sin(ctheta) * cos(cphi), sin(ctheta) * sin(cphi), cz] AS v FROM ({all_pixels(order)})),
 t AS (SELECT v0, v1, v2, a.v AS a, b.v AS b, c.v AS c FROM ({zipped(order)}) JOIN c a ON a.ring_pix = v0 JOIN c b ON b.ring_pix = v1
 JOIN c ON c.ring_pix = v2),
 n AS (SELECT *, {cross3('b', 'c')} AS na, {cross3('c', 'a')} AS nb, {cross3('a', 'b')} AS nc FROM t),
 w AS (SELECT *, {dot3('a', 'na')} AS whole FROM n),
 d AS (SELECT id, [sin(theta) * cos(phi), sin(theta) * sin(phi), cos(theta)] AS q FROM ({src})),
 s AS (SELECT d.id, v0, v1, v2, {dot3('q', 'a')} AS ca, {dot3('q', 'b')} AS cb, {dot3('q', 'c')} AS cc,
 {dot3('q', 'na')} / whole AS sa, {dot3('q', 'nb')} / whole AS sb, {dot3('q', 'nc')} / whole AS sc FROM d, w)
 SELECT id, v0 AS pix0, v1 AS pix1, v2 AS pix2, round(sa * ca * ca, 9) AS wgt0, round(sb * cb * cb, 9) AS wgt1, round(sc * cc * cc, 9) AS wgt2
 FROM s WHERE ca > 0 AND cb > 0 AND cc > 0 AND sa >= -1e-15 AND sb >= -1e-15 AND sc >= -1e-15
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY v0, v1, v2) = 1"""


def polygon(src, order):
    """(id, pix, wgt): weights of the four pixels across the edges, from the distances of the polygon's sides."""
    return f"""WITH c AS (SELECT pix, ring_pix, [sin(ctheta) * cos(cphi), sin(ctheta) * sin(cphi), cz] AS v FROM ({all_pixels(order)})),
 d AS (SELECT id, theta, phi, pix FROM ({holding(src, order)})),
 p AS (SELECT d.id, nb.direction // 2 AS i, c.ring_pix, {dot3('[cos(phi) * cos(theta), sin(phi) * cos(theta), -sin(theta)]', 'v')} AS x,
 {dot3('[-sin(phi), cos(phi), 0.0]', 'v')} AS y FROM d JOIN ({neighbours(order)}) nb ON nb.pix = d.pix AND nb.direction % 2 = 0 JOIN c ON c.pix = nb.nbr),
 side AS (SELECT a.id, a.i, (b.y - a.y) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS nx, (a.x - b.x) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS ny,
 abs(a.x * b.y - a.y * b.x) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS away FROM p a JOIN p b ON a.id = b.id AND b.i = (a.i + 1) % 4),
 w AS (SELECT p.id, p.ring_pix, abs(s.nx * r.ny - s.ny * r.nx) / (s.away * r.away) AS w
 FROM p JOIN side s ON s.id = p.id AND s.i = p.i JOIN side r ON r.id = p.id AND r.i = (p.i + 3) % 4)
 SELECT id, CAST(ring_pix AS BIGINT) AS pix, round(w / sum(w) OVER (PARTITION BY id), 9) AS wgt FROM w"""


def peano(src, by=""):
    """Adds ph_key: at every level the octant's place on the base path, then the cell itself is turned."""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    cell = lambda x: f"""(CASE WHEN max({x}) {over} > min({x}) {over} THEN least(32767, CAST(floor(CAST({x} - min({x}) {over} AS DOUBLE)
 / (CAST(max({x}) {over} - min({x}) {over} AS DOUBLE) / 32768)) AS BIGINT)) ELSE 0 END)"""  # noqa: E731
    places = [curve.BASE_PATH[o] for o in curve.OCTANTS]
    bit = lambda v: f"(({v} >> (14 - level)) & 1)"
    of = lambda values: f"{list(values)}[place + 1]"
    return f"""WITH RECURSIVE cells AS (SELECT *, {cell('px')} AS x, {cell('py')} AS y, {cell('pz')} AS z FROM ({src})),
 walk AS (SELECT fnum, row_idx, 0 AS level, x, y, z, 1 AS sense, CAST(0 AS BIGINT) AS ph_key FROM cells UNION ALL
 SELECT fnum, row_idx, level + 1, CASE ty WHEN 0 THEN x WHEN 1 THEN z1 WHEN 2 THEN 32767 - x ELSE 32767 - z1 END, y1,
 CASE ty WHEN 0 THEN z1 WHEN 1 THEN 32767 - x WHEN 2 THEN 32767 - z1 ELSE x END, sense * {of(curve.SENSE)},
 ph_key * 8 + CASE WHEN sense = 1 THEN place ELSE 7 - place END FROM (
 SELECT *, {of(curve.TURNS_Y)} AS ty, CASE {of(curve.TURNS_X)} WHEN 0 THEN y WHEN 1 THEN 32767 - z WHEN 2 THEN 32767 - y ELSE z END AS y1,
 CASE {of(curve.TURNS_X)} WHEN 0 THEN z WHEN 1 THEN y WHEN 2 THEN 32767 - z ELSE 32767 - y END AS z1 FROM (
 SELECT *, {places}[4 * {bit('x')} + 2 * {bit('y')} + {bit('z')} + 1] AS place FROM walk WHERE level < 15)))
 SELECT c.fnum, c.row_idx, c.px, c.py, c.pz, w.ph_key FROM cells c JOIN walk w USING (fnum, row_idx) WHERE level = 15"""


def sphere_path(src, order):
    """Adds key: two bits a level along the path over the faces."""
    flat = lambda rows: [v for row in rows for v in row]
    return f"""WITH RECURSIVE p AS ({src}), walk AS (
 SELECT id, pix, {order} AS level, {list(sky.FACE_STATE)}[(pix >> {2 * order}) + 1] AS state, CAST({list(sky.FACE_PLACE)}[(pix >> {2 * order}) + 1] AS BIGINT) AS key FROM p
 UNION ALL SELECT id, pix, level - 1, {flat(sky.TO_STATE)}[state * 4 + quad + 1], key * 4 + {flat(sky.TO_PATH)}[state * 4 + quad + 1]
 FROM (SELECT *, (pix >> (2 * (level - 1))) & 3 AS quad FROM walk WHERE level > 0))
 SELECT id, pix, key FROM walk WHERE level = 0"""


def separation(a_t, a_p, b_t, b_p):
    return f"""acos(greatest(-1.0, least(1.0, cos({a_t}) * cos({b_t}) + sin({a_t}) * sin({b_t}) * cos({a_p} - {b_p}))))"""


CENTRES = centres(nest_xyf(pixels(), ORDER), ORDER)
NSIDE = 1 << ORDER
FUDGE = lambda order: 1.362 * PI / (4 * (1 << order))

SKY_FILES = f"""SELECT DISTINCT CAST(rbin * 192 + hpix AS INTEGER) AS fnum, rbin, hpix FROM (
 SELECT label AS rbin, CAST(pix AS BIGINT) AS hpix FROM ({holding(f"SELECT a.*, e.label FROM ({ANGLES}) a JOIN embeddings e ON e.vec_id = a.id", 2)}))"""

ORACLES = {
    "rnn_particles_open": particles(P, N),
    "rnn_particles_periodic": particles(PP, N, 1.0),
    "rnn_particles_buffer": f"""SELECT fnum, row_idx, CASE WHEN rnn <= {f(0.1)} THEN rnn END AS rnn,
 rnn <= {f(0.1)} AS certified FROM ({particles(P, N)})""",
    "rnn_ties_events": particles(EV, 5),
    "rnn_crowded_lineitem": f"""WITH l AS ({LI}), u AS (SELECT px, py, pz, count(*) AS m FROM l GROUP BY ALL),
 d AS (SELECT a.px, a.py, a.pz, {r2()} AS r2, CASE WHEN a.px = b.px AND a.py = b.py AND a.pz = b.pz THEN b.m - 1 ELSE b.m END AS m
 FROM u a CROSS JOIN u b),
 s AS (SELECT px, py, pz, r2, sum(m) OVER (PARTITION BY px, py, pz ORDER BY r2) AS seen FROM d),
 v AS (SELECT px, py, pz, min(r2) AS r2 FROM s WHERE seen >= 120 GROUP BY px, py, pz)
 SELECT l.fnum, l.row_idx, CAST(sqrt(v.r2) AS FLOAT) AS rnn, TRUE AS certified FROM l JOIN v USING (px, py, pz)""",
    "rnn_halos_coincident": halos(H(1), N),
    "rnn_halos_offset": halos(H(4), N),
    "knn_pairs_open": pairs(P, 5),
    "knn_pairs_periodic": pairs(PP, 5, 1.0),
    "knn_join_halos": f"""WITH p AS ({P}), h AS ({H(4)}), d AS (
 SELECT a.halo_file_index, a.id, b.fnum AS nbr_fnum, b.row_idx AS nbr_row_idx, {r2()} AS r2 FROM h a CROSS JOIN p b)
 SELECT halo_file_index, id, row_number() OVER w AS rank, nbr_fnum, nbr_row_idx, r2 FROM d
 WINDOW w AS (PARTITION BY halo_file_index ORDER BY r2, nbr_fnum, nbr_row_idx) QUALIFY rank <= 5""",
    "rnn_blocks_open": particles(P, N),
    "rnn_blocks_periodic": particles(PP, N, 1.0),
    "rnn_halos_blocks_open": halos(H(4), N),
    "rnn_halos_blocks_periodic": halos(f"SELECT row_idx AS halo_file_index, row_idx + 1000 AS id, px, py, pz FROM ({PP})", N, PP, 1.0),
    "rnn_halos_stored_open": halos(H(4), N),
    "rnn_halos_stored_periodic": halos(f"SELECT row_idx AS halo_file_index, row_idx + 1000 AS id, px, py, pz FROM ({PP})", N, PP, 1.0),
    "knn_pairs_blocks_open": pairs(P, 5),
    "knn_pairs_blocks_periodic": pairs(PP, 5, 1.0),
    "radius_pairs_open": within(P, 0.1),
    "radius_pairs_periodic": within(PP, 0.1, 1.0),
    "radius_counts": f"SELECT fnum, row_idx, count(*) AS n_within FROM ({within(EV, 2.5)}) GROUP BY fnum, row_idx",
    "wrap_positions": """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN p >= 0 AND p <= 10000 THEN p
 ELSE CASE WHEN m = 0 AND p > 0 THEN 10000 ELSE m END END AS FLOAT) AS wrapped FROM (
 SELECT *, CASE WHEN CAST(p AS DOUBLE) % 10000.0 < 0 THEN (CAST(p AS DOUBLE) % 10000.0 + 10000.0) % 10000.0
 ELSE CAST(p AS DOUBLE) % 10000.0 END AS m FROM (
 SELECT l_orderkey, l_linenumber, CAST(l_extendedprice - 50000.0 AS FLOAT) AS p FROM lineitem))""",
    "pair_distance_periodic": f"""SELECT l_orderkey, l_linenumber, {r2(length=50.0)} AS r2_periodic, {r2()} AS r2_open FROM (
 SELECT l_orderkey, l_linenumber,
 {{'px': {f('l_quantity')}, 'py': {f('l_discount')}, 'pz': {f('l_tax')}}} AS a,
 {{'px': {f('l_linenumber')}, 'py': {f('l_suppkey % 51')}, 'pz': {f('l_partkey % 51')}}} AS b FROM lineitem)""",
    "bbox_grid": cells(EV),
    "bbox_coalesced": f"SELECT *, {VOLUME} AS volume FROM ({boxes(P)})",
    "bbox_index_text": f"""SELECT fnum, ind, printf('%d %d %e %e %e %e %e %e %d', fnum, ind, {', '.join(f'CAST({c} AS DOUBLE)' for c in BOX)}, np) AS line FROM ({boxes(P)})""",
    "box_decompose_periodic": f"SELECT box_id, {', '.join(BOX)} FROM ({decomposed(grown(boxes(PP), 0.2))})",
    "point_in_box_buffered": f"""WITH p AS ({PP}), b AS ({boxes(PP)}), o AS ({grown(boxes(PP), 0.1)}), g AS ({decomposed(grown(boxes(PP), 0.1))})
 SELECT b.box_id, p.row_idx, EXISTS (SELECT 1 FROM g WHERE g.box_id = b.box_id AND {inside('p', 'g')}) AS inside_periodic,
 EXISTS (SELECT 1 FROM o WHERE o.box_id = b.box_id AND {inside('p', 'o')}) AS inside_open
 FROM p JOIN b ON p.fnum = b.fnum""",
    "box_pairs_touch": f"""WITH b AS ({boxes(PP)}), g AS ({decomposed(grown(boxes(PP), 0.1))}), o AS ({decomposed(grown(boxes(PP), 0.05))})
 SELECT a.box_id, c.box_id AS other_id, EXISTS (SELECT 1 FROM g JOIN o ON {touch('g', 'o')}
 WHERE g.box_id = a.box_id AND o.box_id = c.box_id) AS touch_periodic, {touch('a', 'c')} AS touch_open
 FROM b a JOIN b c ON a.ind = c.ind""",
    "file_overlap": overlap(P, False),
    "file_overlap_periodic": overlap(PP, True),
    "buffered_read": f"""WITH p AS ({PP}), g AS ({decomposed(grown(boxes(PP), BUFFER))})
 SELECT fnum AS for_fnum, TRUE AS own, fnum, row_idx FROM p UNION ALL
 SELECT DISTINCT g.fnum, FALSE, p.fnum, p.row_idx FROM p JOIN g ON g.fnum <> p.fnum AND {inside('p', 'g')}""",
    "buffered_read_skewed": f"""WITH p AS ({EV}), g AS ({grown(boxes(EV), 2.0)})
 SELECT fnum AS for_fnum, TRUE AS own, fnum, row_idx FROM p UNION ALL
 SELECT DISTINCT g.fnum, FALSE, p.fnum, p.row_idx FROM p JOIN g ON g.fnum <> p.fnum AND {inside('p', 'g')}""",
    "halo_box_assign": ASSIGN,
    "halo_box_growth": f"""WITH s AS (SELECT bbox_index AS box_id, {', '.join(f'min(p{a}) AS lo_{a}, max(p{a}) AS hi_{a}' for a in 'xyz')}
 FROM ({ASSIGN}) JOIN ({H(4)}) USING (halo_file_index) GROUP BY ALL)
 SELECT box_id, {', '.join([f'least({a}min, coalesce(lo_{a}, {a}min)) AS {a}min' for a in 'xyz'] + [f'greatest({a}max, coalesce(hi_{a}, {a}max)) AS {a}max' for a in 'xyz'])}
 FROM ({boxes(P)}) LEFT JOIN s USING (box_id)""",
    "halo_work_units": f"SELECT count(DISTINCT bbox_file_index) AS n_files FROM ({ASSIGN})",
    "nearest_face": f"""SELECT b.box_id, p.row_idx, {face_distance('p', 'b')} AS d2
 FROM ({P}) p JOIN ({boxes(P)}) b ON p.fnum = b.fnum""",
    "halo_text_format": f"SELECT halo_file_index, printf('%d %f', id, CAST(px * px AS DOUBLE)) AS line FROM ({H(1)})",
    "filename_tokens": """SELECT vec_id, vec_id AS hpix, label AS rbin, 'cone_' || label || '_' || vec_id AS base_name FROM embeddings""",
    "file_union_distinct": f"SELECT fnum FROM ({P}) UNION SELECT fnum FROM ({EV})",
    "hp_vec2ang": f"""SELECT id, round(theta, 9) AS theta, round(phi, 9) AS phi, round(sin(theta) * cos(phi), 9) AS ux,
 round(sin(theta) * sin(phi), 9) AS uy, round(cos(theta), 9) AS uz FROM ({ANGLES})""",
    "hp_radec": f"""SELECT id, round(degrees(phi), 8) AS ra, round(90 - degrees(theta), 8) AS dec,
 round(theta, 8) AS theta, round(phi, 8) AS phi FROM ({ANGLES})""",
    "hp_ang2ring": f"SELECT id, CAST(ring_pix AS BIGINT) AS pix FROM ({holding(f'SELECT id, theta, phi FROM ({ANGLES})', ORDER)})",
    "hp_ang2nest": f"""SELECT id, CAST(pix AS BIGINT) AS pix, CAST(ring_pix AS BIGINT) AS ring_pix FROM (
 {holding(f'SELECT id, theta, phi FROM ({ANGLES})', ORDER)})""",
    "hp_neighbors": f"SELECT id, direction, CAST(nbr AS BIGINT) AS nbr FROM ({pixels()}) JOIN ({neighbours(ORDER)}) USING (pix)",
    "hp_neighbors_ring": f"SELECT id, direction, CAST(nbr AS BIGINT) AS nbr FROM ({pixels()}) JOIN ({neighbours(ORDER)}) USING (pix)",
    "hp_interpol": bilinear(f"SELECT id, theta, phi FROM ({ANGLES})", ORDER),
    "hp_finitediff": moments(pixels(3), 3),
    "hp_pix2ang_nest": f"SELECT id, round(ctheta, 9) AS theta, round(cphi, 9) AS phi, round(cz, 9) AS z FROM ({CENTRES})",
    "hp_pix2ang_ring": f"""SELECT p.id, round(a.ctheta, 9) AS theta, round(a.cphi, 9) AS phi, round(a.cz, 9) AS z
 FROM ({pixels()}) p JOIN ({all_pixels(ORDER)}) a ON a.ring_pix = p.pix""",
    "hp_nest_ring": f"""SELECT id, pix, ring_pix AS ring, pix AS back, ix, iy, face, pix AS nest_again, ring_pix AS ring_again FROM ({CENTRES})""",
    "hp_parent_children": f"""SELECT id, pix // 16 AS parent, unnest(range(pix * 4, pix * 4 + 4)) AS child FROM ({pixels()})""",
    "hp_grid_sizes": """SELECT o_orderkey AS id, CAST(1 AS BIGINT) << (o_orderkey % 30) AS nside,
 CAST(12 AS BIGINT) << (2 * (o_orderkey % 30)) AS npix, CAST(1 AS BIGINT) << (o_orderkey % 30) AS nside_back,
 o_orderkey % 30 AS order_back, CAST(floor(sqrt(o_orderkey + 0.5)) AS BIGINT) AS root,
 CAST(CASE WHEN o_orderkey = 0 THEN 0 ELSE length(ltrim(bin(o_orderkey), '0')) - 1 END AS BIGINT) AS log2,
 ((o_orderkey - 1000) % 7 + 7) % 7 AS mod7, CAST(floor((o_orderkey - 1000) / 16.0) AS BIGINT) AS floored FROM orders""",
    "hp_ring_info": f"""WITH rings AS (SELECT jr, min(ring_pix) AS startpix, count(*) AS ringpix, any_value(cz) AS cz,
 min(cphi) > 1e-9 AS off FROM ({all_pixels(ORDER)}) GROUP BY jr)
 SELECT p.id, r.jr AS ring, r.startpix, r.ringpix, round(r.cz, 9) AS costheta, round(sqrt(1 - r.cz * r.cz), 9) AS sintheta,
 CAST(CASE WHEN r.off THEN 1 ELSE 0 END AS BIGINT) AS shifted
 FROM ({pixels()}) p JOIN rings r ON p.pix >= r.startpix AND p.pix < r.startpix + r.ringpix""",
    "hp_ring_above": f"""WITH rings AS (SELECT DISTINCT jr, cz FROM ({all_pixels(ORDER)}))
 SELECT s.id, CAST(count(r.jr) AS BIGINT) AS ring FROM ({SKY}) s LEFT JOIN rings r ON r.cz >= s.z GROUP BY s.id""",
    "hp_peano_roundtrip": f"SELECT id, pix, key, pix AS back FROM ({sphere_path(pixels(), ORDER)})",
    "hp_triangles": f"SELECT id, v0, v1, v2 FROM ({pixels()}) JOIN ({zipped(ORDER)}) USING (pix)",
    "hp_interp_tri": held_by_triangle(f"SELECT id, theta, phi FROM ({ANGLES})", 4),
    "hp_interp_poly": polygon(f"SELECT id, theta, phi FROM ({ANGLES})", 4),
    "ph_key_order": peano(EV),
    "ph_key_by_file": peano(EV, "fnum"),
    "hp_query_disc": f"""SELECT a.id, c.pix FROM ({ANGLES}) a JOIN ({all_pixels(3)}) c
 ON {separation('a.theta', 'a.phi', 'c.ctheta', 'c.cphi')} <= 0.2 + {FUDGE(3)}""",
    "sky_file_overlap": f"""WITH s AS ({SKY_FILES}), c AS ({all_pixels(2)}),
 fl AS (SELECT s.fnum, s.rbin, s.hpix, c.ctheta, c.cphi FROM s JOIN c ON c.pix = s.hpix)
 SELECT a.fnum, b.fnum AS nbr_fnum FROM fl a JOIN fl b ON abs(a.rbin - b.rbin) <= 1 AND (a.fnum = b.fnum OR
 {separation('a.ctheta', 'a.cphi', 'b.ctheta', 'b.cphi')} <= {2 * FUDGE(2)} +
 CASE WHEN greatest(a.rbin, b.rbin) * 25.0 > 10 THEN asin(10.0 / greatest(10.0, greatest(a.rbin, b.rbin) * 25.0)) ELSE pi() END)""",
    "alm_index": """SELECT id, l, id - l * l - l AS m, id AS back, (l + 1) * (l + 1) AS n FROM (
 SELECT o_orderkey AS id, CAST(floor(sqrt(o_orderkey + 0.5)) AS BIGINT) AS l FROM orders)""",
}
ORACLES["knn_join_blocks_open"] = ORACLES["knn_join_halos"]
