"""Small vectorised helpers that run inside tasks on one bounded block."""

import numpy as np
import pyarrow as pa

CHUNK = 64
CUBE_BITS = 2  # a cube has 4 cells a side
SLOTS = (1 << CUBE_BITS) + 2  # and one more on both sides
CANDIDATES = 1 << 20  # pairs looked at together
GATHERED = 1 << 16  # rows after which the places gathered so far are searched
ROW_BITS = 16  # room for the row within its block in a unit number
SERIAL_BITS = 24  # room for the block within its partition
FAR = 16.0  # squared ratio to the block's median bound that sets a query apart


def pair_r2(q, c, length):
    """Squared distances, float32 term by term: rows are queries."""
    total = None
    for axis in range(3):
        d = np.abs(q[:, axis, None] - c[None, :, axis])
        if length > 0:
            per = np.float32(length)
            np.copyto(d, per - d, where=d > np.float32(length / 2.0))
        d *= d
        total = d if total is None else total + d
    return total


def within_reach(axes, lo, hi, reach, length):
    """Mask of candidates no farther than ``reach`` from the box (lo, hi).

    ``axes`` holds one contiguous float32 array per axis; ``reach`` must allow
    for 32-bit rounding.
    """
    total = None
    for v, a, b in zip(axes, lo, hi):
        gap = np.abs(v - np.float32((a + b) / 2))
        if length > 0:
            np.minimum(gap, np.abs(np.float32(length) - gap), out=gap)
        gap -= np.float32((b - a) / 2)
        np.maximum(gap, 0, out=gap)
        gap *= gap
        total = gap if total is None else np.add(total, gap, out=total)
    return total <= np.float32(reach * reach)


def padded(r2, scale):
    """A radius safely above sqrt(r2) in spite of 32-bit rounding."""
    return np.sqrt(np.float64(r2)) * (1 + 1e-5) + 2e-6 * scale


def largest(*tables):
    return max([float(np.abs(t).max()) for t in tables if len(t)], default=0.0)


def chunks(q, c, bound2, length):
    """Neighbouring queries together with the candidates that can matter."""
    scale = max(length, largest(q, c))
    axes = [np.ascontiguousarray(c[:, i]) for i in range(3)]
    for start in range(0, len(q), CHUNK):
        part = slice(start, start + CHUNK)
        qs = q[part].astype(np.float64)
        worst = bound2[part].max()
        if np.isfinite(worst):
            keep = np.flatnonzero(
                within_reach(axes, qs.min(0), qs.max(0), padded(worst, scale), length)
            )
        else:
            keep = np.arange(len(c))
        yield part, keep


def first_bounds(q, c, weight, n, length):
    """A quick upper bound of the distance at rank n + 1.

    Both sides are in curve order, so rows at about the same relative position
    are near each other: a short run of candidates already gives a bound.
    """
    out = np.full(len(q), np.inf)
    half = max(CHUNK, n + 1)
    for start in range(0, len(q), CHUNK):
        part = slice(start, start + CHUNK)
        mid = (start + CHUNK // 2) * len(c) // max(len(q), 1)
        run = slice(max(0, mid - half), mid + half)
        got = ranked(q[part], c[run], weight[run], n, length)[:, 2]
        out[part] = np.where(np.isnan(got), np.inf, got)
    return out


def ranked(q, c, weight, n, length, bound2=None):
    """Squared distances at weighted ranks 1, n and n + 1; NaN where missing.

    A candidate of weight w stands for w coincident points.
    """
    out = np.full((len(q), 3), np.nan, dtype=np.float32)
    if not len(c) or not len(q):
        return out
    if bound2 is None:
        bound2 = np.full(len(q), np.inf)
    for part, keep in chunks(q, c, bound2, length):
        if not len(keep):
            continue
        r2, w = pair_r2(q[part], c[keep], length), weight[keep]
        rows = np.arange(len(r2))
        out[part, 0] = r2.min(axis=1)
        if (w == 1).all():
            if len(keep) > n:
                top = np.partition(r2, (n - 1, n), axis=1)
                out[part, 1], out[part, 2] = top[:, n - 1], top[:, n]
            elif len(keep) == n:
                out[part, 1] = r2.max(axis=1)
            continue
        few = min(n + 1, len(keep))
        at = np.argpartition(r2, few - 1, axis=1)[:, :few]
        near = np.take_along_axis(r2, at, 1)
        order = np.argsort(near, axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        seen = np.cumsum(np.take_along_axis(w[at], order, 1), axis=1)
        for col, rank in ((1, n), (2, n + 1)):
            pos = (seen < rank).sum(axis=1)
            found = pos < few
            out[part, col] = np.where(found, near[rows, np.minimum(pos, few - 1)], np.nan)
    return out


def nearest_lists(q, c, weight, ids, count, length, bound2):
    """Per query the ``count`` nearest candidates by (distance, id).

    Returns (offsets, r2, weight, id columns) of the concatenated lists.
    """
    by_id = np.lexsort(tuple(reversed(ids))) if ids else np.arange(len(c))
    c, weight, ids = c[by_id], weight[by_id], [i[by_id] for i in ids]
    sizes, r2s, picks = [], [], []
    for part, keep in chunks(q, c, bound2, length):
        r2 = pair_r2(q[part], c[keep], length)
        few = min(count, len(keep))
        at = np.argsort(r2, axis=1, kind="stable")[:, :few]
        r2s.append(np.take_along_axis(r2, at, 1).ravel())
        picks.append(keep[at].ravel())
        sizes.extend([few] * len(r2))
    flat = np.concatenate(picks) if picks else np.zeros(0, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    r2 = np.concatenate(r2s) if r2s else np.zeros(0, dtype=np.float32)
    return offsets, r2, weight[flat], [i[flat] for i in ids]


def column(table, name):
    return table.column(name).to_numpy(zero_copy_only=False)


def positions(table):
    return np.column_stack([column(table, a).astype(np.float32) for a in ("px", "py", "pz")])


def run_length(keys, rows, bits, first, last, before):
    """Rows of the largest aligned curve cell that starts a sorted run of keys.

    An aligned range of curve keys is a box in space. The range may not reach
    back to the key ``before``, nor below ``first`` or above ``last`` where the
    partition ends there, because what lies beyond is not in the run; and it
    holds at most ``rows`` rows. Only the rows of one finest cell are cut
    without regard to it.
    """
    key = int(keys[0])
    for shift in range(bits, 0, -1):
        low = key >> shift << shift
        high = low + (1 << shift)
        if before is not None and low <= before or first is not None and low < first or last is not None and high - 1 > last:
            continue
        size = int(np.searchsorted(keys, high, "left"))
        if size <= rows:
            return size
    return min(rows, int(np.searchsorted(keys, key, "right")))


def block_cutter(rows_per_block, n, length, bits, alone):
    """mapInArrow body: cut a sorted partition into blocks at aligned curve cells.

    A block holds every row of its cell, so rows of other blocks come near it
    only from outside the cell's box, however uneven the density. ``alone``
    says that there is no other partition whose rows could share a cell.

    Adds the block number and, for query rows, the squared distance within
    which ``n + 1`` data points are already known to lie. A query whose bound
    is far above its block's median becomes a unit of its own, so that one
    outlier does not widen the search of the whole block. Held are the rows not
    yet cut, two blocks' worth and a batch at most, and as many data rows
    before them.
    """

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        if part >> (63 - ROW_BITS - SERIAL_BITS):
            raise ValueError(f"partition {part}: block numbers are full")
        base = part << SERIAL_BITS
        state = {"serial": 0, "earlier": (np.zeros((0, 3), np.float32), np.zeros(0, np.int64))}

        def data_of(rows):
            xyz, nd = positions(rows), column(rows, "nd")
            return xyz[nd > 0], nd[nd > 0]

        def close(rows, after):
            if state["serial"] >> SERIAL_BITS:
                raise ValueError(f"partition {part}: over {1 << SERIAL_BITS} blocks; use more partitions or larger blocks")
            xyz, nd, nq = positions(rows), column(rows, "nd"), column(rows, "nq")
            has = nd > 0
            c, w = xyz[has], nd[has]
            if w.sum() <= n:
                near = [state["earlier"], (c, w), data_of(after)]
                c, w = (np.concatenate(x) for x in zip(*near))
            bound = np.full(len(xyz), np.inf, dtype=np.float32)
            asks = nq > 0
            q = xyz[asks]
            far = ranked(q, c, w, n, length, first_bounds(q, c, w, n, length))[:, 2]
            bound[asks] = np.where(np.isnan(far), np.inf, far)
            kept = [np.concatenate(x)[-rows_per_block:] for x in zip(state["earlier"], (xyz[has], nd[has]))]
            state["earlier"] = tuple(kept)
            block = np.full(len(xyz), (base + state["serial"]) << ROW_BITS, dtype=np.int64)
            state["serial"] += 1
            solo = np.zeros(len(xyz), dtype=bool)
            if asks.any():
                solo[asks] = bound[asks] > FAR * np.median(bound[asks])
            unit = np.where(solo, block + 1 + np.arange(len(xyz)), block)
            for name, values in (("bound2", bound), ("block", block), ("unit", unit), ("solo", solo)):
                rows = rows.append_column(name, pa.array(values))
            return rows.drop_columns(["_key"]).combine_chunks()

        held, first, before = None, None, None
        for batch, more in with_more(batches):
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = column(held, "_key")
            if first is None and len(keys):
                first = int(keys[0])
            at = 0
            # a cell is known to be whole when more rows than it may hold are seen
            while len(keys) - at > (2 * rows_per_block if more else 0):
                edges = (None if alone else first, None if alone or more else int(keys[-1]))
                size = run_length(keys[at:], rows_per_block, bits, *edges, before)
                end = at + size
                yield from close(held.slice(at, size), held.slice(end, rows_per_block)).to_batches()
                before, at = int(keys[end - 1]), end
            held = held.slice(at)

    return run


def with_more(batches):
    """Each batch, and whether another follows."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield held, True
        held = batch
    if held is not None:
        yield held, False


def group_search(n, length, ids, lists, shared=False):
    """applyInArrow body: answer the queries of one block share.

    ``ghost`` is false for the block's own rows, which are candidates only in
    share 0, so that no candidate is counted twice when shares are merged.
    """

    def run(key, table):
        xyz, nd, nq = positions(table), column(table, "nd"), column(table, "nq")
        ghost = column(table, "ghost")
        share = key[1].as_py()
        asks = (nq > 0) & ~ghost
        cand = (nd > 0) & (ghost | (share == 0))
        q, c, w = xyz[asks], xyz[cand], nd[cand]
        bound2 = column(table, "bound2")[asks].astype(np.float64)
        own = table.filter(pa.array(asks))
        cols = {k: own.column(k) for k in ("px", "py", "pz", "nq", "ia", "ib")}
        if not lists:
            got = ranked(q, c, w, n, length, bound2)
            for i, name in enumerate(("first_r2", "nth_r2", "next_r2")):
                cols[name] = pa.array(got[:, i], from_pandas=True)
        else:
            id_cols = [column(table, k)[cand] for k in ("ia", "ib")] if ids else []
            offs, r2, wt, picked = nearest_lists(q, c, w, id_cols, n + 1, length, bound2)
            fields = {"r2": pa.array(r2)}
            if ids:
                fields["ia"], fields["ib"] = pa.array(picked[0]), pa.array(picked[1])
            fields["w"] = pa.array(wt.astype(np.int64))
            cols["near"] = pa.ListArray.from_arrays(
                pa.array(offs), pa.StructArray.from_arrays(list(fields.values()), list(fields))
            )
            if shared:
                cols["share"] = pa.array(np.full(len(q), share, np.int32))
        return pa.table(cols)

    return run


def near_pairs(radius, length, width, n, q_names, p_names, total):
    """mapInArrow body over rows sorted by place (cube and shares): pairs within the radius, or totals of the points.

    ``width`` and ``n`` describe the grid of cells; a pair is looked at when its cells are the same or neighbours.
    """
    reach = np.float32(radius) * np.float32(radius)
    steps = (-1, 0, 1) if n is None or n >= 3 else tuple(range(n))
    # neighbours along z have successive numbers unless they wrap round within the slots
    runs = [(-1, 1)] if n is None or n >= SLOTS else [(o, o) for o in steps]

    def slots(xyz, cubes):
        cells = np.floor(xyz.astype(np.float64) / width).astype(np.int64)
        if n is not None:
            np.clip(cells, 0, n - 1, out=cells)
        cells += 1 - (cubes << CUBE_BITS)
        return cells if n is None else cells % n

    def numbered(place, slot):
        return ((place * SLOTS + slot[:, 0]) * SLOTS + slot[:, 1]) * SLOTS + slot[:, 2]

    def search(table):
        keys = np.stack([column(table, k) for k in ("_cx", "_cy", "_cz", "_s", "_t")], axis=1).astype(np.int64)
        place = np.cumsum(np.r_[False, (keys[1:] != keys[:-1]).any(axis=1)])
        asks = table.column("_q").is_valid().to_numpy()
        part = lambda name, mask: pa.RecordBatch.from_struct_array(table.column(name).filter(pa.array(mask)).combine_chunks())
        q, p = part("_q", asks), part("_p", ~asks)
        at = lambda batch, names: np.stack([batch.column(c).to_numpy() for c in names], axis=1)
        q_xyz, p_xyz = at(q, ("qx", "qy", "qz")), at(p, ("px", "py", "pz"))
        q_place, q_slot = place[asks], slots(q_xyz, keys[asks, :3])
        p_cell = numbered(place[~asks], slots(p_xyz, keys[~asks, :3]))
        order = np.argsort(p_cell, kind="stable")
        p_cell, p_xyz, p = p_cell[order], p_xyz[order], p.take(pa.array(order))
        weight = p.column(total).to_numpy() if total else None
        sums = np.zeros(len(q_xyz), np.int64)
        for ox in steps:
            for oy in steps:
                for low, high in runs:
                    moved = lambda oz: q_slot + np.array([ox, oy, oz])
                    ends = [numbered(q_place, m if n is None else m % n) for m in (moved(low), moved(high))]
                    first = np.searchsorted(p_cell, ends[0], "left")
                    many = np.searchsorted(p_cell, ends[1], "right") - first
                    before = np.r_[0, np.cumsum(many)]
                    start = 0
                    while start < len(many):
                        stop = max(start + 1, int(np.searchsorted(before, before[start] + CANDIDATES, "right")) - 1)
                        some = many[start:stop]
                        qi = np.repeat(np.arange(start, stop), some)
                        pi = np.arange(len(qi)) + np.repeat(first[start:stop] - before[start:stop] + before[start], some)
                        r2 = paired_r2(q_xyz[qi], p_xyz[pi], length)
                        near = np.flatnonzero(r2 <= reach)
                        qi, pi, start = qi[near], pi[near], stop
                        if total:
                            # whole numbers, exact in double precision far beyond any count of rows
                            sums += np.bincount(qi, weight[pi], len(sums)).astype(np.int64)
                        elif len(near):
                            q_rows, p_rows = q.take(pa.array(qi)), p.take(pa.array(pi))
                            yield pa.RecordBatch.from_arrays([*q_rows.columns, *p_rows.columns, pa.array(r2[near])], names=[*q_names, *p_names, "r2"])
        if total and len(sums):
            some = np.flatnonzero(sums)
            q_rows = q.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*q_rows.columns, pa.array(sums[some])], names=[*q_names, "n_within"])

    def run(batches):
        held = []
        size = 0
        for batch, more in with_more(batches):
            held.append(batch)
            size += batch.num_rows
            if more and size < GATHERED:
                continue
            table = pa.Table.from_batches(held)
            end = size
            if more:
                # the last place may go on in the next batch
                keys = np.stack([column(table, k) for k in ("_cx", "_cy", "_cz", "_s", "_t")], axis=1)
                same = (keys == keys[-1]).all(axis=1)
                end = int(np.argmax(same))
            if end:
                yield from search(table.slice(0, end))
            held = table.slice(end).to_batches()
            size -= end

    return run


def paired_r2(a, b, length):
    """Squared distances of rows side by side, float32 term by term."""
    sum_ = None
    for axis in range(3):
        d = np.abs(a[:, axis] - b[:, axis])
        if length > 0:
            np.copyto(d, np.float32(length) - d, where=d > np.float32(length / 2.0))
        d *= d
        sum_ = d if sum_ is None else sum_ + d
    return sum_
