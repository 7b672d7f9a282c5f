"""Hard negatives against all pairs, in whole numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxima.llm import negatives


def brute(rows, anchors):
    """rows: (vec_id, label, whole vector); result rows as the operator returns them."""
    out = set()
    for own in anchors:
        label, q = min((r[1], r[2]) for r in rows if r[0] == own)
        scored = [(-sum(a * b for a, b in zip(q, v)), i, y) for i, y, v in rows if i != own]
        for s, positive, _ in sorted(x for x in scored if x[2] == label)[:negatives.POSITIVES]:
            band = sorted((n, i) for n, i, y in scored if y != label and 30 * -s <= 100 * -n <= 90 * -s)[:negatives.NEGATIVES]
            out |= {(own, positive, rank, i, -s, -n) for rank, (n, i) in enumerate(band, 1)}
    return out


def table(seed, n, d, clusters=False):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) / np.sqrt(d)
    if clusters:
        x = rng.standard_normal((12, d))[rng.integers(12, size=n)] / np.sqrt(d) + 0.05 * x
    return [(i, int(y), np.floor(256 * v).astype(int).tolist()) for i, (v, y) in enumerate(zip(x, rng.integers(4, size=n)))]


@pytest.mark.parametrize("d", [3, 64, 70])
def test_intervals_hold_every_score(d):
    rng = np.random.default_rng(d)
    rotation = negatives.rotation_of(d)
    for scale in (1, 300, 1e6):
        v, q = np.floor(scale * rng.standard_normal((300, d))), np.floor(scale * rng.standard_normal((20, d)))
        v[:5], q[:2] = 0, 0
        asked = negatives.Asked(q, rotation)
        low, high = asked.intervals(*negatives.encode(v, rotation))
        exact = q @ v.T
        assert (low <= exact).all() and (exact <= high).all()
        assert all((asked.scores(k, v) == exact[k]).all() for k in range(20))


def test_near_vectors_are_passed_over():
    """Tiles smaller than a cluster: most rows never get a score."""
    rows = table(3, 4000, 64, clusters=True)
    rotation = negatives.rotation_of(64)
    vectors, labels = np.array([r[2] for r in rows], float), np.array([r[1] for r in rows])
    order = np.argsort(negatives.keys_of(vectors, rotation), kind="stable")
    head = {"ids": np.arange(40), "labels": labels[:40], "vectors": vectors[:40]}
    block = negatives.Nearest({k: v.tobytes() for k, v in head.items()}, 64, rotation)
    for at in range(0, 4000, 100):
        held = order[at:at + 100]
        centre, codes, along, across = negatives.encode(vectors[held], rotation)
        parts = {"ids": held, "labels": labels[held], "vectors": vectors[held], "centre": centre, "codes": codes, "along": along, "across": across}
        block.see(negatives._Tile({k: np.ascontiguousarray(v).tobytes() for k, v in parts.items()}, 64))
    print(f"scored {block.scored} of {block.seen}")
    assert block.scored < block.seen / 2


@pytest.mark.parametrize("clusters", [False, True])
def test_all_pairs(spark, monkeypatch, clusters):
    monkeypatch.setattr(negatives, "TILE", 60)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rows = table(7, 900, 16, clusters)
    # a label with a third of all rows, ties, repeats, and an anchor alone with its label
    rows += [(1000 + i, 0, rows[i][2]) for i in range(300)] + [(2000, 99, rows[0][2]), (2001, 1, rows[0][2]), (2001, 2, rows[0][2])]
    docs = spark.createDataFrame([(i, y, [float(x) for x in v]) for i, y, v in rows], "vec_id long, label long, vector array<double>")
    got = negatives.Miner(docs.repartition(3), F.col("vec_id") % 100 == 0).negatives().collect()
    want = brute(rows, [i for i, _, _ in rows if i % 100 == 0])
    assert {tuple(r) for r in got} == want and len(got) >= len(want)


def test_rows_that_take_no_part(spark):
    good = [(i, i % 2, [1.0 + i / 300, 0.5, -0.1]) for i in range(30)]
    bad = [(None, 1, [1.0, 1.0, 1.0]), (100, None, [1.0, 1.0, 1.0]), (200, 1, None), (300, 1, [1.0, None, 1.0]), (400, 0, [float("nan"), 1.0, 1.0]),
           (500, 0, [float("inf"), 0.0, 0.0]), (600, 0, [1.0]), (700, 1, []), (800, 0, [1e30, 0.0, 0.0])]
    docs = spark.createDataFrame([(*r, "own", 1) for r in good + bad],
                                 "vec_id long, label int, embedding array<double>, grp string, serial int")
    whole = negatives.whole_vectors(docs)
    assert sorted(r[0] for r in whole.collect()) == list(range(30))
    assert whole.where("vec_id = 0").first()["vector"] == [256.0, 128.0, -26.0]
    got = negatives.Miner(whole, F.col("vec_id") % 100 == 0).negatives().collect()
    assert {tuple(r) for r in got} == brute([(r[0], r[1], [int(x) for x in r[2]]) for r in whole.collect()], [0])


def test_no_vectors_and_no_anchors(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    some = spark.createDataFrame([(1, 1, [1.0, 2.0])], "vec_id long, label int, embedding array<float>")
    for docs in (none, some):
        assert negatives.Miner(negatives.whole_vectors(docs), F.col("vec_id") % 100 == 0).negatives().collect() == []


def test_scores_past_doubles_are_whole_numbers(spark):
    big = 2.0**29
    rows = [(i, i % 2, [big + 3 * i, big - i, 1.0]) for i in range(40)]
    docs = spark.createDataFrame(rows, "vec_id long, label long, vector array<double>")
    got = negatives.Miner(docs, F.col("vec_id") % 100 == 0).positives().collect()
    exact = lambda v: sum(int(a) * int(b) for a, b in zip(rows[0][2], v))
    want = sorted(((-exact(v), i) for i, y, v in rows if y == 0 and i), key=lambda x: x)[:5]
    assert sorted((-r["positive_score"], r["positive_id"]) for r in got) == want
