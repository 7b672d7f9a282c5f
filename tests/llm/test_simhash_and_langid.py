import random
import re

import numpy as np
import pytest
import xxhash
from llm_samples import none, odd, prose  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from proxima.llm import langid, simhash
from proxima.llm.graph import components

SF = "/root/testdata/sf0.01"


def slow_print(text, words=4):
    held = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not held:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(held[i:i + words]).encode(), 42) for i in range(max(1, len(held) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints, ids, radius=4):
    """Smallest id reachable from each row."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, i in zip(group, ids):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [least.get(g) for g in group]


def test_fingerprints_follow_the_definition():
    for text in (None, "", " \t", "One", "a b c d", "a b c d e", "É é A a\x0bB", prose(5, 300)):
        assert simhash.fingerprint(text) % 2**64 == slow_print(text)


def test_long_texts_are_counted_in_parts(monkeypatch):
    whole = simhash.fingerprint(prose(6, 900))
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(prose(6, 900)) == whole


def test_tiles_lose_no_link(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(120):
        base = rng.getrandbits(64)
        prints += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for _ in range(rng.randrange(6))]
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fingerprint long")
    # tiles of a few rows make every kind of pair: within a tile, of one cell, of two
    edges = simhash.tile_pairs(frame, tile=3).mapInArrow(lambda it: simhash._compare(it, 4), "u long, v long")
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in components(edges).collect()}
    expected = slow_groups(prints, range(len(prints)))
    named = {}
    for p, e in zip(prints, expected):
        named.setdefault(e, set()).add(roots.get(p, p))
    assert all(len(x) == 1 for x in named.values())
    assert len({next(iter(x)) for x in named.values()}) == len(named)


def test_dense_tiles_merge_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "PENDING", 50)
    monkeypatch.setattr(simhash, "RUN", 8)
    values = np.array([1 << i for i in range(60)] + [2**63 + 2**40 - 1], np.uint64)
    u, v = simhash.link_forest(values, None, 2)
    assert len(u) == 59 and len(set(v.tolist())) == 1


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert len({roots[i] for i in range(301)}) == 1
    assert len({roots[i] for i in range(1000, 1200)}) == 1
    assert len(set(roots.values())) == 2


def test_odd_documents_and_brute_force(spark, odd):
    found = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    rows = [(r["doc_id"], slow_print(r["text"])) for r in odd.collect()]
    groups = slow_groups([p for _, p in rows], [i for i, _ in rows])
    key = lambda r: tuple((x is None, x or 0) for x in r)
    expected = sorted(((i, int(np.uint64(p).view(np.int64)), g) for (i, p), g in zip(rows, groups)), key=key)
    assert sorted(found, key=key) == expected


def test_one_of_each_group_stays(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows, before = kept.collect(), odd.collect()
    prints = [slow_print(r["text"]) for r in before]
    groups = slow_groups(prints, range(len(before)))
    smallest = [min((r["doc_id"] for r, g in zip(before, groups) if g == one and r["doc_id"] is not None), default=None) for one in set(groups)]
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in rows), key=key) == sorted(smallest, key=key)
    assert [r["doc_id"] for r in rows].count(3) == 2


def test_groups_with_the_same_id_keep_one_row_each(spark):
    rows = [(1, prose(21, 90)), (1, prose(22, 90)), (2, prose(21, 90)), (3, prose(22, 90)), (2, prose(23, 90)), (1, prose(21, 90)),
            (None, prose(22, 90)), (None, prose(24, 90)), (None, prose(24, 90)), (None, prose(25, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] is None, r)
    kept = sorted((tuple(r) for r in simhash.keep_one(docs).collect()), key=key)
    assert kept == sorted([rows[0], rows[1], rows[4], rows[7], rows[9]], key=key)


def test_simhash_of_nothing(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.op8_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert langid.op8_language_id(spark, SF).count() == docs.count()


def test_grams_do_not_depend_on_slices(monkeypatch):
    text = prose(9, 400)
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "SLICE", 10)
    assert all((a == b).all() for a, b in zip(whole, langid.gram_counts(text)))


def test_language_of_odd_documents(odd, none):
    rows = {(r["doc_id"], r["lang_pred"]): r for r in langid.identify(odd).collect()}
    assert len(langid.identify(odd).collect()) == odd.count()
    assert rows[(5, "und")]["score"] == 0.0 and (4, "und") in rows and (8, "und") in rows
    assert all(0.0 <= r["score"] <= 1.0 for r in rows.values())
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {None, 1, 2, 6, 7, 9, 10, 11}
    assert langid.identify(none).count() == 0 and langid.keep_identified(none).count() == 0


def test_documents_stay_without_a_model(odd):
    blank = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = langid.keep_identified(blank)
    assert sorted(r["text"] for r in kept.collect()) == sorted(
        r["text"] for r in odd.collect() if any(c.isalpha() for c in r["text"] or ""))


@pytest.mark.parametrize("text", [None, "", "123 !?"])
def test_texts_without_letters(text):
    model = langid.Model(("de", "en"), np.zeros((2, 1 << langid.BUCKET_BITS)), np.zeros(2))
    assert langid.score_text(model, text) == ("und", 0.0)
