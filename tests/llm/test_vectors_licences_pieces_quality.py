import textwrap
from array import array
from collections import Counter

import numpy as np
import pytest
from llm_samples import none, odd, prose  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from proxima.llm import ann, licences, pieces, quality
from proxima.llm.common import words_of

SF = "/root/testdata/sf0.01"


def brute_nearest(rows, asked, k=10):
    """rows: (id, vector); the k nearest of each asked id by (distance, id)."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        keep = ids != q
        order = np.lexsort((ids[keep], d[keep]))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), d[keep][order].tolist()))
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, sf):
    table = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{table}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = {}
    for r in ann.op4_nearest(spark, table).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    expected = brute_nearest(rows, [i for i, _ in rows if i % 100 == 0])
    hits = 0
    for q, near in expected.items():
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 11)) and got == sorted(got, key=lambda g: (g[2], g[1]))
        hits += len({g[1] for g in got} & {n[0] for n in near})
    assert hits >= 0.9 * 10 * len(expected)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    same = [(1000 + i, [1.0] * 6) for i in range(700)]  # most rows are one vector
    bad = [(2000, None), (2100, [0.0] * 6), (2200, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2300, [float("nan")] * 6), (2400, [float("inf")] + [1.0] * 5),
           (2500, [1.0, 2.0]), (None, [1.0] * 6), (200, rows[200][1])]
    table = spark.createDataFrame(rows + same + bad, "vec_id long, embedding array<double>").withColumn("list", F.lit(1)).withColumn("vector", F.lit("x"))
    fine = ann.usable(table)
    assert fine.count() == 1001
    found = {}
    for r in ann.Index(fine, probed=1.0).search(fine.where(ann.is_query(F.col("vec_id")))).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    expected = brute_nearest(rows + same, [i for i, _ in rows + same if i % 100 == 0])
    assert set(found) == set(expected)
    close = total = 0
    for q, near in expected.items():
        close += len({n[0] for n in near} & {g[1] for g in found[q]})
        total += len(near)
    assert close >= 0.95 * total
    assert [g[1] for g in sorted(found[1000])] == list(range(1001, 1011))


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [5.0, 5.0])], "vec_id long, embedding array<float>")
    fine = ann.usable(few)
    got = [tuple(r) for r in ann.Index(fine, probed=0.01).search(fine.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 5.0)]
    empty = ann.usable(few.limit(0))
    assert ann.Index(empty).search(empty).count() == 0


def bag(text):
    held = words_of(text)
    return Counter(zip(held, held[1:]))


def dice(a, b):
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


def test_licence_coefficients_are_brute_forces():
    own = licences.Templates()
    mit = licences.TEMPLATES["MIT"]
    for text in (mit, mit.replace("Software", "Work"), mit[:len(mit) // 2], "Released under the MIT License.", prose(1, 40),
                 mit.upper() + " with a few words more", "Licensed under CC BY-NC 4.0", "released under the BSD license"):
        best = max(((dice(bag(text), bag(t)), n) for n, t in licences.TEMPLATES.items()), key=lambda x: (x[0], x[1]))
        whole = [m for m in own.scan(text.replace("\n", " "))]
        if best[0] >= licences.THRESHOLD:
            assert whole and whole[0][0] == best[1] and whole[0][3] == pytest.approx(best[0])
        else:
            assert not whole


def test_licences_inside_documents(spark, odd, none):
    notice = licences.TEMPLATES["GPL-3.0 notice"].replace("            ", "")
    texts = [prose(1, 50) + "\nReleased under the MIT License.\n" + prose(2, 50), prose(3, 200) + "\n\n" + notice + "\n\n" + prose(4, 300),
             None, "", "one", prose(1, 9), "\n".join(["Released under the MIT License."] * 500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(m) for m in r["f"]] for r in docs.select("doc_id", licences.licences(docs, F.col("text")).alias("f")).collect()}
    assert got[0] == [("MIT notice", 1, 2, 1.0)]
    assert [m[0] for m in got[1]] == ["GPL-3.0 notice"] and got[1][0][3] == 1.0
    assert got[2] == got[3] == got[4] == got[5] == [] and len(got[6]) == 500
    assert odd.select(licences.licences(odd, odd["text"])).count() == odd.count()
    assert none.select(licences.licences(none, none["text"])).count() == 0


def wrapped(name):
    return textwrap.fill(" ".join(licences.TEMPLATES[name].split()), 70)


@pytest.mark.parametrize("names", [
    ("MIT", "ISC"), ("MIT", "BSD-2-Clause"), ("MIT", "MIT"), ("Apache-2.0 notice", "GPL-3.0 notice"), ("Zlib", "MIT", "MIT", "ISC", "Zlib")])
def test_licences_in_a_row(names):
    own = licences.Templates()
    for apart in ("\n", "\n\n", " "):
        texts = [wrapped(n) for n in names]
        got = own.scan(prose(1, 30) + "\n" + apart.join(texts) + "\n" + prose(2, 30))
        assert [(m[0], m[3]) for m in got] == [(n, 1.0) for n in names]
        if apart == "\n":
            ends = np.cumsum([1, *(t.count("\n") + 1 for t in texts)]).tolist()
            assert [m[1:3] for m in got] == list(zip(ends, ends[1:]))


def test_licences_inside_a_line():
    own = licences.Templates()
    said = "This is a site. Released under the MIT License. See the web page for more of it, and of the rest."
    assert own.scan(said) == [("MIT notice", 0, 1, 1.0)]
    mit = " ".join(licences.TEMPLATES["MIT"].split())
    assert own.scan(prose(1, 250) + " " + mit + " " + prose(2, 250)) == [("MIT", 0, 1, 1.0)]
    # altered ones: words changed, lost and put in
    worn = mit.replace("Software", "Work").replace("free of charge, ", "").replace("WITHOUT WARRANTY", "WITHOUT ANY WARRANTY")
    got = own.scan(prose(1, 250) + " " + worn + " " + worn + "\n" + prose(2, 250))
    assert [m[:3] for m in got] == [("MIT", 0, 1)] * 2


@pytest.mark.parametrize("name, said", [
    ("AGPL-3.0 notice", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3"),
    ("LGPL-2.1 notice", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1"),
    ("LGPL-3.0 notice", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products")])
def test_relatives_get_their_own_name(name, said):
    assert said in " ".join(licences.TEMPLATES[name].split())
    own = licences.Templates()
    for text in (wrapped(name), prose(1, 200) + " " + wrapped(name) + " " + prose(2, 200)):
        assert [(m[0], m[3]) for m in own.scan(text)] == [(name, 1.0)]


def all_paths(own, segment):
    out = []

    def go(at, score, ids):
        if at == len(segment):
            out.append((score, ids))
        for end in range(at + 1, len(segment) + 1):
            held = own.pieces.get(segment[at:end])
            if held:
                go(end, score + held[1], [*ids, held[0]])
        if at < len(segment) and not own.pieces.get(segment[at]):
            go(at + 1, score + own.fallback, ids + list(array("i", own._ids(segment[at], [(0, -1)]))))

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(*pieces.load_model())


@pytest.mark.parametrize("text", ["then the", "añb ▁x  y", "hello\nwor", "thblealy", "a", " ", "日本 x", "9b0b", "￿▁"])
def test_nbest_is_every_paths_best(own, text):
    want = all_paths(own, (" " + text).replace(pieces.SPACE, pieces.APART).replace(" ", pieces.SPACE))
    for n in (1, 2, 4, 7):
        got = own.nbest(text, n)
        assert all(own.decode(ids) == text for _, ids in got)
        assert len({tuple(ids) for _, ids in got}) == len(got)
        assert [s for s, _ in got] == [s for s, _ in want[:n]]
        assert all((s, list(ids)) in want for s, ids in got)


def test_segments_do_not_depend_on_slices(own, monkeypatch):
    text = prose(4, 200) + " ünï 🙂\n▁"
    whole = own.segments(text)
    monkeypatch.setattr(pieces, "SLICE", 7)
    assert own.segments(text) == whole


@pytest.mark.parametrize("char", ["x", "=", "é"])
def test_long_runs_take_memory_in_proportion(own, char):
    import tracemalloc

    peak = []
    for length in (10_000, 40_000):
        tracemalloc.start()
        paths = own.nbest_segment(char * length, 3)
        peak.append(tracemalloc.get_traced_memory()[1] / length)
        tracemalloc.stop()
        # the vocabulary has one way only to write a run of é
        scores = [score for score, _ in paths]
        assert len(paths) == (1 if char == "é" else 3) and scores == sorted(scores, reverse=True)
    assert peak[1] < 1.5 * peak[0] and peak[1] < 1000  # bytes a character


def test_forgetting_changes_nothing(own, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    fresh = pieces.Pieces(*pieces.load_model())
    text = prose(5, 300)
    assert fresh.nbest(text, 3) == own.nbest(text, 3) and len(fresh.known) <= 3


def test_round_trip_in_spark(spark, odd, none):
    coded = odd.withColumn("best", pieces.encode(odd, odd["text"], n=2))
    spelled = coded.select("text", pieces.decode(coded, F.get("best", F.lit(0))["ids"]).alias("back"), "best")
    for r in spelled.collect():
        assert r["back"] == (r["text"] or "") and len(r["best"]) in (1, 2)
        assert r["text"] or (r["best"][0]["score"] == 0 and r["best"][0]["ids"] == [])
    assert none.select(pieces.encode(none, none["text"])).count() == 0


def test_quality_of_held_out_documents(spark):
    found = quality.op9_quality(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found.count() == docs.count()
    labelled = found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    right = labelled.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.93


def test_quality_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 0), (6, 1, 0), (5, 0, 0), (7, None, 0), (10, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (4, 8)} == {0.0}
    assert {r["score"] for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score(none, labels).count() == 0
