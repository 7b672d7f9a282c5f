"""The pipeline against a plain version of its stages on a small table with planted cases."""

from array import array

import pytest
from llm_samples import prose
from test_decontam_and_lines import slow, slow_lines
from test_simhash_and_langid import slow_groups, slow_print

import corpus_pipeline
from proxima.llm import lines
from proxima.llm.pieces import Pieces, load_model

ITEMS = [(1, prose(1001, 40)), (2, prose(1002, 20))]


def planted():
    docs = [(i, "\n".join(["Home | News", prose(i, 60), prose(500 + i, 40)]), "en", f"src{i % 3}") for i in range(45)]
    docs += [(100 + i, docs[0][1], "en", "src0") for i in range(4)]  # copies
    docs += [(110 + i, docs[1][1] + (" ." * i), "en", "src1") for i in range(3)]  # near copies
    docs += [(120, prose(7, 200) + " " + ITEMS[0][1], "en", "src2"), (121, ITEMS[1][1].upper(), "en", "src2")]  # contaminated
    docs += [(122, prose(8, 900) + " " + " ".join(ITEMS[1][1].split()[:13]), "en", "src2")]  # a trace only
    docs += [(130, "12 34 -- 56", "en", "src0"), (131, None, "en", "src0"), (132, "", None, None)]  # no language
    docs += [(133, "Ein Satz mit Umlauten: über, schön, größer.", "de", None)]
    return docs


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in planted()],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_are_plain_versions(spark, tables):
    known = [d for d in planted() if d[1] and any(c.isalpha() for c in d[1])]
    texts = slow_lines([(s, t) for _, t, _, s in known], lines.RATIO, lines.MIN_PAGES)
    cut = [(i, t, l, s) for (i, _, l, s), t in zip(known, texts)]
    assert any(a[1] != b[1] for a, b in zip(known, cut))
    groups = slow_groups([slow_print(t) for _, t, _, _ in cut], [i for i, _, _, _ in cut])
    single = [d for d, g in zip(cut, groups) if d[0] == g]
    clean = [d for d in single if not slow(d[1], ITEMS)[-1]]
    assert len(clean) < len(single) < len(cut) < len(planted())
    expected = [None, known, cut, single, clean]

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], expected[1:]):
        docs = corpus_pipeline.stage_table(stage(spark, docs, tables), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert got == {d[0]: d[1] for d in rows}, name
    own = Pieces(*load_model())
    final = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()}
    assert set(final) == {d[0] for d in clean}
    for i, text, _, _ in clean:
        (score, ids), *_ = own.nbest(text, 2)
        assert array("i", final[i]["piece_ids"]) == ids and final[i]["score"] == score and own.decode(final[i]["piece_ids"]) == text


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert 120 not in {r["doc_id"] for r in rows} and {122, 133} <= {r["doc_id"] for r in rows}
    assert sum(r["doc_id"] in (0, 100, 101, 102, 103) for r in rows) == 1


def test_lines_of_a_section_are_boilerplate(spark):
    said = ["Part of the archive section"] + [None] * 19
    rows = [(i, "\n".join(filter(None, [said[i % 20], prose(i, 20)])), "en", "src") for i in range(200)]
    rows = [(i, t + ("\nSeen four times" if i < 4 else ""), l, s) for i, t, l, s in rows]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.boilerplate(spark, docs, "").collect()}
    assert got == {i: t.replace(said[0] + "\n", "") for i, t, _, _ in rows}
