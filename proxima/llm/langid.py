"""Language identification: multinomial naive Bayes over hashed character n-grams.

``fit`` counts n-grams per language in Spark over a bounded sample of labelled
documents and turns the summed counts into a log-probability matrix of
languages x buckets, which is broadcast. ``predict`` scores each batch in numpy:
a text becomes the sparse counts of its buckets, and these times the matrix give
one sum per language.

Defined results: a text that is null, empty or without a letter gets ``und`` and
score 0, as does every text when nothing could be learned. Equal sums go to the
language that sorts first. Repeated rows are rows like any other. Texts are read
whole, in slices, so memory does not follow their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import may_learn, ship_module, table, uniform, held_out

BUCKET_BITS = 15
ORDERS = (1, 2, 3)
#: Sample bound: about so many labelled documents are read for each language.
PER_LANG = 3000
SLICE = 1 << 19
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """languages: sorted names; weights: float64[languages, buckets]; prior: float64[languages]."""

    languages: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def gram_counts(text: str, bits: int = BUCKET_BITS, orders=ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the lower-cased text's n-grams and their counts; none without a letter."""
    total, seen, longest = np.zeros(1 << bits, np.int64), False, max(orders)
    for at in range(0, len(text), SLICE):
        part = text[max(0, at - longest + 1):at + SLICE].lower()
        code = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[code]
        seen |= bool(letter.any())
        code = np.where(letter, code, np.uint32(32))
        # what the overlap with the slice before would count twice is left out
        fresh = min(at, longest - 1)
        for n in orders:
            size = len(code) - n + 1
            if size <= 0:
                continue
            mixed = np.full(size, n, np.uint32)
            for i in range(n):
                mixed = (mixed ^ code[i:i + size]) * np.uint32(0x01000193)
                mixed ^= mixed >> np.uint32(15)
            mixed = mixed[max(0, fresh - n + 1):]
            total += np.bincount((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=1 << bits)
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = np.flatnonzero(total)
    return ids, total[ids]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            ids, n = gram_counts(text) if text else ((), ())
            if len(ids):
                total.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))[ids] += n
    for lang, counts in total.items():
        ids = np.flatnonzero(counts)
        yield pa.record_batch({
            "lang": pa.array([lang] * len(ids), pa.string()),
            "bucket": pa.array(ids.astype(np.int32)), "n": pa.array(counts[ids]),
        })


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learn from rows of (doc_id, text, lang) that may be learned from and have a language.

    The sample takes a document when its repeatable random number is below
    per_lang / (documents of its language), so about ``per_lang`` of each; only
    bucket sums, at most languages x 2**BUCKET_BITS of them, reach the driver.
    """
    ship_module(__name__)
    known = docs.select("doc_id", "text", "lang").where(may_learn(F.col("doc_id")) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((0, 1 << BUCKET_BITS)), np.zeros(0))
    rate = F.lit(None).cast("double")
    for lang in languages:
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / sizes[lang]))).otherwise(rate)
    sums = (
        known.where(uniform(F.col("doc_id"), 8) < rate).select("lang", "text")
        .mapInArrow(_count_batches, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    counts = np.ones((len(languages), 1 << BUCKET_BITS))
    place = {lang: i for i, lang in enumerate(languages)}
    np.add.at(counts, (sums["lang"].map(place).to_numpy(np.int64), sums["bucket"].to_numpy(np.int64)), sums["n"].to_numpy(np.float64))
    prior = np.array([sizes[lang] for lang in languages], np.float64)
    return Model(languages, np.log(counts / counts.sum(1, keepdims=True)), np.log(prior / prior.sum()))


def score_text(model: Model, text: str | None) -> tuple[str, float]:
    """Language and its posterior probability."""
    ids, n = gram_counts(text) if text else ((), ())
    if not len(ids) or not model.languages:
        return UNKNOWN, 0.0
    sums = model.prior + model.weights[:, ids] @ n.astype(np.float64)
    best = int(np.argmax(sums))
    return model.languages[best], float(1.0 / np.exp(sums - sums[best]).sum())


def predict(docs: DataFrame, text: Column, model: Model) -> Column:
    """A struct column (lang, score) for the text column of ``docs``."""
    ship_module(__name__)
    # plain values: workers need not be able to import this package
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.prior))

    @F.pandas_udf("lang string, score double")
    def classify(texts: pd.Series) -> pd.DataFrame:
        own = Model(*shared.value)
        return pd.DataFrame([score_text(own, t) for t in texts], columns=["lang", "score"])

    return classify(text)


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    found = predict(docs, F.col("text"), fit(docs, per_lang))
    return (
        docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("found"))
        .select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
    )


def keep_identified(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """The documents, all their columns, whose language could be told.

    Where nothing could be learned, only texts without a letter go.
    """
    model = fit(docs, per_lang)
    if not model.languages:
        model = Model(("any",), np.zeros((1, 1 << BUCKET_BITS)), np.zeros(1))
    return docs.where(predict(docs, docs["text"], model)["lang"] != UNKNOWN)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
