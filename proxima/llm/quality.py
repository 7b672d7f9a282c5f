"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed terms: n-grams of its outline (runs of lower and
upper case letters, digits, white space and each other character, every run
written once), and how often a word or a line follows itself. Log counts times
inverse document frequency are projected on the leading singular directions of a
bounded labelled sample. The sample's unit vectors are broadcast; every document
is compared with all of them in blocks of exact cosine products, and its nearest
ones vote with their similarity as weight.

Defined results: a text that is null, empty or only white space scores 0. Votes
that tie with the last neighbour all count. Without any label every score is 0.5.
A document with several labels counts once, as the lowest. Texts are read whole,
in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import held_out, may_learn, ship_module, table, uniform

BUCKET_BITS = 10
ORDERS = (1, 2, 3, 4)
#: Sample bound: about so many labelled documents of either label.
PER_LABEL = 1500
DIMENSIONS = 48
NEIGHBOURS = 15
#: Similarities are raised to this power as weights.
SHARPNESS = 4
BLOCK = 512
SLICE = 1 << 20
THRESHOLD = 0.7

#: Class of each byte: a letter case, a digit, white space, or itself.
_CLASS = np.array([
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57
    else 10 if c in (10, 13) else 32 if c in (9, 11, 12, 32) else c for c in range(256)
], np.uint8)
#: Two terms beyond the hashed ones: a word, a line that follows itself.
WIDTH = (1 << BUCKET_BITS) + 2


def _repeats(items: list) -> int:
    return sum(map(eq, items, islice(items, 1, None)))


def terms_of(text: str | None) -> np.ndarray:
    """float64[WIDTH] of counts."""
    total = np.zeros(WIDTH)
    if not text or text.isspace():
        return total
    data = text.encode("utf-8", "replace")
    for at in range(0, len(data), SLICE):
        outline = _CLASS[np.frombuffer(data, np.uint8, min(SLICE, len(data) - at), at)]
        outline = outline[np.concatenate([[True], outline[1:] != outline[:-1]])].astype(np.uint32)
        for n in ORDERS:
            size = len(outline) - n + 1
            if size <= 0:
                continue
            mixed = np.full(size, n, np.uint32)
            for i in range(n):
                mixed = (mixed ^ outline[i:i + size]) * np.uint32(0x01000193)
                mixed ^= mixed >> np.uint32(15)
            bucket = (mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
            total[:-2] += np.bincount(bucket, minlength=1 << BUCKET_BITS)
    total[-2] = _repeats(text.split())
    total[-1] = _repeats(text.split("\n"))
    return total


@dataclass(frozen=True)
class Model:
    """idf[WIDTH], directions[WIDTH, d], vectors[m, d] of unit length, labels[m]."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts to unit rows of log counts by idf."""
    rows = np.log1p(counts) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [terms_of(t.as_py()).astype(np.float32).tobytes() for t in batch.column(1)]
        yield pa.record_batch({"label": batch.column(0), "counts": pa.array(counts, pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learn from labelled documents that may be learned from.

    About ``per_label`` documents of each label are taken by a repeatable random
    number; their term counts are all that reaches the driver.
    """
    ship_module(__name__)
    known = (
        labels.where(may_learn(F.col("doc_id")) & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("label"))
    )
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(0.0)
    for label, size in sizes.items():
        rate = F.when(F.col("label") == label, F.lit(min(1.0, per_label / size))).otherwise(rate)
    # bounded by the sample, so it may be broadcast
    chosen = known.where(uniform(F.col("doc_id"), 9) < rate)
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
        .mapInArrow(_sample_batches, "label int, counts binary").toPandas()
    )
    if not len(rows):
        return Model(np.zeros(WIDTH), np.zeros((WIDTH, 1)), np.zeros((0, 1)), np.zeros(0))
    counts = np.stack([np.frombuffer(c, np.float32) for c in rows["counts"]]).astype(np.float64)
    order = np.lexsort((*counts.T[-8:], counts.sum(1), rows["label"].to_numpy()))
    counts, target = counts[order], rows["label"].to_numpy(np.float64)[order]
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1.0
    weighed = _weigh(counts, idf)
    _, directions = np.linalg.eigh(weighed.T @ weighed)
    directions = directions[:, ::-1][:, :DIMENSIONS]
    return Model(idf, directions, _unit(weighed @ directions), target)


def score_rows(model: Model, counts: np.ndarray) -> np.ndarray:
    """Votes for rows of term counts."""
    if not len(model.labels):
        return np.full(len(counts), 0.5)
    out = np.zeros(len(counts))
    take = min(NEIGHBOURS, len(model.labels))
    for at in range(0, len(counts), BLOCK):
        part = counts[at:at + BLOCK]
        near = _unit(_weigh(part, model.idf) @ model.directions) @ model.vectors.T
        last = np.partition(near, near.shape[1] - take, axis=1)[:, near.shape[1] - take]
        weight = np.where(near >= last[:, None] - 1e-9, np.maximum(near, 1e-9) ** SHARPNESS, 0.0)
        out[at:at + BLOCK] = weight @ model.labels / weight.sum(1)
    out[~counts.any(1)] = 0.0
    return np.clip(out, 0.0, 1.0)


def predict(docs: DataFrame, text: Column, model: Model) -> Column:
    """The score of each text."""
    ship_module(__name__)
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.directions, model.vectors, model.labels))

    @F.pandas_udf("double")
    def vote(texts: pd.Series) -> pd.Series:
        own, out = Model(*shared.value), []
        for at in range(0, len(texts), BLOCK):
            out.append(score_rows(own, np.stack([terms_of(t) for t in texts[at:at + BLOCK]])))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return vote(text)


def score(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    vote = predict(docs, F.col("text"), fit(docs, labels, per_label))
    return (
        docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), vote.alias("score"))
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
