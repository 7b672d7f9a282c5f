"""Benchmark decontamination with a distributed positional inverted index.

Documents are indexed in segments, one row each: the segment's documents, and
for every term that the test items hold the positions of its tokens. Terms no
item holds cannot match and get no postings. The index is written to the shared
folder and read column by column: the counts alone give how rare each term is
in the whole corpus, then the search intersects, segment by segment, the
offset-adjusted lists of a window's terms from the rarest on. Windows stand in
buckets by their rarest term; a segment visits the buckets of terms it holds, drops
windows that have a term it lacks, and follows the places of all others at once. A segment is
bounded in tokens, so neither frequent words nor frequent passages gather in one
task, and nothing is shuffled: postings stay with their documents.

A list of the next term may differ from its place by ``slop`` words; what is left
at slop 0 is an exact phrase, the rest are proximity matches.

Defined results: a null or empty text has no words, no matches and is clean. An
item without words has no window. Items that repeat an id count once, a null id
as ``null``. A repeated document is judged each time it occurs. An empty
benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import free_name, ship_module, stage_table, table, words_of

WINDOW = 13
SLOP = 2
#: A document is contaminated if one in so many of its words is hit.
SHARE = 20
#: Words of test items whose terms are looked for in one pass; more items take more passes.
PASS_WORDS = 2_000_000
SEGMENT_TOKENS = 1 << 20
#: Places of rarest terms that the search of a segment follows at once.
CANDIDATES = 1 << 20
SEGMENT_DOCS = 1 << 15


class TestSet:
    """Terms, different windows and the items that hold each window."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.terms: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = tuple(self.terms.setdefault(w, len(self.terms)) for w in words_of(text))
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                held.setdefault(ids[at:at + window], set()).add(name)
        self.windows = list(held)
        self.names = sorted({name for names in held.values() for name in names})
        number = {name: i for i, name in enumerate(self.names)}
        self.held = np.array([number[n] for names in held.values() for n in sorted(names)], np.int32)
        self.held_starts = np.concatenate([[0], np.cumsum([len(names) for names in held.values()], dtype=np.int64)])

    def plan(self, frequency: np.ndarray) -> Plan:
        """The windows with their terms rarest first, in buckets by the rarest."""
        sizes = np.array([len(w) for w in self.windows], np.int64)
        width = int(sizes.max(initial=1))
        filled = np.arange(width) < sizes[:, None]
        terms = np.full(filled.shape, -1, np.int32)
        terms[filled] = np.fromiter(chain.from_iterable(self.windows), np.int32, int(sizes.sum()))
        rarity = np.where(filled, frequency[terms], np.iinfo(np.int64).max)
        offsets = np.argsort(rarity, axis=1, kind="stable")
        terms = np.take_along_axis(terms, offsets, 1)
        order = np.argsort(terms[:, 0], kind="stable")
        starts = np.searchsorted(terms[order, 0], np.arange(len(self.terms) + 1))
        return Plan(terms[order], offsets[order].astype(np.int32), sizes[order], starts, order,
                    self.held, self.held_starts, self.names)


class Plan(NamedTuple):
    terms: np.ndarray  # a row for each window, rarest term first, -1 beyond its end
    offsets: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray  # first window of each term's bucket
    numbers: np.ndarray  # the window's number in the test set
    held: np.ndarray  # items of the windows, one window after another
    held_starts: np.ndarray
    names: list[str]

    def items(self, window: int) -> list[str]:
        at = self.numbers[window]
        return [self.names[i] for i in self.held[self.held_starts[at]:self.held_starts[at + 1]]]

    def possible(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Windows all of whose terms a segment holds; only buckets of terms it holds are visited."""
        first, last = self.starts[found], self.starts[found + 1]
        alive = _runs(first, last - first)
        for k in range(1, self.terms.shape[1]):
            terms = self.terms[alive, k]
            alive = alive[(terms < 0) | (counts[terms] > 0)]
        return alive


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, as many as its size, one run after another."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _index(batches: Iterator[pa.RecordBatch], terms: dict[bytes, int], gap: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) to one row per segment; positions of different documents are ``gap`` apart."""
    get = terms.get
    keys: list = []
    lengths: list[int] = []
    parts: list[np.ndarray] = []
    places: list[np.ndarray] = []
    base = 0

    def segment() -> pa.RecordBatch:
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        where = np.concatenate(places) if places else np.zeros(0, np.int32)
        order = np.argsort(ids, kind="stable")
        found, counts = np.unique(ids, return_counts=True)
        return pa.record_batch({
            "keys": pa.array([keys], key_type), "lengths": pa.array([lengths], pa.list_(pa.int32())),
            "terms": pa.array([found.astype(np.int32)], pa.list_(pa.int32())),
            "counts": pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
            "postings": pa.array([where[order].astype(np.int32).tobytes()], pa.binary()),
        })

    key_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("key", pa.string())]))
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = words_of(text.as_py())
            if keys and (base + len(found) + gap > SEGMENT_TOKENS or len(keys) >= SEGMENT_DOCS):
                yield segment()
                keys, lengths, parts, places, base = [], [], [], [], 0
            ids = np.array([get(w, -1) for w in found], np.int32)
            at = np.flatnonzero(ids >= 0)
            keys.append(key)
            lengths.append(len(found))
            parts.append(ids[at])
            places.append((at + base).astype(np.int32))
            base += len(found) + gap
    if keys:
        yield segment()


def _places(plan: Plan, found, counts, postings, slop: int, room: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Where windows stand in a segment: window, begin, place of the rarest term, words it is off.

    ``room`` is more than any place. Windows are taken a few at a time, so that at most CANDIDATES
    places of rarest terms are followed at once, or those of one window.
    """
    starts = np.concatenate([[0], np.cumsum(counts)])
    keys = np.repeat(found.astype(np.int64), counts[found]) * room + postings
    possible = plan.possible(found, counts)
    seen = np.cumsum(counts[plan.terms[possible, 0]])
    at = 0
    while at < len(possible):
        end = max(at + 1, int(np.searchsorted(seen, (seen[at - 1] if at else 0) + CANDIDATES, "right")))
        part = possible[at:end]
        rare = plan.terms[part, 0]
        window = np.repeat(part, counts[rare])
        place = postings[_runs(starts[rare], counts[rare])]
        begin = place - plan.offsets[window, 0]
        off = np.zeros(len(begin), np.int64)
        for k in range(1, plan.terms.shape[1]):
            term = plan.terms[window, k].astype(np.int64)
            ended = term < 0
            wanted = begin + plan.offsets[window, k]
            right = np.searchsorted(keys, term * room + wanted)
            above, below = np.minimum(right, len(keys) - 1), np.maximum(right - 1, 0)
            far = np.minimum(np.where(right < starts[term + 1], np.abs(postings[above] - wanted), room),
                             np.where(right > starts[term], np.abs(postings[below] - wanted), room))
            far[ended] = 0
            stay = far <= slop
            window, place, begin, off = window[stay], place[stay], begin[stay], np.maximum(off, far)[stay]
            if not len(window):
                break
        yield window, begin, place, off
        at = end


def _search(batches, plan: Plan, n_terms: int, gap: int, slop: int) -> Iterator[pa.RecordBatch]:
    """Segments to one row per document: matched runs of words, items met exactly and nearly."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for row in range(batch.num_rows):
            keys = batch.column("keys")[row].as_py()
            lengths = batch.column("lengths")[row].values.to_numpy().astype(np.int64)
            found = batch.column("terms")[row].values.to_numpy()
            counts = np.zeros(n_terms + 1, np.int64)
            counts[found] = batch.column("counts")[row].values.to_numpy()
            postings = np.frombuffer(batch.column("postings")[row].as_py(), np.int32).astype(np.int64)
            bases = np.concatenate([[0], np.cumsum(lengths + gap)])
            change = np.zeros(bases[-1] + 1, np.int32)
            exact: dict[int, set[str]] = {}
            near: dict[int, set[str]] = {}
            for window, begin, place, off in _places(plan, found, counts, postings, slop, int(bases[-1]) + 2 * gap):
                docs = np.searchsorted(bases, place, "right") - 1
                hit = off == 0
                np.add.at(change, begin[hit], 1)
                np.add.at(change, begin[hit] + plan.sizes[window[hit]], -1)
                for which, into in ((hit, exact), (~hit, near)):
                    for doc, one in np.unique(np.column_stack([docs[which], window[which]]), axis=0).tolist():
                        into.setdefault(doc, set()).update(plan.items(one))
            covered = (np.cumsum(change) > 0).astype(np.int8)
            spans = []
            for doc, size in enumerate(lengths.tolist()):
                if doc not in exact:
                    spans.append([])
                    continue
                edge = np.diff(covered[bases[doc]:bases[doc] + size], prepend=0, append=0)
                spans.append([{"start": int(a), "end": int(b)}
                              for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
            # gap is at least window + slop, so a match never reaches into the next document
            yield pa.record_batch({
                "doc_id": pa.array([k["doc_id"] for k in keys], pa.int64()),
                "key": pa.array([k["key"] for k in keys], pa.string()),
                "n_words": pa.array(lengths),
                "spans": pa.array(spans, spans_type),
                "items": pa.array([sorted(exact.get(d, ())) for d in range(len(keys))], pa.list_(pa.string())),
                "near_items": pa.array([sorted(near.get(d, set()) - exact.get(d, set())) for d in range(len(keys))],
                                       pa.list_(pa.string())),
            })


FOUND = ("doc_id long, key string, n_words long, spans array<struct<start:long,end:long>>, "
         "items array<string>, near_items array<string>")


def _pass(docs: DataFrame, tests: TestSet, window: int, slop: int) -> DataFrame:
    """docs: (key struct<doc_id, key>, text)."""
    context = docs.sparkSession.sparkContext
    gap = window + slop + 1
    terms = context.broadcast(tests.terms)
    index = stage_table(
        docs.select("key", "text").mapInArrow(
            lambda it: _index(it, terms.value, gap),
            "keys array<struct<doc_id:long,key:string>>, lengths array<int>, terms array<int>, "
            "counts array<int>, postings binary"),
        "postings")
    frequency = np.zeros(len(tests.terms) + 1, np.int64)
    # a row for each term of the pass at most
    for term, n in (
        index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p"))
        .groupBy("p.terms").agg(F.sum("p.counts")).collect()
    ):
        frequency[term] = n
    # a plain tuple, which executors can read without this module
    n_terms, plan = len(tests.terms), context.broadcast(tuple(tests.plan(frequency)))
    return index.mapInArrow(lambda it: _search(it, Plan(*plan.value), n_terms, gap, slop), FOUND)


def _lots(items: DataFrame) -> int:
    """Passes over the documents, so that each has about PASS_WORDS words of test items."""

    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words_of(t)) for t in texts], dtype="int64")

    total = items.agg(F.coalesce(F.sum(size("text")), F.lit(0)).alias("n")).first()["n"]
    return max(1, -(-total // PASS_WORDS))


def _lot(items: DataFrame, lot: int, lots: int) -> list[tuple[str, str | None]]:
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), "text")
    part = named.where(F.pmod(F.xxhash64("name", "text"), F.lit(lots)) == lot)
    return [(r["name"], r["text"]) for r in part.collect()]


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Every row of ``docs(doc_id, text)``: doc_id, key, n_words, spans, items, near_items.

    spans: runs [start, end) of words inside exact occurrences; items: ids met
    exactly; near_items: ids met only with words up to ``slop`` places off.
    ``key`` is the text's digest, which with doc_id names the row.
    """
    ship_module(__name__)
    keyed = docs.select(
        F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("key")).alias("key"), "text")
    lots = _lots(items)
    if lots == 1:
        return _pass(keyed, TestSet(_lot(items, 0, 1), window), window, slop)
    # several passes: their matches of a row are put together again
    every = None
    for lot in range(lots):
        part = stage_table(_pass(keyed, TestSet(_lot(items, lot, lots), window), window, slop), "matches")
        every = part if every is None else every.unionAll(part)
    each = every.groupBy("doc_id", "key").agg(
        F.first("n_words").alias("n_words"), (F.count(F.lit(1)) / lots).cast("int").alias("rows"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"))
    return each.select("doc_id", "key", "n_words", "spans", "items",
                       F.array_except("near_items", "items").alias("near_items"),
                       F.explode(F.sequence(F.lit(1), "rows"))).drop("col")


def covered(spans: Column) -> Column:
    """Words inside any of the spans, which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(
        F.array_sort(spans), start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["to"], s["start"]))).alias("n"),
            F.greatest(acc["to"], s["end"]).alias("to")),
        lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row per document with the counts of its hits, and whether it is contaminated."""
    found = matches(docs, items, window, slop).withColumn("n_hit", covered(F.col("spans")))
    return found.select(
        "doc_id", "key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all their columns, that are not contaminated."""
    dirty = contamination(docs, items).where("contaminated").select("doc_id", "key").distinct()
    row, mark = free_name(docs, "dirty_id"), free_name(docs, "dirty_key")
    dirty = stage_table(dirty.withColumnsRenamed({"doc_id": row, "key": mark}), "dirty")
    same = docs["doc_id"].eqNullSafe(dirty[row]) & F.md5(docs["text"]).eqNullSafe(dirty[mark])
    return docs.join(dirty, same, "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("key", "n_near_items")
