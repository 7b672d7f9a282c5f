"""Secret scans: base patterns, and strings that pass a battery of randomness tests.

Three base patterns (assignments, access keys, hexadecimal runs) are matched in whole texts.
Beside them every run of letters, digits and ``+/_-`` of MIN_LENGTH characters or more that
touches no base span is a candidate. Its encoding is inferred: the smallest alphabet that
holds all of its characters. Its characters as places in that alphabet are tested for

* uniform use of the alphabet (chi-squared),
* runs above and below the alphabet's middle (Wald-Wolfowitz),
* serial correlation of neighbours (lag one, circular).

A candidate that any test refutes (Bonferroni over the three, level REFUTED) is no secret. For
the others the evidence against ordinary writing counts: words use some letters
often, so the chi-squared statistic of n ordinary characters is non-central, with n times
a rate that is measured over the characters of all documents, for each alphabet. The p-value
is the chance that ordinary writing of that length looks as uniform.

Discoveries are controlled by length: Benjamini-Hochberg at level FALSE_DISCOVERIES
within each class of encoding and length, over the different candidates of all
documents, so a key that a million documents repeat counts once, and many short candidates
don't dilute few long ones. p-values are counted in STEPS a decade, rounded up, which can
only make the control stricter.

At scale: one pass over the texts, whose results (spans and candidates, no texts) are
written to the shared folder; candidates that differ are told apart by a 64-bit hash in one shuffle of
numbers; thresholds are one number for each class, and applying them is a plain
projection. No document meets another.

Defined results. A null or empty text has no spans. Every row gives one row, null and repeated
ids too. Digits alone are no candidates: numbers are as uniform as keys. Found spans touch neither base
spans nor one another. Texts without ASCII letters give no rate; then nothing is found. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import ship_module, stage_table, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGNED = 12
#: Matches are whole runs, so the least length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_LENGTH = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % MIN_LENGTH)

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: name, alphabet in order of value, and whether ordinary letters count whatever their case.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef", True), ("HEX", _DIGITS + "ABCDEF", True), ("base32", _UPPER + "234567", True),
    ("base36", _DIGITS + _LOWER, True), ("BASE36", _DIGITS + _UPPER, True), ("base62", _DIGITS + _UPPER + _LOWER, False),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", False), ("base64url", _UPPER + _LOWER + _DIGITS + "-_", False),
    ("mixed", _UPPER + _LOWER + _DIGITS + "+/-_", False),
)
#: Upper ends of the length classes; the last has none.
LENGTHS = (24, 32, 40, 48, 64, 96, 128)
CLASSES = len(ENCODINGS) * (len(LENGTHS) + 1)
REFUTED = 0.01
FALSE_DISCOVERIES = 0.01
STEPS = 8
#: p-values below 10 to the minus DECADES count as that.
DECADES = 40

_PLACE = []
for _, _alphabet, _ in ENCODINGS:
    _places = np.full(128, -1, np.int64)
    _places[[ord(c) for c in _alphabet]] = np.arange(len(_alphabet))
    _PLACE.append(_places)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order of start and kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of long runs clear of the base spans."""
    found = [m.span() for m in CANDIDATE.finditer(text)]
    if not found or not base:
        return found
    # base spans of different kinds may overlap: as stretches that don't
    stretches: list[list[int]] = []
    for start, _, end in base:
        if stretches and start <= stretches[-1][1]:
            stretches[-1][1] = max(end, stretches[-1][1])
        else:
            stretches.append([start, end])
    ends = [e for _, e in stretches]
    at = np.searchsorted(ends, [s for s, _ in found], "right")
    return [f for f, k in zip(found, at) if k == len(stretches) or stretches[k][0] >= f[1]]


def _tail(z: float) -> float:
    """Chance of a standard normal beyond z."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(places: np.ndarray, size: int) -> tuple[float, tuple[float, float, float]]:
    """Chi-squared statistic, and p-values of uniformity, runs and serial correlation."""
    n = len(places)
    counts = np.bincount(places, minlength=size)
    chi = float((counts * counts).sum()) * size / n - n
    free = size - 1
    # Wilson and Hilferty's normal form
    uniform = _tail(((max(chi, 0.0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    above = places >= size / 2
    high = int(above.sum())
    runs = 1 + int((above[1:] != above[:-1]).sum())
    if high in (0, n):
        alternating = 0.0
    else:
        mean = 1 + 2 * high * (n - high) / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        alternating = 2 * _tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 0.0
    gap = places - places.mean()
    power = float(gap @ gap)
    if power == 0:
        serial = 0.0
    else:
        r = float(gap @ np.roll(gap, -1)) / power
        serial = 2 * _tail(abs(r + 1 / (n - 1)) * math.sqrt(n))
    return chi, (uniform, alternating, serial)


def infer(codes: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The smallest alphabet that holds all characters, and their places in it; none for digits alone."""
    if ((codes >= 48) & (codes <= 57)).all():
        return None
    for at, places in enumerate(_PLACE):
        found = places[codes]
        if (found >= 0).all():
            return at, found
    return None


def length_class(n: int) -> int:
    return int(np.searchsorted(LENGTHS, n))


def measured(text: str, start: int, end: int) -> dict | None:
    word = text[start:end]
    known = infer(np.frombuffer(word.encode("ascii"), np.uint8))
    if known is None:
        return None
    encoding, places = known
    chi, tests = battery(places, len(ENCODINGS[encoding][1]))
    return {"start": start, "end": end, "encoding": encoding, "cls": encoding * (len(LENGTHS) + 1) + length_class(end - start),
            "chi": chi, "random": 3 * min(tests) >= REFUTED, "mark": int(np.uint64(xxhash.xxh64_intdigest(word)).view(np.int64))}


SPAN = "struct<start:long,kind:int,end:long>"
TESTED = "struct<start:long,end:long,encoding:int,cls:int,chi:double,random:boolean,mark:long>"
_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_TESTED = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.int32()), ("cls", pa.int32()), ("chi", pa.float64()),
                     ("random", pa.bool_()), ("mark", pa.int64())])


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def _scan(batches) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, base, tested, base_sha256, seen); seen: ASCII characters, once a batch, on a row without lists."""
    for batch in batches:
        ids, base, tested, digests = batch.column(0), [], [], []
        seen = np.zeros(128, np.int64)
        for text in batch.column(1).to_pylist():
            text = text or ""
            spans = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            digests.append(digest(spans))
            tested.append([x for s, e in candidates(text, spans) if (x := measured(text, s, e)) is not None])
            codes = np.frombuffer(text.encode("ascii", "ignore"), np.uint8)
            for at in range(0, len(codes), 1 << 20):
                seen += np.bincount(codes[at:at + (1 << 20)], minlength=128)
        names = ["doc_id", "base", "tested", "base_sha256", "seen"]
        yield pa.record_batch([
            ids, pa.array(base, pa.list_(_SPAN)), pa.array(tested, pa.list_(_TESTED)), pa.array(digests, pa.string()),
            pa.nulls(len(ids), pa.list_(pa.int64()))], names=names)
        yield pa.record_batch([
            pa.nulls(1, ids.type), pa.nulls(1, pa.list_(_SPAN)), pa.nulls(1, pa.list_(_TESTED)), pa.nulls(1, pa.string()),
            pa.array([seen.tolist()], pa.list_(pa.int64()))], names=names)


def rates(seen: np.ndarray) -> list[float | None]:
    """For each encoding, by how much a character of ordinary writing adds to the chi-squared statistic."""
    out: list[float | None] = []
    for (_, alphabet, folded), places in zip(ENCODINGS, _PLACE):
        of = seen.astype(np.float64)
        if folded:
            upper, lower = of[65:91].copy(), of[97:123].copy()
            of[65:91] = of[97:123] = upper + lower
        held = of[places >= 0]
        share = held / held.sum() if held.sum() else held
        rate = len(alphabet) * float(share @ share) - 1
        out.append(rate if held.sum() and rate > 0 else None)
    return out


def _by_encoding(values: list, encoding: Column) -> Column:
    return F.get(F.array(*(F.lit(v).cast("double") for v in values)), encoding)


def doubt(tested: Column, rate: list[float | None]) -> Column:
    """Evidence against ordinary writing in whole STEPS of a decade of the p-value, rounded down; 0 for what is not random.

    The non-central statistic is taken as normal; the chance beyond z is at most the density
    times 4 / (3 z + sqrt(z z + 8)) (Sampford), which is taken for it. The density over z, a plainer
    bound, is 12 % above that at z = 2.6, where keys of 40 characters lie.
    """
    size = _by_encoding([len(a) for _, a, _ in ENCODINGS], tested["encoding"])
    length = (tested["end"] - tested["start"]).cast("double")
    extra = length * _by_encoding(rate, tested["encoding"])
    z = (size - 1 + extra - tested["chi"]) / F.sqrt(2 * (size - 1 + 2 * extra))
    log10 = (z * z / 2 + F.log((3 * z + F.sqrt(z * z + 8)) * math.sqrt(2 * math.pi) / 4)) / math.log(10)
    steps = F.floor(F.least(log10, F.lit(float(DECADES))) * STEPS).cast("int")
    return F.when(tested["random"] & (z >= 1), F.greatest(steps, F.lit(0))).otherwise(F.lit(0))


def thresholds(counts: list[tuple[int, int, int]]) -> list[int | None]:
    """Benjamini-Hochberg over (class, steps, different candidates): the least steps that count, for each class."""
    out: list[int | None] = [None] * CLASSES
    for cls in {c for c, _, _ in counts}:
        held = sorted(((s, n) for c, s, n in counts if c == cls), reverse=True)
        total, so_far = sum(n for _, n in held), 0
        for steps, n in held:
            so_far += n
            if steps and total * 10 ** (-steps / STEPS) <= FALSE_DISCOVERIES * so_far:
                out[cls] = steps
    return out


class Scan:
    """Spans of ``docs(doc_id, text)``; ``documents()`` has one row for each, ``spans()`` one for each span."""

    def __init__(self, docs: DataFrame):
        ship_module(__name__)
        id_type = dict(docs.dtypes)["doc_id"]
        scanned = stage_table(docs.select("doc_id", "text").mapInArrow(
            _scan, f"doc_id {id_type}, base array<{SPAN}>, tested array<{TESTED}>, base_sha256 string, seen array<long>"), "scanned")
        # 128 sums
        seen = np.zeros(128, np.int64)
        for r in scanned.where("seen is not null").select(F.posexplode("seen").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect():
            seen[r["c"]] = r["n"]
        self.rates = rates(seen)
        self.rows = scanned.where("seen is null").drop("seen")
        one = self.rows.select(F.explode("tested").alias("t")).select(F.col("t.cls").alias("cls"), F.col("t.mark").alias("mark"), doubt(F.col("t"), self.rates).alias("steps"))
        counts = one.distinct().groupBy("cls", "steps").agg(F.count(F.lit(1)).alias("n")).collect()
        self.least = thresholds([(r["cls"], r["steps"], r["n"]) for r in counts])

    def _found(self) -> Column:
        least = F.array(*(F.lit(x).cast("int") for x in self.least))
        passed = F.filter("tested", lambda t: doubt(t, self.rates) >= F.get(least, t["cls"]))
        return F.transform(passed, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))

    def spans(self) -> DataFrame:
        every = F.explode(F.concat("base", self._found())).alias("s")
        return self.rows.select("doc_id", every).select(
            "doc_id", F.get(F.array(*(F.lit(k) for k in KINDS)), F.col("s.kind")).alias("kind"), "s.start", "s.end")

    def documents(self) -> DataFrame:
        kinds = F.array(*(F.lit(k) for k in KINDS))
        count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
        every = F.array_sort(F.concat("base", "found"))
        return self.rows.withColumn("found", self._found()).select(
            "doc_id", *(count(k) for k in range(3)), "base_sha256",
            F.concat_ws(",", F.transform(every, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"]))).alias("spans"),
            F.size("found").cast("long").alias("n_random"))


def op13_secrets(spark, sf_dir: str) -> DataFrame:
    return Scan(table(spark, sf_dir, "documents")).documents()
