"""Conversation structure repair: the cheapest edits that make roles alternate.

Rows of a conversation have faults (blank, duplicate, truncated) and roles in any
order. Repairing keeps (K), reroles (R) or deletes (D) each row and inserts (I)
rows with empty texts, so that role initials read ``(s?(ua)+)?``. Of all cheapest
edits the one whose letters are least in ASCII is taken.

Both wishes are one number. A weight is a big integer: its high digits carry the
cost, and its WIDTH low digits, octal, hold the letters from the left, D < I < K < R
as 1 to 4 and zeros behind the end, so that a shorter list of letters comes before
those that go on. Nodes are (rows left, role before) and a few inserts in between;
putting a letter in front moves the digits by one place. Taking the least integer
at each node decides everything: costs, ties and the letters themselves.

At scale: conversations are range-partitioned by (conversation, turn), so one that
holds a third of all rows lies across many tasks. A task turns at most SEGMENT rows
at a time into a matrix of 4 by 4 weights, from the role before to the role behind.
Between the same two roles letters of equal cost never begin one another (that
takes more inserts, which cost), so matrices multiply: integer sums and minima
again. A conversation is then one row for each segment. What is sequential by
definition, the digest over repaired texts, streams through sorted rows.

Defined results. Nulls in role or text count as one space; a null conversation is
one conversation. Rows stand in order of turn, nulls first; equal turns go by role,
then by the SHA-256 of the text. A role that starts with neither s, u nor a (or is
empty) cannot be kept, and s only in front. Rows that repeat are duplicates of the
first. A conversation without rows has zeros, no letters and the hash of nothing.
An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxima.llm.common import ship_module, stage_table, table

LETTERS = "DIKR"
D, I, K, R = 1, 2, 3, 4
BITS = 3
COST = {D: 4, I: 3, R: 3}
TRUNCATED_COST = 3
#: Roles before a row: none yet, s, u, a. What may follow: s only in front, then u and a in turn.
STATES = 4
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
DROPPED = -1
SEGMENT = 128
SPACE = " \t\n\x0b\x0c\r"

COUNTS = "n_rows long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long"


# ---- weights

def _with(weight: int | None, letter: int, cost: int, width: int) -> int | None:
    """A weight with one letter more in front."""
    if weight is None:
        return None
    digits = BITS * width
    high, low = weight >> digits, weight & ((1 << digits) - 1)
    return (high + cost << digits) + (letter << digits - BITS) + (low >> BITS)


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None or a <= b else b


def width_of(rows: int) -> int:
    """Letters that ``rows`` rows can take: one each, and two inserts before each."""
    return 3 * rows


def segment_weights(rows: list[tuple[str, int]]) -> list[int | None]:
    """Weights of (initial, fault) rows, [before * STATES + behind]."""
    width = width_of(len(rows))
    out: list[int | None] = [None] * (STATES * STATES)
    for behind in range(STATES):
        best: list[int | None] = [None] * STATES
        best[behind] = 0
        for initial, fault in reversed(rows):
            extra = TRUNCATED_COST if fault == TRUNCATED else 0
            here = []
            for before in range(STATES):
                found = _with(best[before], D, COST[D], width)
                if fault not in (BLANK, DUPLICATE):
                    if initial in FOLLOWS[before]:
                        found = _least(found, _with(best[FOLLOWS[before][initial]], K, extra, width))
                    for role, to in FOLLOWS[before].items():
                        if role != "s":
                            found = _least(found, _with(best[to], R, COST[R] + extra, width))
                here.append(found)
            for _ in range(2):
                here = [
                    _least(w, _with(here[FOLLOWS[before]["a" if before == 2 else "u"]], I, COST[I], width))
                    for before, w in enumerate(here)]
            best = here
        for before in range(STATES):
            out[before * STATES + behind] = best[before]
    return out


def joined(a: int, a_width: int, b: int, b_width: int) -> int:
    """The letters of ``b`` right behind those of ``a``."""
    low_a, low_b = a & ((1 << BITS * a_width) - 1), b & ((1 << BITS * b_width) - 1)
    unused = a_width
    if low_a:
        unused = ((low_a & -low_a).bit_length() - 1) // BITS
    cost = (a >> BITS * a_width) + (b >> BITS * b_width)
    return (cost << BITS * (a_width + b_width)) + (low_a << BITS * b_width) + (low_b << BITS * unused)


def product(a: list, a_width: int, b: list, b_width: int) -> tuple[list, int]:
    out = []
    for before in range(STATES):
        for behind in range(STATES):
            best = None
            for mid in range(STATES):
                left, right = a[before * STATES + mid], b[mid * STATES + behind]
                if left is not None and right is not None:
                    best = _least(best, joined(left, a_width, right, b_width))
            out.append(best)
    return out, a_width + b_width


#: Behind the last row: done, or inserts that complete the last pair.
_END = [None] * (STATES * STATES)
for _state, _inserts in ((0, 0), (1, 2), (2, 1), (3, 0)):
    _weight = 0
    for _ in range(_inserts):
        _weight = _with(_weight, I, COST[I], 2)
    _END[_state * STATES] = _weight


def decide(weights: list, width: int) -> tuple[int, str]:
    """Cost and letters of the whole conversation, which starts with no role before it."""
    whole, width = product(weights, width, _END, 2)
    best, digits = whole[0], BITS * width
    letters = format(best & ((1 << digits) - 1), "o").zfill(width).rstrip("0")
    return best >> digits, letters.translate(str.maketrans("1234", LETTERS))


# ---- rows to segments, segments to conversations

def facts(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, mark, initial, fault) of rows(conv_id, turn, role, text, dropped)."""
    seen = Window.partitionBy("conv_id", "role", "mark", "dropped").orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    known = rows.select(
        "conv_id", "turn", "role", "dropped", F.sha2("text", 256).alias("mark"), F.left("role", F.lit(1)).alias("initial"),
        F.right(bare, F.lit(1)).alias("last"))
    fault = (
        F.when(F.col("dropped"), DROPPED).when(F.col("last") == "", BLANK)
        .when(F.row_number().over(seen) > 1, DUPLICATE).when(~F.col("last").isin(".", "!", "?"), TRUNCATED).otherwise(FINE))
    return known.select("conv_id", "turn", "role", "mark", "initial", fault.alias("fault"))


class _Segment:
    def __init__(self, conv_id, part: int, seq: int):
        self.conv_id, self.part, self.seq = conv_id, part, seq
        self.rows: list[tuple[str, int]] = []
        self.turns, self.turn, self.first_turn = 0, None, None

    def take(self, turn, initial: str, fault: int) -> None:
        if fault == DROPPED:
            return
        self.rows.append((initial, fault))
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.first_turn = turn if self.first_turn is None else self.first_turn

    def row(self) -> tuple:
        pairs = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(self.rows, self.rows[1:]))
        n = [sum(f == fault for _, f in self.rows) for fault in (BLANK, DUPLICATE, TRUNCATED)]
        ends = (self.rows[0][0], self.rows[-1][0]) if self.rows else (None, None)
        weights = [None if w is None else w.to_bytes((w.bit_length() + 7) // 8) for w in segment_weights(self.rows)]
        return (self.conv_id, self.part, self.seq, len(self.rows), *n, pairs, self.turns, self.first_turn, self.turn, *ends, weights)


def _schema(conv_type: str) -> str:
    return f"conv_id {conv_type}, part int, seq long, {COUNTS}, first_role string, last_role string, weights array<binary>"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


_LONG = pa.int64()


def _segments(batches) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row for each segment."""
    names = ["conv_id", "part", "seq", *(c.split()[0] for c in COUNTS.split(", ")), "first_role", "last_role", "weights"]
    now, rows, kinds = None, [], None
    for batch in batches:
        kinds = [batch.schema.field("conv_id").type, pa.int32(), *[_LONG] * 9, pa.string(), pa.string(), pa.list_(pa.binary())]
        for conv_id, turn, initial, fault, part in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "part"))):
            if now is None or now.conv_id != conv_id or len(now.rows) == SEGMENT:
                if now is not None:
                    rows.append(now.row())
                now = _Segment(conv_id, part, 0 if now is None or now.conv_id != conv_id else now.seq + 1)
            now.take(turn, initial, fault)
        if rows:
            yield _batch(rows, names, kinds)
            rows = []
    if now is not None:
        yield _batch([now.row()], names, kinds)


VERDICT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    """Segments in order, multiplied like the carries of a binary counter."""

    def __init__(self, conv_id):
        self.conv_id, self.stack = conv_id, []
        self.counts, self.turns = [0, 0, 0, 0], 0
        self.last_role, self.first_turn, self.last_turn = None, None, None

    def take(self, x: dict) -> None:
        if not x["n_rows"]:
            return
        for at, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[at] += x[name]
        if self.last_role is not None:
            self.counts[3] += self.last_role + x["first_role"] not in ("su", "ua", "au")
        self.last_role = x["last_role"]
        if x["first_turn"] is not None:
            self.turns += x["turns"] - (x["first_turn"] == self.last_turn)
            self.first_turn = x["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = x["last_turn"]
        self.stack.append(([None if w is None else int.from_bytes(w) for w in x["weights"]], width_of(x["n_rows"])))
        while len(self.stack) > 1 and self.stack[-1][1] >= self.stack[-2][1]:
            self._join()

    def _join(self) -> None:
        (b, b_width), (a, a_width) = self.stack.pop(), self.stack.pop()
        self.stack.append(product(a, a_width, b, b_width))

    def row(self) -> tuple:
        while len(self.stack) > 1:
            self._join()
        cost, audit = decide(*self.stack[0]) if self.stack else (0, "")
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (self.conv_id, gaps, *self.counts, cost, audit)


def _verdicts(batches) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *(c.split()[0] for c in VERDICT.split(", "))]
    now, rows, kinds = None, [], None
    for batch in batches:
        kinds = [batch.schema.field("conv_id").type, *[_LONG] * 6, pa.string()]
        for x in batch.to_pylist():
            if now is None or now.conv_id != x["conv_id"]:
                if now is not None:
                    rows.append(now.row())
                now = _Conversation(x["conv_id"])
            now.take(x)
        if rows:
            yield _batch(rows, names, kinds)
            rows = []
    if now is not None:
        yield _batch([now.row()], names, kinds)


# ---- applying the letters

class Edits:
    """Applies a conversation's letters to its rows, in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.before = audit, 0, ""

    def _next(self, role: str | None = None) -> str:
        role = ("assistant" if self.before == "u" else "user") if role is None else role
        self.before = role[:1]
        return role

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._next(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            yield self._next(role if letter == "K" else None), text


def _repaired(batches) -> Iterator[pa.RecordBatch]:
    """Verdicts, each before the rows of its conversation, to (conv_id, seq, role, text) of what the edits leave."""
    conv_type = None
    edits, conv_id, seq = None, None, 0
    for batch in batches:
        conv_type, out = batch.schema.field("conv_id").type, []
        for found, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if audit is not None:
                if edits is not None:
                    for line in edits.inserts():
                        out.append((conv_id, seq, *line))
                        seq += 1
                edits, conv_id, seq = Edits(audit), found, 0
                continue
            for line in edits.row(role, text):
                out.append((conv_id, seq, *line))
                seq += 1
        if out:
            yield _batch(out, ["conv_id", "seq", "role", "text"], [conv_type, _LONG, pa.string(), pa.string()])
    out = [(conv_id, seq + k, *line) for k, line in enumerate(edits.inserts())] if edits is not None else []
    if out:
        yield _batch(out, ["conv_id", "seq", "role", "text"], [conv_type, _LONG, pa.string(), pa.string()])


def _digests(batches) -> Iterator[pa.RecordBatch]:
    """Like ``_repaired``, to (conv_id, repaired_sha256): a hash over ``role:text`` joined by newlines."""
    conv_type = None
    edits, conv_id, state, first = None, None, None, True

    def add(lines) -> None:
        nonlocal first
        for role, text in lines:
            state.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "replace"))
            first = False

    out: list[tuple] = []
    for batch in batches:
        conv_type = batch.schema.field("conv_id").type
        for found, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if audit is not None:
                if edits is not None:
                    add(edits.inserts())
                    out.append((conv_id, state.hexdigest()))
                edits, conv_id, state, first = Edits(audit), found, hashlib.sha256(), True
            else:
                add(edits.row(role, text))
        if out:
            yield _batch(out, ["conv_id", "repaired_sha256"], [conv_type, pa.string()])
            out = []
    if edits is not None:
        add(edits.inserts())
        yield _batch([(conv_id, state.hexdigest())], ["conv_id", "repaired_sha256"], [conv_type, pa.string()])


class Repair:
    """Repairs conversations.

    ``rows`` holds conv_id, turn, role and text, and may hold ``dropped``: such a row
    is not there, but its conversation is. ``verdicts()`` has faults, cost and
    letters of each conversation, ``repaired()`` the rows after the edits and
    ``digests()`` a hash of those.
    """

    def __init__(self, rows: DataFrame):
        ship_module(__name__)
        fill = lambda c: F.coalesce(F.col(c), F.lit(" "))
        dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in rows.columns else F.lit(False)
        self.rows = rows.select("conv_id", F.col("turn").cast("long"), fill("role").alias("role"), fill("text").alias("text"),
                                dropped.alias("dropped"))
        self.conv_type = dict(self.rows.dtypes)["conv_id"]
        self._verdicts: DataFrame | None = None

    def verdicts(self) -> DataFrame:
        if self._verdicts is None:
            order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "mark"]
            known = stage_table(facts(self.rows), "facts")
            segments = (
                known.repartitionByRange(*order).sortWithinPartitions(*order, F.col("fault") == DUPLICATE)
                .select("conv_id", "turn", "initial", "fault", F.spark_partition_id().alias("part"))
                .mapInArrow(_segments, _schema(self.conv_type)))
            verdicts = segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(
                _verdicts, f"conv_id {self.conv_type}, {VERDICT}")
            self._verdicts = stage_table(verdicts, "verdicts")
        return self._verdicts

    def _applied(self) -> DataFrame:
        """Each verdict, followed by its conversation's rows in order."""
        none = F.lit(None)
        heads = self.verdicts().select("conv_id", "audit", none.cast("long").alias("turn"), none.cast("string").alias("role"),
                                       none.cast("string").alias("mark"), none.cast("string").alias("text"))
        rows = self.rows.where(~F.col("dropped")).select(
            "conv_id", none.cast("string").alias("audit"), "turn", "role", F.sha2("text", 256).alias("mark"), "text")
        order = ["conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "mark"]
        return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text")

    def repaired(self) -> DataFrame:
        return self._applied().mapInArrow(_repaired, f"conv_id {self.conv_type}, seq long, role string, text string")

    def digests(self) -> DataFrame:
        return self._applied().mapInArrow(_digests, f"conv_id {self.conv_type}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with repeatable faults: dropped, emptied, without full stops, repeated, or said by the user."""
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(fill("conv_id"), F.lit(":"), fill("turn"))) % 20
    text, role = fill("text"), fill("role")
    return conversations.select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (h == 0).alias("dropped"), F.explode(F.when(h == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def op11_repair(spark, sf_dir: str) -> DataFrame:
    repair = Repair(damaged(table(spark, sf_dir, "conversations")))
    same = F.col("v.conv_id").eqNullSafe(F.col("d.conv_id"))
    return repair.verdicts().alias("v").join(repair.digests().alias("d"), same).select("v.*", "d.repaired_sha256")
