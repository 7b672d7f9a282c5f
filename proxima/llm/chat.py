r"""Chat formatting by schema fingerprints.

Records come as prompts with responses, instructions, message lists or single
turns, under various field names. The nested field paths a record holds, as far
as any layout knows them, are sorted and hashed; the hash selects a declarative
mapping, which says where the turns' roles and texts stand. Everything up to the
formatted pieces is DataFrame functions over variant values, row by row.

A turn is written ``<s>role\ntext</s>``. Control strings inside roles and texts,
those of this template and of common others, are escaped with a backslash, as is
the backslash, so a text can neither end its turn nor forge one, and reads back
exactly. The loss mask covers the texts of the assistant.

A conversation's pieces are kept as rows in order, not as one value, so that a
conversation of any length needs no more memory than its longest turn. Digests
are folded over the sorted rows of a partition as they stream by.

Defined results: a null text or role is empty. Turns with equal numbers are
ordered by role, then text, and all kept; a null number comes first. Records with
an unknown fingerprint keep a row with a null layout and no turns. Records
without turns are conversations with no turns. Rows with a null conversation id
form one conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import ship_module, table

OPEN, CLOSE = "<s>", "</s>"
#: Strings that chat templates give a meaning, and their escapes.
ESCAPES = (
    ("\\", "\\e"), (OPEN, "\\a"), (CLOSE, "\\b"), ("[INST]", "\\c"), ("[/INST]", "\\d"),
    ("<<SYS>>", "\\f"), ("<</SYS>>", "\\g"),
)
#: Only in roles, which end with their line.
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))
_PLAIN = {escape[1]: plain for plain, escape in ROLE_ESCAPES}
_ESCAPED = re.compile(r"\\(.)", re.S)
ASSISTANT = "assistant"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping from a record to turns.

    fixed: (role, path) of texts that are turns by themselves, in order; a path
    may be optional, and a text that is absent gives no turn. each: (list, role
    path, text path) of message lists, in order. joined: paths whose texts are
    written together, with an empty line between, as one turn of the first one.
    """

    name: str
    fixed: tuple[tuple[str, str], ...] = ()
    each: tuple[tuple[str, str, str], ...] = ()
    optional: tuple[str, ...] = ()
    joined: tuple[tuple[str, str], ...] = ()
    role_from: str | None = None

    def paths(self) -> set[str]:
        out = {p for _, p in self.fixed} | {p for pair in self.joined for p in pair}
        for held, role, text in self.each:
            out |= {f"{held}[]", f"{held}[].{role}", f"{held}[].{text}"}
        return out | ({self.role_from} if self.role_from else set())

    def variants(self) -> Iterator[frozenset[str]]:
        """The sets of paths a record of this layout can hold; an empty list has no element paths."""
        always = self.paths() - set(self.optional)
        bare = frozenset(p for p in always if "[]." not in p)
        for held in chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1)):
            yield frozenset(always | set(held))
            if self.each:
                yield frozenset(bare | set(held))


LAYOUTS = (
    Layout("turn", fixed=(("", "text"),), role_from="role"),
    Layout("messages", each=(("messages", "role", "content"),), fixed=(("system", "system"),), optional=("system",)),
    Layout("shared", each=(("conversations", "from", "value"),), fixed=(("system", "system"),), optional=("system",)),
    Layout("instruction", fixed=(("system", "system"), ("user", "instruction"), ("assistant", "output")),
           optional=("system", "input"), joined=(("instruction", "input"),)),
    Layout("prompt-response", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("prompt-completion", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("question-answer", fixed=(("system", "system"), ("user", "question"), ("assistant", "answer")), optional=("system",)),
    Layout("message pairs", each=(("prompt", "role", "content"), ("completion", "role", "content"))),
)
#: Names of roles in use, and what they are called here.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint_of(paths) -> str:
    return sha256("\n".join(sorted(paths)).encode()).hexdigest()


def known_paths(layouts=LAYOUTS) -> list[str]:
    return sorted(set().union(*(layout.paths() for layout in layouts)))


def _at(record: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(record, "$." + path, kind)


def _holds(record: Column, path: str) -> Column:
    held, _, field = path.partition("[]")
    value = _at(record, held)
    is_list = F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))
    if field:
        return is_list & _at(record, f"{held}[0]{field}").isNotNull()
    return is_list if path.endswith("[]") else value.isNotNull() & ~is_list


def fingerprint(record: Column, layouts=LAYOUTS) -> Column:
    """Hash of the known nested field paths that a variant record holds."""
    held = F.array_compact(F.array(*(F.when(_holds(record, p), F.lit(p)) for p in known_paths(layouts))))
    return F.sha2(F.concat_ws("\n", F.array_sort(held)), 256)


def _turn_of(names: Column, role: str, said: str):
    def turn(item: Column) -> Column:
        speaker = F.coalesce(_at(item, role, "string"), F.lit(""))
        return F.struct(F.coalesce(names[speaker], speaker).alias("role"),
                        F.coalesce(_at(item, said, "string"), F.lit("")).alias("text"))

    return turn


def _turns(record: Column, layout: Layout) -> Column:
    def text(path: str) -> Column:
        return F.coalesce(_at(record, path, "string"), F.lit(""))

    parts, joined = [], dict(layout.joined)
    for role, path in layout.fixed:
        said = text(path)
        if path in joined:
            more = text(joined[path])
            said = F.when(more != "", F.concat(said, F.lit("\n\n"), more)).otherwise(said)
        speaker = text(layout.role_from) if layout.role_from else F.lit(role)
        turn = F.array(F.struct(speaker.alias("role"), said.alias("text")))
        parts.append(F.when(_at(record, path).isNotNull(), turn).otherwise(F.array().cast(TURNS)))
    for held, role, said in layout.each:
        items = F.coalesce(_at(record, held, "array<variant>"), F.array().cast("array<variant>"))
        names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))

        parts.append(F.transform(items, _turn_of(names, role, said)))
    return F.concat(*parts)


def canonical(records: DataFrame, record: Column, *keep: Column, layouts=LAYOUTS) -> DataFrame:
    """The kept columns with fingerprint, layout and turns of each variant record."""
    # the fingerprint is a column of its own, so that it is computed once
    marked = records.select(*keep, record.alias("record"), fingerprint(record, layouts).alias("fingerprint"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        fits = F.col("fingerprint").isin([fingerprint_of(v) for v in layout.variants()])
        name = F.when(fits, F.lit(layout.name)).otherwise(name)
        turns = F.when(fits, _turns(F.col("record"), layout)).otherwise(turns)
    return marked.select(*(c for c in marked.columns if c != "record"), name.alias("layout"), turns.alias("turns"))


def _escape(text: Column, escapes) -> Column:
    for plain, escape in escapes:
        text = F.replace(text, F.lit(plain), F.lit(escape))
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def format_records(records: DataFrame, conv_id: str, record: Column, turn: Column | None = None) -> DataFrame:
    """One row per turn: conv_id, turn, pos, role, text, layout, piece, mask_start, mask_end.

    ``piece`` is the turn as formatted; the pieces of a conversation by (turn,
    pos, role, text) are its formatted text. The mask is a range of the piece,
    null where no loss is taken.
    """
    number = (turn if turn is not None else F.lit(0)).cast("long")
    shaped = canonical(records, record, F.col(conv_id).alias("conv_id"), number.alias("turn"))
    rows = shaped.select("conv_id", "turn", "layout", F.posexplode_outer("turns").alias("pos", "t"))
    head = F.concat(F.lit(OPEN), _escape(F.col("t.role"), ROLE_ESCAPES), F.lit("\n"))
    said = _escape(F.col("t.text"), ESCAPES)
    masked = F.col("t.role") == ASSISTANT
    return rows.select(
        "conv_id", "turn", "pos", F.col("t.role").alias("role"), F.col("t.text").alias("text"), "layout",
        F.concat(head, said, F.lit(CLOSE)).alias("piece"),
        F.when(masked, F.length(head)).alias("mask_start"), F.when(masked, F.length(head) + F.length(said)).alias("mask_end"),
    )


def read_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (piece.startswith(OPEN) and piece.endswith(CLOSE)):
        raise ValueError(f"not a turn: {piece[:80]!r}")
    role, _, text = piece[len(OPEN):-len(CLOSE)].partition("\n")
    return unescape(role), unescape(text)


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss, self.chars = conv_id, 0, 0, 0
        self.all, self.masked = sha256(), sha256()

    def take(self, piece: str, start: int | None, end: int | None) -> None:
        role, text = read_piece(piece)
        self.turns += 1
        self.chars += len(piece)
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        if start is not None:
            learned = unescape(piece[start:end])
            self.loss += len(learned)
            self.masked.update(learned.encode("utf-8", "replace"))

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation to one row each; one conversation's state is held at a time."""
    names = [field.split()[0] for field in READ.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=names)

    now, rows = None, []
    for batch in batches:
        for conv_id, piece, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "mask_start", "mask_end"))):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    rows.append(now.row())
                now = _Conversation(conv_id)
            if piece is not None:
                now.take(piece, start, end)
        if rows:
            yield out(rows)
            rows = []
    if now is not None:
        yield out([now.row()])


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted pieces."""
    ship_module(__name__)
    return (
        pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "pos", "role", "text")
        .select(F.col("conv_id").cast("long"), "piece", "mask_start", "mask_end").mapInArrow(_read, READ)
    )


def op1_chat(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    record = F.to_variant_object(F.struct("role", "text"))
    return read_back(format_records(rows, "conv_id", record, F.col("turn")))
