"""SentencePiece encoding and decoding with exact N-best segmentation.

A text's lattice has a node at each character and an edge for each piece that
fits. A forward Viterbi pass gives every node the best score of reaching it; a
backward A* search from the end of the text uses these scores as its heuristic.
As they are exact, segmentations leave the agenda in order of their score.

Between two characters that stand side by side in no piece every path has a
node, so the lattice is a chain of independent segments (words, mostly). Viterbi
runs once for each different segment a task meets, with the two best scores at
each node, and tells by how much the segment's second best path falls short. A text's N best
segmentations can only differ from its best one in the N - 1 segments that fall
short least, so A* runs on those.

Spaces are written as U+2581 inside pieces and one is put before the text. A
character without a piece, U+2581 itself among them, becomes its UTF-8 bytes'
pieces, so decoding gives back every text exactly. Equal scores are ordered by
the ids read from the segment's end.

Defined results: a null or empty text has no pieces, score 0 and decodes to an
empty text. Texts are encoded whole, segment by segment.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from hashlib import sha256
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proxima.llm.common import ship_module, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
SPACE = "▁"
#: Segments a task remembers, twice: as many that it met before those.
REMEMBERED = 1 << 17
#: Longer segments are not remembered.
LONG = 128
#: Stands for U+2581 in a text: half a surrogate pair, which no text or piece holds.
APART = "\udc80"
#: Texts are cut in slices of so many characters.
SLICE = 1 << 20
NEVER = float("-inf")


def load_model(path: str = MODEL) -> tuple:
    """(pieces of each id as bytes, {piece: (id, score)}, ids of the 256 bytes, score of a fallback)."""
    held = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, spelled, of_byte = {}, [], [0] * 256
    for i in range(held.vocab_size()):
        piece = held.id_to_piece(i)
        if held.is_byte(i):
            of_byte[int(piece[3:-1], 16)] = i
            spelled.append(bytes([int(piece[3:-1], 16)]))
        elif held.is_control(i) or held.is_unknown(i) or held.is_unused(i):
            spelled.append(b"")
        else:
            plain[piece] = (i, held.get_score(i))
            spelled.append(piece.replace(SPACE, " ").encode())
    # pieces set apart by an extreme score (runs of spaces) don't count as the worst
    fallback = min((s for _, s in plain.values() if s > -1e6), default=0.0) - 10.0
    return spelled, plain, of_byte, fallback


class _Step:
    """A piece of a path that is built from its end, with the piece behind it.

    Paths of one score go by their ids from the end. Two steps are compared by
    jumping back to where their paths part, in logarithmic time.
    """

    __slots__ = ("parent", "jump", "depth", "id", "at", "done")

    def __init__(self, parent: _Step | None, id_: int, at: int, done: float):
        self.parent, self.id, self.at, self.done = parent, id_, at, done
        if parent is None:
            self.depth, self.jump = 0, self
        else:
            self.depth, over = parent.depth + 1, parent.jump
            self.jump = over.jump if parent.depth - over.depth == over.depth - over.jump.depth else parent

    def behind(self, depth: int) -> _Step:
        step = self
        while step.depth > depth:
            step = step.jump if step.jump.depth >= depth else step.parent
        return step

    def __lt__(self, other: _Step) -> bool:
        depth = min(self.depth, other.depth)
        a, b = self.behind(depth), other.behind(depth)
        if a is b:
            return self.depth < other.depth
        while a.parent is not b.parent:
            a, b = (a.parent, b.parent) if a.jump is b.jump else (a.jump, b.jump)
        return a.id < b.id

    def path(self) -> list[tuple[int, int]]:
        """(start, id) of each piece, in order of the text."""
        out, step = [], self
        while step.parent is not None:
            out.append((step.at, step.id))
            step = step.parent
        return out


class Pieces:
    """Encoder and decoder over the values of ``load_model``."""

    def __init__(self, spelled, plain, of_byte, fallback):
        self.spelled, self.of_byte, self.fallback = spelled, of_byte, fallback
        # ends of pieces that are none themselves: a search for pieces that end somewhere goes on past them
        self.pieces: dict[str, tuple] = dict.fromkeys((p[k:] for p in plain for k in range(1, len(p))), ())
        self.pieces.update(plain)
        # characters by number, and which of them may stand side by side within a piece
        chars = sorted({c for p in plain for c in p})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1,) * 2, bool)
        pairs = {p[k:k + 2] for p in plain for k in range(len(p) - 1)}
        if pairs:
            left, right = (self.number[[ord(p[k]) for p in pairs]] for k in (0, 1))
            self.joined[left, right] = True
        # the segments met lately and those met before them
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.listed: dict[tuple[str, int], list] = {}

    def segments(self, text: str) -> list[str]:
        """The text cut wherever no piece can reach across, in the form that pieces have."""
        out, form = [], text.replace(SPACE, APART).replace(" ", SPACE)
        for at in range(0, len(form), SLICE):
            # a slice ends anywhere, so its last segment waits for the next slice
            part = (out.pop() if out else "") + form[at:at + SLICE]
            number = self.number[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
            cuts = (np.flatnonzero(~self.joined[number[:-1], number[1:]]) + 1).tolist()
            out += [part[i:j] for i, j in zip([0, *cuts], [*cuts, len(part)])]
        return out

    def _ids(self, segment: str, path: list[tuple[int, int]]) -> bytes:
        """Ids as 32-bit integers. path: (start, id) from the start on; id -1 stands for a character's bytes."""
        out = array("i")
        for start, i in path:
            if i >= 0:
                out.append(i)
            else:
                char = SPACE if segment[start] == APART else segment[start]
                out.extend(self.of_byte[b] for b in char.encode("utf-8", "replace"))
        return out.tobytes()

    def best(self, segment: str) -> tuple[bytes, float, float]:
        """Ids and score of the best path, and by how much the second best falls short."""
        found = self.known.get(segment) or self.older.get(segment) or self._viterbi(segment)
        if len(segment) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[segment] = found
        return found

    def _viterbi(self, segment: str) -> tuple[bytes, float, float]:
        get, size, fallback = self.pieces.get, len(segment), self.fallback
        first, second = [0.0] * (size + 1), [NEVER] * (size + 1)
        via: list[tuple[int, int]] = [(0, 0)] * (size + 1)
        for end in range(1, size + 1):
            start = at = end - 1
            id_ = -1
            held = get(segment[start:end])
            if held:
                top = next_ = NEVER
            else:
                top, next_ = first[start] + fallback, second[start] + fallback
            while held is not None:
                if held:
                    i, score = held
                    way = first[start] + score
                    if way > top:
                        next_ = second[start] + score
                        if top > next_:
                            next_ = top
                        top, at, id_ = way, start, i
                    else:
                        if way == top and i < id_:
                            at, id_ = start, i
                        if way > next_:
                            next_ = way
                if not start:
                    break
                start -= 1
                held = get(segment[start:end])
            first[end] = top
            second[end] = next_
            via[end] = (at, id_)
        path, end = [], size
        while end:
            path.append(via[end])
            end = via[end][0]
        return self._ids(segment, path[::-1]), first[size], first[size] - second[size]

    def nbest_segment(self, segment: str, n: int) -> list[tuple[float, bytes]]:
        """The n best paths of one segment, by A* from its end."""
        get = self.pieces.get

        def into(end: int) -> list[tuple[int, int, float]]:
            out, start = [], end - 1
            held = get(segment[start:end])
            if not held:
                out.append((start, -1, self.fallback))
            while held is not None and start >= 0:
                if held:
                    out.append((start, *held))
                start -= 1
                held = get(segment[start:end]) if start >= 0 else None
            return out

        # pieces are looked up again where keeping them for each place would take much memory
        kept = [[], *map(into, range(1, len(segment) + 1))] if len(segment) <= LONG else None
        edges = kept.__getitem__ if kept else into
        best = [0.0]
        for end in range(1, len(segment) + 1):
            best.append(max([best[start] + score for start, _, score in edges(end)]))

        def onward(step: _Step) -> list[tuple[float, int, int, float]]:
            """Pieces before a step, best first: (- score of the whole path, id, start, score so far)."""
            done = step.done
            return sorted([(-(done + score + best[start]), i, start, done + score) for start, i, score in edges(step.at)])

        # a step stands for those after it as well, which follow when it leaves the agenda
        agenda = [(-best[-1], _Step(None, 0, len(segment), 0.0), 0)]
        left = array("L", bytes(array("L").itemsize * (len(segment) + 1)))
        out = []
        while agenda and len(out) < n:
            lost, step, rank = heapq.heappop(agenda)
            if step.parent is not None:
                others = onward(step.parent)
                if rank + 1 < len(others):
                    cost, i, start, done = others[rank + 1]
                    heapq.heappush(agenda, (cost, _Step(step.parent, i, start, done), rank + 1))
            if not step.at:
                out.append((-lost, self._ids(segment, step.path())))
                continue
            # what goes on from a place n times already can't be among the n best
            left[step.at] += 1
            if left[step.at] <= n:
                cost, i, start, done = onward(step)[0]
                heapq.heappush(agenda, (cost, _Step(step, i, start, done), 0))
        return out

    def ranked(self, text: str, n: int) -> tuple[list[bytes], list[tuple[float, dict[int, bytes]]]]:
        """Ids of each segment's best path; scores of the n best, and the segments where each differs."""
        segments = self.segments(" " + text)
        each = list(map(self.known.get, segments))
        for k in [k for k, e in enumerate(each) if e is None]:
            each[k] = self.best(segments[k])
        ids, score = list(map(itemgetter(0), each)), sum(map(itemgetter(1), each))
        if n == 1:
            return ids, [(score, {})]
        short = np.fromiter(map(itemgetter(2), each), np.float64, len(each))
        weak = np.flatnonzero(short <= np.partition(short, n - 2)[n - 2]) if len(short) >= n else np.arange(len(short))
        weak = weak[np.lexsort((weak, short[weak]))][:n - 1]
        weak = [int(k) for k in weak if short[k] != float("inf")]
        # ways of choosing among the paths of those segments: (score lost, choice of each)
        ways: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        paths = []
        for k in weak:
            # frequent segments are often the weak ones
            key = (segments[k], n)
            found = self.listed.get(key) or self.nbest_segment(*key)
            if len(key[0]) <= LONG:
                if len(self.listed) >= REMEMBERED >> 4:
                    self.listed.clear()
                self.listed[key] = found
            paths.append(found)
            top = paths[-1][0][0]
            ways = heapq.nsmallest(n, ((lost + top - path[0], chosen + (c,))
                                       for lost, chosen in ways for c, path in enumerate(paths[-1])))
        return ids, [(score - lost, {k: paths[w][c][1] for w, (k, c) in enumerate(zip(weak, chosen)) if c})
                     for lost, chosen in ways]

    def nbest(self, text: str | None, n: int) -> list[tuple[float, array]]:
        """Scores and ids of the n best segmentations of a text, best first."""
        if not text:
            return [(0.0, array("i"))]
        ids, ways = self.ranked(text, n)
        return [(score, array("i", b"".join(other.get(k, x) for k, x in enumerate(ids)) if other else b"".join(ids)))
                for score, other in ways]

    def decode(self, ids) -> str:
        spelled = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return spelled[1:] if spelled.startswith(" ") else spelled


def _shared(spark: SparkSession, path: str):
    """The model's values, read once and broadcast: as large as the vocabulary."""
    return spark.sparkContext.broadcast(load_model(path))


def encode(docs: DataFrame, text: Column, n: int = 1, path: str = MODEL) -> Column:
    """array<struct<score, ids>>: the n best segmentations of each text."""
    ship_module(__name__)
    held = _shared(docs.sparkSession, path)

    @F.arrow_udf("array<struct<score:double,ids:array<int>>>")
    def segment(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Pieces(*held.value)
        for texts in batches:
            scores, ids, ends, counts = [], array("i"), [0], [0]
            for t in texts:
                for score, found in own.nbest(t.as_py(), n):
                    scores.append(score)
                    ids.extend(found)
                    ends.append(len(ids))
                counts.append(len(scores))
            each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
            pairs = pa.StructArray.from_arrays([pa.array(scores, pa.float64()), each], ["score", "ids"])
            yield pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pairs)

    return segment(text)


def decode(frame: DataFrame, ids: Column, path: str = MODEL) -> Column:
    """The text of each list of ids; an empty text for null."""
    ship_module(__name__)
    held = _shared(frame.sparkSession, path)

    @F.pandas_udf("string")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Pieces(*held.value)
        for lists in batches:
            yield pd.Series([own.decode(x.tolist() if x is not None else ()) for x in lists], dtype=object)

    return spell(ids)


def summaries(docs: DataFrame, text: Column, n: int = N_BEST, path: str = MODEL) -> Column:
    """struct of digests: what encoding and decoding each text gave, without the ids themselves."""
    ship_module(__name__)
    held = _shared(docs.sparkSession, path)

    @F.pandas_udf("n_pieces long, n_bytes long, scores array<double>, ids_sha256 string, round_trip boolean")
    def sum_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Pieces(*held.value)
        as_bytes = np.zeros(len(own.spelled), bool)
        as_bytes[own.of_byte] = True
        for texts in batches:
            rows = []
            for t in texts:
                parts, ways = own.ranked(t, n) if t else ([], [(0.0, {})])
                ids = array("i", b"".join(parts))
                rows.append((len(ids), int(np.count_nonzero(as_bytes[np.frombuffer(ids, np.int32)])), [s for s, _ in ways],
                             sha256(ids.tobytes()).hexdigest(), own.decode(ids) == (t or "")))
            yield pd.DataFrame(rows, columns=["n_pieces", "n_bytes", "scores", "ids_sha256", "round_trip"])

    return sum_up(text)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Per document: pieces of the best segmentation, scores of the best few, digest of the ids, round trip."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", summaries(docs, F.col("text")).alias("found")).select("doc_id", "found.*")
