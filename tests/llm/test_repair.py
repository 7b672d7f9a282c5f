"""Conversation repair against a search over all edits, and across segments."""

import hashlib
import heapq
import itertools
import random
import re

import pytest
from llm_samples import CLASHES
from pyspark.sql import functions as F

from proxima.llm import repair


def cheapest(rows, limit=12):
    """(cost, letters) by a best-first search over whole edit lists; rows: (initial, fault)."""
    heap = [(0, "", 0, "")]
    while True:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        steps = [("I", 3, i, roles + r) for r in "ua"] if audit[-2:] != "II" and len(audit) < limit else []
        if i < len(rows):
            initial, fault = rows[i]
            extra = 3 * (fault == repair.TRUNCATED)
            steps.append(("D", 4, i + 1, roles))
            if fault not in (repair.BLANK, repair.DUPLICATE):
                steps.append(("K", extra, i + 1, roles + (initial or "?")))
                steps += [("R", 3 + extra, i + 1, roles + r) for r in "ua"]
        for letter, more, at, then in steps:
            if re.fullmatch("s?(ua)*u?", then):
                heapq.heappush(heap, (cost + more, audit + letter, at, then))


def test_weights_agree_with_a_search_over_all_edits():
    kinds = [("u", 0), ("a", 0), ("s", 0), ("t", 0), ("u", 1), ("a", 2), ("a", 3), ("s", 3), ("", 0)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert repair.decide(repair.segment_weights(list(rows)), repair.width_of(n)) == cheapest(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_segments_multiply_to_the_whole(size):
    rng = random.Random(size)
    for _ in range(60):
        rows = [(rng.choice("uasuaut"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(2, 40))]
        whole, width = [0 if b == e else None for b in range(4) for e in range(4)], 0
        for at in range(0, len(rows), size):
            part = rows[at:at + size]
            whole, width = repair.product(whole, width, repair.segment_weights(part), repair.width_of(len(part)))
        assert repair.decide(whole, width) == repair.decide(repair.segment_weights(rows), repair.width_of(len(rows)))


def plain(rows):
    """What repair should say of one conversation's (turn, role, text, dropped) rows."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x, gone in rows if not gone]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append(1 if not last else 2 if (role, text) in seen else 3 if last[0] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[1][:1] for r in rows]
    cost, audit = repair.decide(repair.segment_weights(list(zip(initials, faults))), repair.width_of(len(rows)))
    out, at, before = [], 0, ""
    for letter in audit:
        _, role, text = rows[at] if letter != "I" else (None, "", "")
        at += letter != "I"
        if letter == "D":
            continue
        role = role if letter == "K" else "assistant" if before == "u" else "user"
        before = role[:1]
        out.append(f"{role}:{text}")
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in (1, 2, 3)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest()), out


ROWS = [
    (1, 0, "system", "Be kind.", False), (1, 1, "user", "Hi!", False), (1, 3, "assistant", "Hello there", False), (1, 4, "user", "Hi!", False),
    (2, 0, "user", "gone", True), (None, 0, "user", "no id.", False), (None, None, "assistant", "no turn.", False),
    (3, None, None, None, False), (3, 5, "tool", "x", False), (3, 5, "tool", "x", False), (3, 5, "user", " ", False),
    (4, 2, "", "empty role.", False), (4, 1, "user", "", False), (4, 9, "user", "Ünï🙂?", False),
    (5, 0, "assistant", "z" * 200_000 + ".", False), (5, -3, "user", " \t\n\x0b\x0c\r", False),
]


def check(spark, rows, **extra):
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, dropped boolean")
    docs = docs.select("*", *(F.lit("own").alias(c) for c in (*CLASHES, "mark", "audit", "fault", "part", "seq")))
    job = repair.Repair(docs.repartition(5))
    verdicts = {r["conv_id"]: tuple(r)[1:] for r in job.verdicts().collect()}
    digests = {r["conv_id"]: r["repaired_sha256"] for r in job.digests().collect()}
    texts = {}
    for r in job.repaired().orderBy("seq").collect():
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1:])
    assert set(verdicts) == set(by) == set(digests)
    for conv, held in by.items():
        want, out = plain(held)
        assert verdicts[conv] + (digests[conv],) == want
        assert texts.get(conv, []) == out


def test_odd_conversations(spark):
    check(spark, ROWS)


def test_a_conversation_across_segments_and_tasks(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda: rng.choice(["yes.", "no!", "", "why", "so", "ok?", "fine."]) + rng.choice(["", str(rng.randrange(99)) + "."])
    rows = [(7, rng.choice([None, rng.randrange(5000)]), rng.choice(["user", "assistant", "system"]), text(), rng.random() < 0.1) for _ in range(3000)]
    rows += [(k, t, rng.choice(["user", "assistant"]), text(), False) for k in range(8, 60) for t in range(rng.randrange(1, 9))]
    check(spark, rows)


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    job = repair.Repair(repair.damaged(none))
    assert job.verdicts().count() == job.digests().count() == job.repaired().count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three? four", None) for c in range(20) for t in range(5)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, more string")
    got = sorted(((r["conv_id"], r["turn"], r["role"], r["text"]) for r in repair.damaged(docs).where("not dropped").collect()), key=str)
    want = []
    for c, t, role, text, _ in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        want += [(c, t, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    assert got == sorted(want, key=str)
