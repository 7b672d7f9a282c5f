import random
import hashlib
import json
import re

from llm_samples import none, odd, prose  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from proxima.llm import chat, pii

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\e", "\\\\n", "<s>x\ny</s>", "<<SYS>>\n<</SYS>>", "<</s>", "[INST][/INST]<s></s>", "", " \n", "🙂\u0000é"]


def formatted(spark, records, layout_column="record"):
    rows = spark.createDataFrame([(i, json.dumps(r) if not isinstance(r, str) else r) for i, r in enumerate(records)], "id long, record string")
    return chat.format_records(rows, "id", F.try_parse_json(F.col(layout_column)))


def test_every_layout_becomes_the_same_turns(spark):
    turns = [("user", "hi"), ("assistant", "hello")]
    records = [
        {"role": "user", "text": "hi"},
        {"messages": [{"role": r, "content": t} for r, t in turns], "extra": 1},
        {"conversations": [{"from": "human", "value": "hi", "id": 3}, {"from": "gpt", "value": "hello"}]},
        {"instruction": "hi", "output": "hello"}, {"instruction": "hi", "input": "", "output": "hello"},
        {"prompt": "hi", "response": "hello"}, {"prompt": "hi", "completion": "hello"}, {"question": "hi", "answer": "hello"},
        {"prompt": [{"role": "user", "content": "hi"}], "completion": [{"role": "assistant", "content": "hello"}]},
        {"system": "be kind", "prompt": "hi", "response": "hello"},
        {"instruction": "hi", "input": "more", "output": None},
        {"messages": []}, {"what": "ever"}, "not json", {"messages": [{"role": None, "content": "x"}]}, {"a": [1], "prompt": "hi"},
    ]
    got = {}
    for r in formatted(spark, records).orderBy("conv_id", "turn", "pos").collect():
        got.setdefault(r["conv_id"], [r["layout"]]).append((r["role"], r["text"]) if r["pos"] is not None else None)
    names = ["turn", "messages", "shared", "instruction", "instruction", "prompt-response", "prompt-completion", "question-answer", "message pairs"]
    assert [got[i][0] for i in range(9)] == names
    assert got[0][1:] == turns[:1] and all(got[i][1:] == turns for i in range(1, 9))
    assert got[9] == ["prompt-response", ("system", "be kind"), *turns]
    assert got[10] == ["instruction", ("user", "hi\n\nmore"), ("assistant", "")]
    assert got[11] == ["messages", None] and got[12] == got[13] == got[15] == [None, None]
    assert got[14] == ["messages", ("", "x")]


def test_digests_are_read_back(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", x) if i % 2 else ("assistant", x) for i, x in enumerate(NASTY)])]
    rows += [(2, 0, None, None), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (None, 1, "odd\nrole\\", "x"), (3, None, "assistant", "y" * 50000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    record = F.to_variant_object(F.struct("role", "text"))
    pieces = chat.format_records(frame, "conv_id", record, F.col("turn"))
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(pieces).collect()}
    conversations = {}
    for c, turn, role, text in rows:
        conversations.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    length = {r["conv_id"]: r["n"] for r in pieces.groupBy("conv_id").agg(F.sum(F.length("piece")).alias("n")).collect()}
    assert set(got) == set(conversations)
    for c, turns in conversations.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[c] == (len(turns), sha(whole), len(loss), sha(loss), length[c])


def test_pieces_hold_no_foreign_control_strings(spark):
    frame = spark.createDataFrame([(0, t) for t in NASTY], "id long, text string").withColumn("role", F.lit("user"))
    rows = chat.format_records(frame, "id", F.to_variant_object(F.struct("role", "text"))).collect()
    assert {r["text"] for r in rows} == set(NASTY)
    for r in rows:
        assert chat.read_piece(r["piece"]) == ("user", r["text"])
        assert not any(c in r["piece"][3:-4] for c, _ in chat.ESCAPES[1:])


def test_no_conversations(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pieces = chat.format_records(frame, "conv_id", F.to_variant_object(F.struct("role", "text")), F.col("turn"))
    assert chat.read_back(pieces).count() == 0


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def check_digit(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True,
                    13 <= len(digits) <= 19 and check_digit(digits), 9 <= len(digits) <= 15)[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    "mail a.b@c.d_e@f.g.h and x@y, é🙂 me@site.org.", "ip 1.2.3.4.5.6.7.8 and 999.1.2.3.4 or 0255.0.0.1 10.0.0.256",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 5500 0000 0000 0004 12  4012888888881881", "tel +1 (377) 555-0271, +12 3 and +49 30 123456789012345 ++33 1 23 45 67 89",
    "4" * 5000 + " " + "1-" * 3000 + "a" * 9000 + "@b.c", "@@@ + . 1.1.1", None, "", "+1 234 567 890 12.13.14.15@h.io",
    "00000000000000 0.0.0.0",
]


def test_base_spans_are_the_patterns(spark, odd):
    texts = TEXTS + [r["text"] for r in odd.select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in pii.by_document(pii.extract(docs)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        spans = base_spans(text)
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in range(4)], text
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), text
        assert set(listed.split(",")) <= set(got[i]["spans"].split(","))


def test_patterns_find_unseen_identifiers(spark):
    docs = [(i, f"{prose(i, 9)} please call +1 (377) 555-{i:04d} today {prose(i + 99, 9)}") for i in range(12)]
    docs += [(100, "so please call 377-555-9999 today then"), (101, "nothing 377-555-1111 to see"), (102, "I paid 4,000 for 12 of 377 items"),
             (103, "and 377-555-9999 stands elsewhere")]
    found = pii.extract(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in pii.by_document(found).collect()}
    assert rows[100]["spans"] == "phone:15:27" and rows[100]["n_phone"] == 0 and rows[100]["n_found"] == 1
    assert rows[103]["n_found"] == 1
    assert rows[101]["n_found"] == rows[102]["n_found"] == 0
    assert any(r["pattern"] == "l call" for r in found.patterns.collect())


def test_stop_words_are_no_patterns(spark):
    """Telephone numbers behind "the", and dates behind it as well: no date is personal data."""
    docs = [(i, f"{prose(i, 5)} reach the +1 (377) 555-{i:04d} desk {prose(i + 50, 5)}") for i in range(12)]
    docs += [(100 + i, f"{prose(i, 4)} we made the 202401{i % 28 + 1:02d} release {prose(i + 7, 6)}") for i in range(200)]
    found = pii.extract(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in pii.by_document(found).collect()}
    assert all(rows[i]["n_found"] == 0 for i in range(100, 300))
    assert all(rows[i]["n_phone"] == 1 for i in range(12))
    names = {r["pattern"] for r in found.patterns.collect()}
    assert "l the" not in names and "ll reach the" in names


def test_precision_and_recall_on_planted_identifiers(spark):
    """Half of the numbers after "extension" and "ring" are written as no base pattern takes them."""
    rng = random.Random(8)
    docs, planted, others = [], set(), set()
    for i in range(600):
        cue = rng.choice(["extension", "ring"])
        number = f"{rng.randrange(200, 999)}-555-{rng.randrange(10000):04d}"
        kind = i % 4
        if kind == 0:
            text = f"{prose(i, 12)} {cue} +1-{number} now {prose(i + 1, 12)}"
        elif kind == 1:
            text, _ = f"{prose(i, 12)} {cue} {number} now {prose(i + 1, 12)}", planted.add(i)
        else:
            part = rng.choice(["order", "the", "part", "version", "a"])
            text, _ = f"{prose(i, 12)} {part} {number} {rng.choice(['shipped', 'due', 'of'])} {prose(i + 1, 12)}", others.add(i)
        docs.append((i, text))
    got = {r["doc_id"] for r in pii.by_document(pii.extract(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))).collect() if r["n_found"]}
    precision, recall = len(got & planted) / max(1, len(got)), len(got & planted) / len(planted)
    print(f"precision {precision:.3f}, recall {recall:.3f}")
    assert precision >= 0.95 and recall >= 0.95


def test_personal_data_of_odd_tables(odd, none):
    assert pii.by_document(pii.extract(odd)).count() == odd.count()
    assert pii.by_document(pii.extract(none)).count() == 0
