"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, payment cards and phone
numbers in whole texts, with code-point offsets. They are the seeds: the words
around a seed are lexical patterns, and the same patterns stand around other
tokens that look like an identifier but that no base pattern takes. Patterns and
the instances they surround form a bipartite graph for each kind. Spark scores
it in rounds: a pattern by the documents in which it surrounds seeds or believed
instances, over all documents that can hold it, an instance by the confident patterns it
stands in. Instances that end up believed are marked wherever they occur.

Limit: an unseen identifier is a single token; of a number written with spaces that no
base pattern takes, nothing or one part is found.

Offsets: ``split`` gives the stretches between matches and ``regexp_extract_all``
the matches, so a running sum of lengths, one window over a document's matches,
places them in linear time. Matching never backs up over what it has taken
(possessive quantifiers), so a run of a million digits is read once.

Defined results: a null or empty text has no spans. Every row of the input gives
one row, repeated ids and null ids too. Spans of one kind don't overlap among
the base ones; found spans never touch a base span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxima.llm.common import stage_table, table

KINDS = ("email", "ip", "card", "phone")
TOKEN = len(KINDS)
#: A run may start where none is under way, or right behind the last match.
BASE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    r"[0-9](?:[ -]?[0-9]){12,}+",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
#: What could be an identifier: white-space separated, with a digit or an at sign.
LOOSE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Characters around a match in which its context words are looked for.
CONTEXT = 48
#: At most; the graph is at rest before that unless beliefs form a long chain.
ROUNDS = 10
#: A pattern counts if it stands around so many different believed instances, and in this share of the documents that
#: can hold it. Numbers that no base pattern takes count against it, so the share asks for about as many seeds as those.
SUPPORT = 3.0
CONFIDENCE = 0.4
BELIEF = 0.4


@dataclass(frozen=True)
class Found:
    """rows: (row_id, doc_id, kind, start, end, base) with kind null for documents without any; patterns: scored."""

    rows: DataFrame
    patterns: DataFrame


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits has a valid check digit."""
    back = F.reverse(digits)
    at = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, at(i)).otherwise(doubled(at(i))))
    return total % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    digits = _digits(hit)
    n = F.length(digits)
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    # the digits are only looked at one by one where there are few
    checked = F.when(n.between(13, 19), luhn(F.when(n.between(13, 19), digits).otherwise(F.lit("0")))).otherwise(False)
    return (
        F.when(kind == 0, F.lit(True)).when(kind == 1, hit.rlike(rf"^(?:{byte}\.){{3}}{byte}$"))
        .when(kind == 2, checked).when(kind == 3, n.between(9, 15)).otherwise(False)
    )


def _matches(text: Column, kind: int, pattern: str) -> Column:
    """Array of (kind, at, gap, hit, before, after), in order; gap: characters since the match before."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # zipped before the lambda, which would cut the text anew for every match
    zipped = F.arrays_zip(hits.alias("hit"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("then"))
    return F.transform(F.filter(zipped, lambda x: x["hit"].isNotNull()), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("at"), F.length(x["gap"]).alias("gap"), x["hit"].alias("hit"),
        F.right(x["gap"], F.lit(CONTEXT)).alias("before"), F.left(x["then"], F.lit(CONTEXT)).alias("after")))


def raw_matches(docs: DataFrame) -> DataFrame:
    """Every match of every pattern, and a row with a null kind for documents without any."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = [*enumerate(BASE), (TOKEN, LOOSE)]
    needs = {0: text.contains("@"), 3: text.contains("+")}
    none = F.array().cast("array<struct<kind:int,at:int,gap:int,hit:string,before:string,after:string>>")
    found = F.concat(*(
        F.when(needs[k], _matches(text, k, p)).otherwise(none) if k in needs else _matches(text, k, p) for k, p in kinds))
    found = F.when(text.rlike("[0-9@]"), found).otherwise(none)
    numbered = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id"), found.alias("found"))
    return numbered.select("row_id", "doc_id", F.explode_outer("found").alias("m")).select("row_id", "doc_id", "m.*")


def _word(c: Column) -> Column:
    """A context word as patterns hold it: lower case, digits alike."""
    return F.regexp_replace(F.lower(c), "[0-9]", "0")


def placed(raw: DataFrame) -> DataFrame:
    """Matches with offsets; tokens without the punctuation around them and clear of base spans."""
    so_far = Window.partitionBy("row_id", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    start = (F.sum(F.col("gap") + F.length("hit")).over(so_far) - F.length("hit")).cast("long")
    is_token = F.col("kind") == TOKEN
    core = F.regexp_replace(F.regexp_replace("hit", r"^[\p{Punct}&&[^+]]++", ""), r"(?<!\p{Punct})\p{Punct}++$", "")
    lead = F.length(F.regexp_extract("hit", r"^[\p{Punct}&&[^+]]*+", 0))
    spans = (
        raw.repartition("row_id").withColumn("start", start)
        .withColumn("base", F.coalesce(_valid(F.col("kind"), F.col("hit")), F.lit(False)))
        .where(F.col("kind").isNull() | is_token | F.col("base"))
        .withColumn("start", F.when(is_token, F.col("start") + lead).otherwise(F.col("start")))
        .withColumn("hit", F.when(is_token, core).otherwise(F.col("hit")))
        .withColumn("end", F.col("start") + F.length("hit"))
    )
    up = Window.partitionBy("row_id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row_id").orderBy(F.desc("start"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    base_end = F.max(F.when(F.col("base"), F.col("end"))).over(up)
    base_start = F.min(F.when(F.col("base"), F.col("start"))).over(down)
    clear = (F.coalesce(base_end, F.lit(0)) <= F.col("start")) & (F.coalesce(base_start, F.col("end")) >= F.col("end"))
    left, right = F.split(F.trim(_word("before")), r"\s+"), F.split(F.trim(_word("after")), r"\s+")
    one, two, next_ = F.get(left, F.size(left) - 1), F.get(left, F.size(left) - 2), F.get(right, F.lit(0))
    contexts = F.array(
        F.concat(F.lit("l "), one), F.concat(F.lit("ll "), two, F.lit(" "), one),
        F.concat(F.lit("lr "), one, F.lit(" _ "), next_), F.concat(F.lit("r "), next_))
    return (
        spans.withColumn("clear", F.col("kind").isNull() | F.col("base") | clear)
        .where(F.col("clear") & (F.col("kind").isNull() | (F.length("hit") > 0)))
        .select("row_id", "doc_id", "kind", "start", "end", "base", F.lower("hit").alias("instance"),
                F.filter(contexts, lambda x: x.isNotNull() & ~x.rlike(r"^(?:l|r) $")).alias("contexts"))
    )


def _looks_like(instance: Column) -> Column:
    """The kinds an unseen token may be."""
    n = F.length(_digits(instance))
    is_ = lambda test, kind: F.when(test, F.lit(kind))
    return F.array_compact(F.array(
        is_(instance.contains("@") & instance.rlike(r"^[^@]+@[^@]+$"), 0),
        is_(instance.rlike(r"^(?:[0-9]{1,3}\.){2,5}[0-9]{1,3}$|^[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){3,7}$"), 1),
        is_(instance.rlike(r"^[0-9]+(?:-[0-9]+)*$") & n.between(12, 19), 2),
        is_(instance.rlike(r"^[+(]?[0-9][0-9().-]*$") & n.between(7, 15), 3)))


def frequencies(docs: DataFrame) -> DataFrame:
    """(word, df): how many documents hold each word, in the form patterns have."""
    words = F.array_distinct(F.split(F.trim(_word(F.coalesce("text", F.lit("")))), r"\s+"))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def _reach(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, pattern, df) of patterns with enough instances; df: documents that hold the rarest of its words.

    No more documents than those can hold the pattern around anything, so what else
    stands in the same context is counted. Words that CONTEXT cut in two are in no document, and
    their patterns go.
    """
    often = edges.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    parts = F.slice(F.split("pattern", " "), F.lit(2), F.size(F.split("pattern", " ")))
    words = often.select("kind", "pattern", F.explode(F.array_distinct(F.filter(parts, lambda w: w != "_"))).alias("word"))
    met = words.join(frequencies(docs), "word", "left").groupBy("kind", "pattern").agg(
        F.min("df").alias("df"), F.max(F.col("df").isNull()).alias("cut"))
    return met.where(~F.col("cut")).drop("cut")


def bootstrap(spans: DataFrame, docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(believed instances, scored patterns) of the ``placed`` spans of ``docs``.

    Edges are the different (kind, pattern, instance) with the number of documents that show
    them. A pattern's confidence is the documents in which it surrounds seeds or
    believed instances, over those that can hold it at all; so a stop word is no pattern,
    however often it precedes a number. It needs SUPPORT different instances, and
    a context that copies repeat is weighed like the copies' words. An instance is believed
    as much as the best pattern it stands in: the contexts of one occurrence are not
    independent. Rounds end when no more instances are believed, at ``rounds`` at the latest.
    """
    of_kind = F.when(F.col("base"), F.array("kind")).otherwise(_looks_like(F.col("instance")))
    edges = stage_table(
        spans.where(F.col("kind").isNotNull())
        .select("row_id", "base", "instance", "contexts", F.explode(of_kind).alias("kind"))
        .select("row_id", "kind", "instance", "base", F.explode("contexts").alias("pattern"))
        .groupBy("kind", "pattern", "instance", "row_id").agg(F.max("base").alias("seed"))
        .groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("docs")), "edges")
    edges = stage_table(edges.join(_reach(edges, docs), ["kind", "pattern"]), "edges")
    believed, patterns, before = None, None, -1
    for _ in range(rounds):
        known = edges if believed is None else edges.join(believed, ["kind", "instance"], "left")
        trust = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("belief", F.lit(0.0)) if believed is not None else F.lit(0.0))
        patterns = stage_table(
            known.groupBy("kind", "pattern").agg(
                F.sum(trust).alias("support"), F.sum(trust * F.col("docs")).alias("held"),
                F.greatest(F.sum("docs"), F.max("df")).alias("n"))
            .withColumn("confidence", F.col("held") / (F.col("n") + 1))
            .where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)), "patterns")
        believed = stage_table(
            edges.where(~F.col("seed")).join(patterns, ["kind", "pattern"])
            .groupBy("kind", "instance").agg(F.max("confidence").alias("belief")).where(F.col("belief") >= BELIEF), "belief")
        now = believed.count()
        if now == before:
            break
        before = now
    return believed.select("kind", "instance"), patterns


def extract(docs: DataFrame, rounds: int = ROUNDS) -> Found:
    """Base and found spans of every document, and the patterns that found them."""
    raw = stage_table(raw_matches(docs), "matches")
    spans = stage_table(placed(raw), "spans")
    believed, patterns = bootstrap(spans, docs, rounds)
    tokens = spans.where(F.col("kind") == TOKEN).drop("kind", "contexts")
    found = tokens.join(believed, "instance").select("row_id", "doc_id", "kind", "start", "end", "base")
    rows = spans.where(F.col("kind").isNull() | F.col("base")).select("row_id", "doc_id", "kind", "start", "end", "base")
    # a row for every document, whatever became of its matches
    every = raw.where(f"kind is null or kind = {TOKEN} and at = 0").select(
        "row_id", "doc_id", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("long").alias("start"),
        F.lit(None).cast("long").alias("end"), F.lit(False).alias("base"))
    return Found(rows.unionByName(found).unionByName(every), patterns)


def by_document(found: Found) -> DataFrame:
    """One row per document: counts and digests of its spans."""
    span = F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "end"))
    name = F.array(*(F.lit(k) for k in KINDS))
    listed = lambda spans: F.concat_ws(",", F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])))
    count = lambda k: F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{KINDS[k]}")
    return found.rows.groupBy("row_id", "doc_id").agg(
        *(count(k) for k in range(len(KINDS))),
        F.sha2(listed(F.collect_list(F.when(F.col("base"), span))), 256).alias("base_sha256"),
        listed(F.collect_list(span)).alias("spans"),
        F.count(F.when(F.col("kind").isNotNull() & ~F.col("base"), 1)).alias("n_found"),
    ).drop("row_id")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return by_document(extract(table(spark, sf_dir, "documents")))
