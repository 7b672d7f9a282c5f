"""Line dedup by site-relative frequency.

For every host, the pages that contain a line are divided by the pages of the
host; lines beyond the ratio are boilerplate and are dropped wherever the host
shows them. A line counts once per page and is compared without the white space
around it; blank lines are neither counted nor dropped.

Counting shuffles (host, 16-byte digest) pairs that each task has summed before,
so a line or a host with a third of all rows costs one row per task. A page
holds few lines, so at most (lines per page) / ratio lines of a host can pass the
ratio: that list is short for any input. It is written as one row per host and
joined to the pages, which are not shuffled as long as Spark finds the list small
enough to broadcast; beyond that it is a sort-merge join whose hot hosts adaptive
execution splits.

Defined results: a null text stays null, an empty one empty. A null host is a
host of its own. A page whose every line goes keeps an empty text. Repeated
pages are pages like any other. Hosts with under ``MIN_PAGES`` pages, and lines
on fewer than that, are left alone: a ratio of so few tells nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import free_name, stage_table, table

RATIO = 0.1
MIN_PAGES = 5


def host_of(url: Column) -> Column:
    """Lower-cased host of an address, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def digest(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, n_pages, lines array<binary>): the digests of each host's boilerplate lines."""
    filled = F.filter(lines_of(text), lambda x: F.trim(x) != "")
    marks = F.array_distinct(F.transform(filled, digest))
    # the page itself is counted under a mark that no line has
    rows = pages.select(host.alias("host"), F.explode(F.array_append(F.coalesce(marks, F.array().cast("array<binary>")), F.lit(bytearray()))).alias("line"))
    counts = rows.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    # only lines on enough pages can be boilerplate; the rest need not meet their host
    counts = stage_table(counts.where(F.col("n") >= min_pages), "line-counts")
    totals = counts.where(F.length("line") == 0).select(F.col("host").alias("site"), F.col("n").alias("n_pages"))
    often = counts.where(F.length("line") > 0)
    same = F.col("host").eqNullSafe(F.col("site")) & (F.col("n") > F.col("n_pages") * F.lit(ratio))
    found = often.join(totals, same).select("host", "n_pages", "line")
    return stage_table(found.groupBy("host", "n_pages").agg(F.collect_list("line").alias("lines")), "boilerplate")


def drop_boilerplate(
    pages: DataFrame, host: Column, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``pages``, all columns, with the boilerplate lines gone from column ``text``."""
    names = [free_name(pages, n) for n in ("boilerplate_host", "boilerplate_lines")]
    known = boilerplate(pages, host, pages[text], ratio, min_pages).select(
        F.col("host").alias(names[0]), F.col("lines").alias(names[1]))
    kept = F.filter(lines_of(pages[text]), lambda x: ~F.array_contains(known[names[1]], digest(x)))
    clean = F.when(known[names[1]].isNull(), pages[text]).otherwise(F.array_join(kept, "\n"))
    return pages.join(known, host.eqNullSafe(known[names[0]]), "left").select(
        *(clean.alias(c) if c == text else pages[c] for c in pages.columns))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Pages with the boilerplate lines of their host dropped; tags end lines."""
    pages = table(spark, sf_dir, "pages")
    text = F.trim(F.regexp_replace(F.regexp_replace("html", r"<[^>]*>", "\n"), r"\n\s*", "\n"))
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), text.alias("text"))
    clean = drop_boilerplate(pages.withColumn("kept", F.col("text")), F.col("host"), "kept")
    count = lambda c: F.coalesce(F.size(lines_of(F.col(c))), F.lit(0)).cast("long")
    return clean.select(
        "page_id", "host", count("text").alias("n_lines"),
        (count("text") - F.when(F.col("kept") == "", F.lit(0)).otherwise(count("kept"))).cast("long").alias("n_dropped"),
        F.sha2("kept", 256).alias("kept_sha256"), "kept",
    )
