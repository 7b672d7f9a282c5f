"""Connected components of an edge table, by repeated contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import stage_table


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u long, v long)``.

    Each round, every node points at that node of its closed neighbourhood
    which comes first in a hashed order; edges are then rewritten to the nodes
    pointed at, loops and repeats dropped. The hashed order makes the number of
    edges fall by a constant share each round whatever the graph's shape (a
    long chain too). A star of any size is one pre-aggregated minimum; its
    edges meet their pointers in a plain join, which adaptive execution splits.
    Tables are written each round, so lineage stays short and a lost executor
    costs one round at most. No edges: no rows.
    """
    todo = stage_table(edges.select("u", "v").where("u <> v").distinct(), "edges")
    pointers = []
    while not todo.isEmpty():
        ends = todo.select(F.col("u").alias("node"), F.col("v").alias("near")).unionAll(
            todo.select(F.col("v").alias("node"), F.col("u").alias("near")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        point = stage_table(
            ends.groupBy("node").agg(F.min(order("near")).alias("best"))
            .select("node", F.least(F.col("best"), order("node"))["id"].alias("to")), "pointers")
        pointers.append(point)
        one = point.select(F.col("node").alias("u"), F.col("to").alias("a"))
        two = point.select(F.col("node").alias("v"), F.col("to").alias("b"))
        todo = stage_table(
            todo.join(one, "u").join(two, "v").where("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    if not pointers:
        return todo.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = pointers.pop().select("node", F.col("to").alias("root"))
    while pointers:
        later = roots.select(F.col("node").alias("to"), "root")
        roots = pointers.pop().join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return stage_table(roots, "roots")
