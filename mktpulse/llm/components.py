"""Connected components by contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktpulse.llm.common import lookup_hot, stored


def _lookup(facts: DataFrame, key: str, table: DataFrame, name: str, value: str) -> DataFrame:
    """``facts`` with ``name``: ``value`` of the row of ``table`` (key, value) for ``key``; rows without one keep the key.

    A key may hold any share of the facts: its rows are counted and frequent keys are served by broadcast.
    """
    n = facts.groupBy(key).agg(F.count("*").alias("n"))
    t = stored(table.withColumnRenamed(value, "_value").withColumnRenamed(table.columns[0], key).join(n, key), "lookup")
    total = t.agg(F.sum("n")).first()[0] or 0
    got = lookup_hot(facts, t, key, total)
    return got.select(*facts.columns, F.coalesce(F.col("_value"), F.col(key)).alias(name))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b; bigint): root is one node of its component.

    Each round every node points to its smallest neighbour if that is smaller; pointers are followed to their
    end by pointer jumping; the edges are rewritten to the ends, and loops and repeats drop out. Nodes with many
    edges vanish with the first round. Every round at least halves the nodes that still have edges.
    """
    e = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    while not e.isEmpty():
        # every larger end points to its smallest smaller neighbour; a pointer always leads to a smaller node
        p = stored(e.groupBy("b").agg(F.min("a").alias("a")).select(F.col("b").alias("node"), F.col("a").alias("to")), "pointers")
        while True:
            q = stored(_lookup(p, "to", p, "far", "to").select("node", "to", "far"), "pointers")
            moved = not q.where("`to` <> far").isEmpty()
            p = q.select("node", F.col("far").alias("to"))
            if not moved:
                break
        maps.append(p)
        e = _lookup(_lookup(e, "a", p, "x", "to"), "b", p, "y", "to").where("x <> y")
        e = stored(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not maps:
        return edges.sparkSession.createDataFrame([], "node bigint, root bigint")
    nodes = edges.where("a <> b").select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    for p in maps:
        nodes = stored(_lookup(nodes, "root", p, "end", "to").select("node", F.col("end").alias("root")), "labels")
    return nodes
