"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): the label is the smallest
    node that can be reached. Loops and null ends are ignored.

    Each round maps a node to the first of itself and its neighbours, contracts
    the edges by that map and drops loops. Even rounds order nodes by value, so
    that a star around its smallest node takes one round; odd rounds order them
    by a fresh hash, so that every other shape shrinks by a constant factor
    whatever its numbering. Groupings combine on the map side; a node with very
    many neighbours meets only its own one-row label in a join, which Spark may
    split."""
    left = cut_lineage(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels, turn = None, 0
    while not left.isEmpty():
        rank = (lambda c: c) if turn % 2 == 0 else (lambda c, t=turn: F.xxhash64(F.lit(t), c))
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own = rank(F.col("node")) <= rank(F.col("near"))
        step = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", rank(F.col("b"))).alias("near"))
                           .select("node", F.when(own, F.col("node")).otherwise(F.col("near")).alias("label")), "round")
        if labels is None:
            labels = step
        else:
            deeper = step.select(F.col("node").alias("label"), F.col("label").alias("lower"))
            labels = cut_lineage(labels.join(deeper, "label", "left")
                                 .select("node", F.coalesce("lower", "label").alias("label")), "labels")
        ends = step.select(F.col("node").alias("a"), F.col("label").alias("la")), step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        left = cut_lineage(left.join(ends[0], "a").join(ends[1], "b")
                           .select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct(), "edges")
        turn += 1
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    if turn == 1:  # one round by value: the label is the smallest neighbour, and every node of a component has it
        return labels
    least = labels.groupBy("label").agg(F.min("node").alias("low"))
    return cut_lineage(labels.join(least, "label").select("node", F.col("low").alias("label")), "labels")
