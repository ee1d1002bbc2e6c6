"""Connected components by contraction, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest reachable node) for every node of
    ``edges`` (``a, b``).

    Every node points to its smallest neighbour if that is smaller; pointers
    are followed to their ends; edges are carried over to these ends and those
    inside one component vanish. A star is done after two rounds, any graph
    after a logarithmic number. Only minima are aggregated, so a node with any
    number of neighbours is reduced before the shuffle; each round is staged.
    """
    left = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "cc-edges")
    labels = None
    while not left.isEmpty():
        seen = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = stage(seen.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "cc-pointers")
        while True:
            ends = pointers.select(F.col("node").alias("to"), F.col("to").alias("end"))
            jumped = stage(pointers.join(ends, "to").select("node", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "cc-jumped")
            pointers = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = pointers.withColumnRenamed("to", "component")
        else:
            follow = pointers.select(F.col("node").alias("component"), "to")
            labels = stage(labels.join(follow, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "cc-labels")
        a = pointers.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = pointers.select(F.col("node").alias("b"), F.col("to").alias("y"))
        carried = left.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = stage(carried.where("a != b").distinct(), "cc-edges")
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("component"))
