"""Connected components as rounds of hooking and contraction over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.operators.stage import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a, b); a component is its smallest node.

    In a round every node hooks onto its smallest neighbour, pointers are jumped once, and the
    edges are rewritten between what is left, so stars vanish at once and paths shrink by a
    factor. Each round's tables are written, which cuts the lineage and survives lost
    executors; the driver sees one number a round. Edges with a null end are ignored.
    """
    edges = edges.where("a is not null and b is not null")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    rest = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("p"))
        hook = written(hook, "hooks")
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jump = written(hook.join(up, "p").select("u", F.col("pp").alias("p")), "jumps")
        ends = lambda c: jump.select(F.col("u").alias(c), F.col("p").alias(f"p{c}"))
        moved = rest.join(ends("a"), "a").join(ends("b"), "b").where("pa <> pb")
        labels = written(
            labels.join(jump.withColumnRenamed("u", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels"
        )
        rest = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return labels
