"""Connected components of an edge table, by hooking trees of labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkslab.plans.stage import stage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge; a component is named by its smallest node.

    Edges are undirected; loops, repeated edges and null ends are harmless
    (null ends are left out).  A label is a node of the same component, never
    larger than the node.  Each round takes the label's label of every
    neighbour, gives the least to the node and to the node that names its label
    (so whole trees are hooked, and long chains take logarithmic rounds), and
    goes on until no label changes; then both ends of every edge have one label.
    Every round is staged, so lineage stays short and a lost executor costs one
    round's tasks.  Nothing is gathered.
    """
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    both = given.union(given.select(F.col("v").alias("u"), F.col("u").alias("v")))
    loops = both.select("u", F.col("u").alias("v"))
    links = stage(both.union(loops).distinct(), "cc-links")
    labels = stage(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "cc-labels")
    while True:
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        held = stage(labels.join(jump, "component").select("node", "component", "root"), "cc-held")
        near = links.join(held.select(F.col("node").alias("v"), "root"), "v")
        least = near.groupBy(F.col("u").alias("node")).agg(F.min("root").alias("least"))
        own = held.join(least, "node")
        # a node takes the least for itself, and offers it to the node that names its label
        offers = own.select(F.explode(F.array(F.struct("node", F.col("least").alias("to"), F.col("component").alias("was")), F.struct(F.col("component").alias("node"), F.col("least").alias("to"), F.when(F.lit(False), F.col("component")).alias("was")))).alias("o"))
        labels = stage(offers.groupBy(F.col("o.node").alias("node")).agg(F.min("o.to").alias("component"), F.max("o.was").alias("was")), "cc-labels")
        if labels.where("component <> was").isEmpty():
            break
        labels = labels.select("node", "component")
    return labels.select("node", "component")
