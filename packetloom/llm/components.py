"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stage


def tied_to_least(edges: DataFrame) -> DataFrame:
    """Edges (a > b) with the components of ``edges``: each node tied to its least neighbour, and its other lesser ones to that.

    Nodes that share their lesser neighbours, as those of one dense group do, make the same
    edges among these, so a group of m nodes leaves m edges and few more, however many it had.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    down = down.withColumn("low", F.min("b").over(Window.partitionBy("a")))
    high = F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b"))
    return down.select(high.alias("a"), F.col("low").alias("b")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``label`` (the least node of its component) for the nodes of ``edges`` (a, b: long).

    Edges are first thinned by :func:`tied_to_least`. In each round a node takes the least label among its neighbours and itself, then
    the label of that label. Rounds end when no label changes. Labels are aggregated
    within tasks before they are shuffled, so a node with very many edges costs one row
    for each task, and each round is a written table. Nothing but two counts reaches the driver.
    """
    thin = stage(tied_to_least(tied_to_least(edges)), "cc-thin")
    both = stage(thin.union(thin.select(F.col("b"), F.col("a"))), "cc-edges")
    # Files of some 200,000 rows: rounds over small tables don't write a file for each shuffle partition.
    files = 1 + both.count() // 200_000
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")).coalesce(files), "cc-labels")
    for _ in range(most_rounds):
        seen = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = labels.join(seen, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # labels of labels: the jump that halves long paths
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = stage(near.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")).coalesce(files), "cc-labels")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
