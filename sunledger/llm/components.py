"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of `edges` (a, b): comp is the smallest node it is connected to.

    A round takes the smallest label among a node's neighbours (partial minima before the shuffle)
    and then the label of that label, so paths shorten by halves. Each round is a written table.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.keep(both.distinct(), f"{name}-edges")
    labels = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "node"), f"{name}-0")
    for i in range(1, rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("lower"))
        step = low.join(jump, "low").select("node", "old", F.least("low", "lower").alias("comp"))
        step = scratch.keep(step, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        labels = step.select("node", "comp")
        if step.filter("old <> comp").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
