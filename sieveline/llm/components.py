"""Connected components of an undirected graph by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: (a, b) of long ids. (node, root) for every id that an edge has; root is the least id of the component.

    Every round takes the least label of all neighbours and then follows labels twice, so rounds grow with the logarithm
    of a component's width. Labels are written to the shared folder after each round.
    """
    both = scratch.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b"), "edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        best = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("next"))
        step = best.join(jump, "mid").select("node", "old", F.least("mid", "next").alias("root"))
        step = scratch.write(step, "labels")
        if step.where("root <> old").isEmpty():
            scratch.drop(both, labels)
            out = step.select("node", "root")
            out.scratch_path = step.scratch_path
            return out
        scratch.drop(labels)
        path, labels = step.scratch_path, step.select("node", "root")
        labels.scratch_path = path
