"""Connected components and statistics of clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .similarity import Forest

#: Edges that one task holds at most, about.
HELD = 4_000_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder that the cluster names, or one of our own where it names none."""
    spark: SparkSession = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints/sieveline")
    return df.checkpoint()


def connected(nodes: DataFrame, edges: DataFrame, id_col: str = "id", by: list[str] | None = None, few: bool = False) -> DataFrame:
    """(by, id, cluster) for every node, isolated ones too; the cluster is its least member. edges: (by, a, b). The graphs of
    all values of by are gone through in the same rounds; with few, by trees, as in joined().

    Each round takes the least label of the neighbours and then follows it twice. Isolated nodes take no part.
    """
    if few:
        return joined(nodes, edges, id_col, by)
    by = by or []
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # edges are made once for both
    both = checkpointed(edges.where("a <> b").select(*by, ways.alias("_e")).select(*by, "_e.a", "_e.b").distinct())
    labels = checkpointed(both.groupBy(*by, "a").agg(F.min("b").alias("m")).select(*by, F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, [*by, "node"]).select(*by, "node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(*by, F.col("node").alias("via"), F.col("label").alias("far"))
        labels = checkpointed(step.join(jump, [*by, "via"]).select(*by, "node", "old", F.least("via", "far").alias("label")))
        if labels.where("label <> old").isEmpty():
            break
        labels = labels.select(*by, "node", "label")
    ids = nodes.select(*by, F.col(id_col).cast("long").alias("id"))
    return ids.join(labels.select(*by, F.col("node").alias("id"), "label"), [*by, "id"], "left").select(*by, "id", F.coalesce("label", "id").alias("cluster"))


def joined(nodes: DataFrame, edges: DataFrame, id_col: str = "id", by: list[str] | None = None) -> DataFrame:
    """connected() where edges, such as those of cosine_links(), are few to a node: tasks make trees of HELD edges each and
    give back the edges that joined them, until one task holds what is left. Where that doesn't halve, connected() goes on.
    by: at most one column, of whole numbers, each with a graph of its own."""
    by = by or []

    def trees(batches):
        held = list(batches)
        a, b, g = (np.concatenate([np.zeros(0, np.int64), *(x.column(i).to_numpy() for x in held)]) for i in (0, 1, 2))
        for v in np.unique(g):
            one, other = a[g == v], b[g == v]
            ids, at = np.unique(np.concatenate([one, other]), return_inverse=True)
            forest = Forest()
            forest.room(len(ids))
            yield v, one, other, ids, forest, forest.grow(at[: len(one)], at[len(one) :])

    def fewer(batches):
        for v, a, b, _, _, new in trees(batches):
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(np.full(len(new), v))], names=["a", "b", "g"])

    def labelled(batches):
        for v, _, _, ids, forest, _ in trees(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[forest.root]), pa.array(np.full(len(ids), v))], names=["id", "label", "g"])

    graph = (F.col(by[0]) if by else F.lit(0)).cast("long").alias("g")
    left = checkpointed(edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), graph))
    ids = nodes.select(F.col(id_col).cast("long").alias("id"), graph)
    named = lambda df: df.select(*[F.col("g").cast(nodes.schema[c].dataType).alias(c) for c in by], "id", "cluster")
    n = left.count()
    while n > HELD:
        left = checkpointed(left.repartition(-(-n // HELD)).mapInArrow(fewer, "a long, b long, g long"))
        n, before = left.count(), n
        if n > HELD and 2 * n > before:
            return named(connected(ids, left, by=["g"]))
    labels = left.repartition(1).mapInArrow(labelled, "id long, label long, g long")
    return named(ids.join(labels, ["g", "id"], "left").select("g", "id", F.coalesce("label", "id").alias("cluster")))


def cluster_stats(clusters: DataFrame, by: list[str], cls: str = "y") -> DataFrame:
    """(by, clusters, singletons, in_groups, largest, p99, mixed, in_mixed)."""
    one = clusters.groupBy(*by, "cluster").agg(F.count("*").alias("size"), F.min(cls).alias("lo"), F.max(cls).alias("hi"))
    mixed = F.col("lo") != F.col("hi")
    return one.groupBy(*by).agg(
        F.count("*").alias("clusters"), F.count_if(F.col("size") == 1).alias("singletons"), F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0)).alias("in_groups"),
        F.max("size").alias("largest"), F.percentile(F.col("size").cast("double"), F.lit(0.99)).alias("p99"), F.count_if(mixed).alias("mixed"), F.sum(F.when(mixed, F.col("size")).otherwise(0)).alias("in_mixed"),
    )


def threshold_grid(nodes: DataFrame, pairs: DataFrame, taus: list[float]) -> DataFrame:
    """cluster_stats for each threshold. nodes: (id, y); pairs: (a, b, v)."""
    out = None
    for t in taus:
        c = connected(nodes, pairs.where(F.col("v") >= t)).join(nodes, "id")
        s = cluster_stats(c.withColumn("tau", F.lit(t)), ["tau"])
        out = s if out is None else out.unionByName(s)
    return out
