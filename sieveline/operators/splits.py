"""Train / validation / test splits: stratified, by whole clusters, guarded access, leakage checks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS = ("train", "val", "test")
RATIOS = (0.70, 0.15, 0.15)
SEED = 42
#: Clusters that the sequential assignment takes on the driver, over one row a cluster and class; more go through one task.
MOST_CLUSTERS = 1_000_000


def draw(seed: int, x: Column) -> Column:
    return F.md5(F.encode(F.concat_ws("-", F.lit(str(seed)), x.cast("string")), "utf-8"))


def stratified(items: DataFrame, cls: str = "y", id_col: str = "id", seed: int = SEED) -> DataFrame:
    """(id, y, split): of each class seven tenths, rounded, train; half of the rest, rounded up, val."""
    w = Window.partitionBy(cls)
    n, rank = F.count("*").over(w), F.row_number().over(w.orderBy(draw(seed, F.col(id_col)), id_col))
    r = items.withColumn("_n", n).withColumn("_r", rank).withColumn("_t", F.floor((7 * F.col("_n") + 5) / 10))
    split = F.when(F.col("_r") <= F.col("_t"), "train").when(F.col("_r") <= F.col("_t") + F.floor((F.col("_n") - F.col("_t") + 1) / 2), "val").otherwise("test")
    return r.select(id_col, cls, split.alias("split"))


def greedy(size: dict, ratios: tuple[float, ...] = RATIOS) -> Callable[[dict], int]:
    """Told the groups' class counts in order, says where each goes: the split for which the sum over classes and splits of
    (count - ratio * allocated so far)^2 / class size^2 is least; the first of equals. size: items of each class."""
    have = [dict.fromkeys(size, 0.0) for _ in ratios]
    so_far = dict.fromkeys(size, 0.0)

    def place(counts: dict) -> int:
        for c, n in counts.items():
            so_far[c] += n
        best, least = 0, float("inf")
        for s in range(len(ratios)):
            # Only the classes of this group differ between the choices.
            loss = 0.0
            for c, n in counts.items():
                for t, r in enumerate(ratios):
                    loss += ((have[t][c] + (n if t == s else 0)) - r * so_far[c]) ** 2 / size[c] ** 2
            if loss < least:
                best, least = s, loss
        for c, n in counts.items():
            have[best][c] += n
        return best

    return place


def assign(groups: list[tuple], ratios: tuple[float, ...] = RATIOS) -> list[int]:
    """Where greedy() puts the groups, in order."""
    size: dict = {}
    for counts in groups:
        for c, n in counts.items():
            size[c] = size.get(c, 0) + n
    return list(map(greedy(size, ratios), groups))


def by_clusters(clusters: DataFrame, seed: int = SEED, exact: int = MOST_CLUSTERS) -> DataFrame:
    """(id, y, cluster, split) with whole clusters in one split. clusters: (id, y, cluster).

    Clusters go largest first, equal sizes in an order drawn from the seed. The assignment is sequential by nature, over
    one row a cluster and class. Up to `exact` clusters it runs on the driver; beyond that, by the same rule in the same
    order, in one task, which sorts the rows on disk and holds a few of them at a time.
    """
    spark = clusters.sparkSession
    cell = clusters.groupBy("cluster", "y").agg(F.count("*").alias("n"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    told = cell.join(sizes, "cluster").groupBy("cluster", "size").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("y", "n")))).alias("counts"))
    order = [F.desc("size"), draw(seed, F.col("cluster")), F.col("cluster")]
    if sizes.count() <= exact:
        rows = told.orderBy(*order).collect()
        where = assign([r.counts for r in rows])
        named = spark.createDataFrame([(r.cluster, PARTS[s]) for r, s in zip(rows, where)], "cluster long, split string")
    else:
        size = {r.y: r["count"] for r in clusters.groupBy("y").count().collect()}  # one row a class

        def run(batches):
            place = greedy(size)
            for b in batches:
                where = [PARTS[place(dict(zip(y, n)))] for y, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(where, pa.string())], names=["cluster", "split"])

        ordered = told.repartition(1).sortWithinPartitions(*order)
        lists = ordered.select(F.col("cluster").cast("long").alias("cluster"), F.map_keys("counts").alias("ys"), F.map_values("counts").alias("ns"))
        named = lists.mapInArrow(run, "cluster long, split string")
    return clusters.join(named, "cluster", "left").select("id", "y", "cluster", "split")


class TestAccessError(PermissionError):
    """The test part was asked for without allow_test."""


def get_split(splits: DataFrame, variant: str, parts: list[str], allow_test: bool = False) -> DataFrame:
    """Rows of a long table (id, y, variant, split) of one variant and some parts. Unknown parts and variants are errors."""
    unknown = [p for p in parts if p not in PARTS]
    if unknown:
        raise ValueError(f"unknown part: {unknown}")
    if "test" in parts and not allow_test:
        raise TestAccessError("the test part needs allow_test=True")
    if variant != "random":
        kind, _, tau = variant.partition(":")
        if kind != "group":
            raise ValueError(f"unknown variant: {variant}")
        variant = f"group:{float(tau):g}"
    rows = splits.where(F.col("variant") == variant)
    if rows.isEmpty():
        raise KeyError(f"no variant {variant}; there are {sorted(r.variant for r in splits.select('variant').distinct().collect())}")
    return rows.where(F.col("split").isin(parts))


def crosstab(split: DataFrame, cls: str = "y") -> DataFrame:
    """(y, train, val, test, least): counts, 0 where none, and the smaller of val and test."""
    return split.groupBy(cls).pivot("split", list(PARTS)).agg(F.count(F.lit(1))).na.fill(0, list(PARTS)).withColumn("least", F.least("val", "test"))


def crossing(pairs: DataFrame, split: DataFrame, taus: list[float]) -> DataFrame:
    """(tau, pairs, crossing): pairs of v >= tau, and those whose ends are in different splits."""
    s = split.select("id", "split")
    both = pairs.join(s.select(F.col("id").alias("a"), F.col("split").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("split").alias("sb")), "b")
    tagged = both.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus]))).where("v >= tau")
    return tagged.groupBy("tau").agg(F.count("*").alias("pairs"), F.count_if(F.col("sa") != F.col("sb")).alias("crossing"))


def spanning(split: DataFrame) -> DataFrame:
    """One row: how many clusters have members in more than one split."""
    return split.groupBy("cluster").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("spanning"))


def big_share(split: DataFrame, least: int = 10) -> DataFrame:
    """(split, n, share in clusters of `least` members or more, largest cluster)."""
    sizes = split.groupBy("cluster").agg(F.count("*").alias("size"))
    return split.join(sizes, "cluster").groupBy("split").agg(F.count("*").alias("n"), F.avg((F.col("size") >= least).cast("double")).alias("big_share"), F.max("size").alias("largest"))


def verify(pairs: DataFrame, split: DataFrame, tau: float) -> None:
    """Raise if a pair of v >= tau or a cluster crosses splits."""
    n = crossing(pairs, split, [tau]).select(F.sum("crossing").alias("n")).first().n or 0
    m = spanning(split).first().spanning
    if n or m:
        raise AssertionError(f"{n} pairs and {m} clusters cross splits at {tau}")


def neighbour_in_train(items: DataFrame, clusters: DataFrame, split: DataFrame) -> DataFrame:
    """(id, in_train): whether the item's cluster has a member in train."""
    train = clusters.join(split.where("split = 'train'").select("id"), "id", "left_semi").select("cluster", F.lit(True).alias("hit")).distinct()
    return items.select("id").join(clusters.select("id", "cluster"), "id").join(train, "cluster", "left").select("id", F.coalesce("hit", F.lit(False)).alias("in_train"))
