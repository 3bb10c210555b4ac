"""Audit of a labelled collection: counts, shares, exact duplicates, keep-first deduplication, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import cache_name


def class_counts(items: DataFrame, cls: str) -> DataFrame:
    """(cls, n, share in percent, imbalance): largest class first; imbalance is the largest count over the smallest."""
    n = items.groupBy(F.col(cls).alias("cls")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.min("n").alias("least"))  # one row
    return n.crossJoin(F.broadcast(total)).select(
        "cls", "n", F.bround(100 * F.col("n") / F.col("all"), 2).alias("share"), F.bround(F.col("most") / F.col("least"), 1).alias("imbalance")
    ).orderBy(F.desc("n"), "cls")


def duplicate_groups(items: DataFrame, key: str, cls: str) -> DataFrame:
    """(key, n, n_classes, classes) of the contents that occur more than once."""
    g = items.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(cls)).alias("c")).where("n > 1")
    return g.select(key, "n", F.size("c").cast("bigint").alias("n_classes"), F.array_join("c", ",").alias("classes"))


def duplicate_totals(groups: DataFrame) -> DataFrame:
    """One row: groups, items in them, extra copies, groups that span classes."""
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"), F.count_if(F.col("n_classes") > 1).alias("cross_class"))


def keep_first(items: DataFrame, key: str, order: str) -> DataFrame:
    """Every item with `kept` (the first by order of its content) and `first`, the order value of the one that is kept.
    The least value is aggregated before the join, so a content with very many copies is no one task's work."""
    first = items.groupBy(key).agg(F.min(order).alias("first"))
    return items.join(first, key).withColumn("kept", F.col(order) == F.col("first"))


def manifest(items: DataFrame, cls: str, name: str, sha: str, width: str, height: str) -> DataFrame:
    """(class, orig_name, orig_sha256, cache_name, note) with the tagged note of kept and dropped rows."""
    k = keep_first(items, sha, name)
    return k.select(
        F.col(cls).alias("class"), F.col(name).alias("orig_name"), F.col(sha).alias("orig_sha256"), F.when(F.col("kept"), cache_name(F.col(name), F.col(sha))).alias("cache_name"),
        F.when(F.col("kept"), F.concat(F.lit("kept;orig_size="), F.col(width).cast("string"), F.lit("x"), F.col(height).cast("string"))).otherwise(F.concat(F.lit("dropped_exact_duplicate_of:"), F.col("first"))).alias("note"),
    )


def collisions(items: DataFrame, key: str) -> DataFrame:
    """One row: how many items share their key with another one."""
    n = items.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("colliding"))


def conditional_mean(items: DataFrame, by: list[str], flag: str, where: str) -> DataFrame:
    return items.groupBy(*by).agg(F.count_if(F.expr(where)).alias("n"), F.avg(F.when(F.expr(where), F.col(flag).cast("double"))).alias("share"))


def size_histogram(items: DataFrame, by: list[str]) -> DataFrame:
    return items.groupBy(*by).agg(F.count("*").alias("n"))


def shards(*axes: DataFrame, index: int, of: int, order: list[str]) -> DataFrame:
    """The cross product of small job axes, of which the index-th of `of` takes every of-th row."""
    jobs = axes[0].coalesce(1)
    for a in axes[1:]:
        jobs = jobs.crossJoin(F.broadcast(a))
    return jobs.withColumn("job", F.row_number().over(Window.orderBy(*order)) - 1).where(F.pmod("job", F.lit(of)) == index)


def ordered_prefix(rows: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """The first rows in that order, the same ones in every run if the order has no ties; all rows without a limit."""
    return rows if limit is None else rows.orderBy(*order).limit(limit)
