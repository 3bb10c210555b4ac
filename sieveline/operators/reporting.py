"""Loading of runs, comparison of groups of runs, report tables and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The order in which variants, regions and region contrasts are shown.
VARIANT_ORDER = ("random", "group:0.9", "group:0.94", "group:0.98")
REGION_ORDER = ("full", "no_bottom", "no_top", "bottom_strip", "top_strip")
CONTRASTS = (("full", "no_bottom"), ("full", "no_top"), ("no_top", "no_bottom"), ("bottom_strip", "top_strip"))


def run_reason(sha: str, legacy: tuple[str, ...] = ()) -> Column:
    """Why a run (done, region, splits_sha256, variant) is not in the main tables; null if it is."""
    old = (F.col("variant") == "random") & F.col("splits_sha256").isin(list(legacy)) if legacy else F.lit(False)
    return (
        F.when(~F.col("done"), "not finished").when(F.coalesce("region", F.lit("full")) != "full", "region run")
        .when((F.col("splits_sha256") != sha) & ~old, "other splits")
    )


def load_runs(runs: DataFrame, sha: str, legacy: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Kept and skipped runs, the latter with a reason. Two kept runs of one (variant, backbone, seed) are an error."""
    told = runs.withColumn("reason", run_reason(sha, legacy))
    kept = told.where("reason IS NULL").drop("reason")
    twice = kept.groupBy("variant", "backbone", "seed").count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"duplicate runs: {[(r.variant, r.backbone, r.seed) for r in twice]}")
    return kept, told.where("reason IS NOT NULL")


def mismatched_images(pred: DataFrame, by: list[str], run: list[str]) -> DataFrame:
    """(by, id) of images that not every run of a group has once, with the same class."""
    runs = pred.select(*by, *run).distinct().groupBy(*by).agg(F.count("*").alias("runs"))
    seen = pred.groupBy(*by, "id").agg(F.count("*").alias("n"), F.count_distinct(*run).alias("k"), F.count_distinct("y").alias("ys"))
    return seen.join(F.broadcast(runs), by).where("n <> runs OR k <> runs OR ys <> 1").select(*by, "id")


def check_same(pred: DataFrame, by: list[str], run: list[str]) -> None:
    bad = mismatched_images(pred, by, run).limit(3).collect()
    if bad:
        raise ValueError(f"runs differ in their images: {bad}")


def pending(jobs: DataFrame, ledger: DataFrame, event: str, key: str = "run_id") -> DataFrame:
    """Jobs without such an event in the ledger."""
    return jobs.join(ledger.where(F.col("event") == event).select(key).distinct(), key, "left_anti")


def top_confusions(confusion: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """(by, y, p, n, rate): the k largest off-diagonal shares of the true class, those of no rows left out afterwards."""
    support = F.sum("n").over(Window.partitionBy(*by, "y"))
    rate = F.coalesce(F.try_divide("n", "support"), F.lit(0.0))
    off = confusion.withColumn("support", support).withColumn("rate", rate).where("y <> p")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rate"), "y", "p"))
    return off.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("n") > 0)).select(*by, "y", "p", "n", "rate", "rank")


def display_rank(c: Column, order: tuple[str, ...] = VARIANT_ORDER) -> Column:
    """Place in a fixed order; what is unknown comes last."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(c == v, i).otherwise(out)
    return out


def recall_table(per_class: DataFrame, rows: list[str], column: str, values: list) -> DataFrame:
    """Seed means of recall, one column for each value."""
    return per_class.groupBy(*rows, "c").pivot(column, values).agg(F.avg("recall"))


def markdown(table: DataFrame, limit: int = 1000) -> str:
    """A small result as a markdown table; numbers to four places, null as a dash."""
    show = lambda x: "—" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    lines += ["| " + " | ".join(map(show, r)) + " |" for r in table.limit(limit).collect()]
    return "\n".join(lines)


def plus_minus(mean: Column, sd: Column) -> Column:
    return F.when(sd.isNull(), F.format_string("%.4f", mean)).otherwise(F.format_string("%.4f ± %.4f", mean, sd))


def bracket(lo: Column, hi: Column) -> Column:
    return F.format_string("[%.4f, %.4f]", lo, hi)
