"""Classification metrics over predictions (group columns, y, p, ...), by way of confusion cells.

A cell table has the group's columns, y, p and n, the (weighted) number of rows. Every metric but the calibration error
follows from the cells, of which there are k * k to a group however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import log_sum_exp

ECE_BINS = 15


def cells(pred: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Confusion cells that occur."""
    return pred.groupBy(*by, "y", "p").agg(F.sum(weight).alias("n") if weight is not None else F.count("*").alias("n"))


def confusion(pred: DataFrame, by: list[str], k: int) -> DataFrame:
    """All k * k cells of every group, 0 where nothing falls."""
    c = cells(pred, by)
    axis = F.sequence(F.lit(0), F.lit(k - 1))
    full = c.select(*by).distinct().withColumn("y", F.explode(axis)).withColumn("p", F.explode(axis))
    return full.join(c, [*by, "y", "p"], "left").select(*by, "y", "p", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(cell: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, c, tp, support, predicted, recall, f1) for each of the k classes; 0 where a denominator is 0."""
    sides = cell.select(*by, F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")))).alias("s"))
    sums = sides.groupBy(*by, "s.c").agg(*(F.sum(f"s.{x}").alias(x) for x in ("tp", "support", "predicted")))
    full = cell.select(*by).distinct().withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    out = full.join(sums, [*by, "c"], "left").na.fill(0, ["tp", "support", "predicted"])
    return out.select(
        *by, "c", "tp", "support", "predicted",
        F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0)).alias("f1"),
    )


def summary(cell: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, n, accuracy, macro_f1 over all classes, macro_f1_present over classes that occur in y).

    One pass: cells are pivoted into k sums each of support, predictions and hits, so no join by class is needed.
    """
    agg = [F.sum("n").alias("n"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit")]
    for c in range(k):
        agg += [F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias(f"s{c}"), F.sum(F.when(F.col("p") == c, F.col("n")).otherwise(0)).alias(f"q{c}"), F.sum(F.when((F.col("y") == c) & (F.col("p") == c), F.col("n")).otherwise(0)).alias(f"t{c}")]
    wide = cell.groupBy(*by).agg(*agg)
    f1 = [F.coalesce(F.try_divide(2 * F.col(f"t{c}"), F.col(f"s{c}") + F.col(f"q{c}")), F.lit(0.0)) for c in range(k)]
    total, present = sum(f1[1:], f1[0]), sum(((F.col(f"s{c}") > 0).cast("int") for c in range(1, k)), (F.col("s0") > 0).cast("int"))
    seen = sum((F.when(F.col(f"s{c}") > 0, f1[c]).otherwise(0.0) for c in range(1, k)), F.when(F.col("s0") > 0, f1[0]).otherwise(0.0))
    return wide.select(*by, "n", F.try_divide("hit", "n").alias("accuracy"), (total / k).alias("macro_f1"), F.try_divide(seen, present).alias("macro_f1_present"))


def ece_bin(conf: Column, bins: int = ECE_BINS) -> Column:
    """Right-closed bins (i/bins, (i+1)/bins]; a confidence of 0 is in bin 0: the number of inner edges below it."""
    return sum((F.when(conf > F.lit(i / bins), 1).otherwise(0) for i in range(2, bins)), F.when(conf > F.lit(1 / bins), 1).otherwise(0))


def ece(pred: DataFrame, by: list[str], conf: str = "conf", ok: str = "ok", bins: int = ECE_BINS, weight: Column | None = None) -> DataFrame:
    """Expected calibration error: bins' shares times |accuracy - confidence|."""
    w = weight if weight is not None else F.lit(1)
    return ece_of_bins(pred.groupBy(*by, ece_bin(F.col(conf), bins).alias("bin")).agg(F.sum(w).alias("n"), F.sum(F.col(ok) * w).alias("hit"), F.sum(F.col(conf) * w).alias("conf")), by)


def ece_of_bins(b: DataFrame, by: list[str]) -> DataFrame:
    """The error from bins (by, bin, n, hit, conf): rows, right ones and the sum of confidences."""
    return b.groupBy(*by).agg(F.try_divide(F.sum(F.abs(F.col("hit") - F.col("conf"))), F.sum("n")).alias("ece"))


def nll_term(z: Column, y: Column) -> Column:
    return log_sum_exp(z) - F.element_at(z, (y + 1).cast("int"))


def nll(pred: DataFrame, by: list[str]) -> DataFrame:
    return pred.groupBy(*by).agg(F.avg(nll_term(F.col("z"), F.col("y"))).alias("nll"))


def across_seeds(per_seed: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and sample deviation (null for one seed) of per-seed values."""
    return per_seed.groupBy(*by).agg(F.count("*").alias("seeds"), *(x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd"))))
