"""Runs of bright or dark rows in row profiles, kept as arrays: regions, longest runs, bar-like bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BRIGHT, DARK, MIN_RUN_768, MAX_RUN_768, BAR_FRACTION = 225, 30, 20, 60, 0.1875
FRACTIONS = (0.15, 0.1875, 0.20, 0.22, 0.25, 0.30)


def bar_rows(h: Column, fraction: float = BAR_FRACTION) -> Column:
    return F.bround(h * F.lit(fraction)).cast("int")


def min_run(h: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(h * MIN_RUN_768 / 768).cast("int"))


def max_run(h: Column) -> Column:
    return F.greatest(min_run(h), F.bround(h * MAX_RUN_768 / 768).cast("int"))


def tolerance(h: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(h * 4 / 768).cast("int"))


def region_rows(h: Column, region: Column) -> Column:
    """struct(y0, y1) of a named region; the end is not included. An unknown name is an error."""
    bar, zero = bar_rows(h), F.lit(0)
    named = {"full": (zero, h), "bottom_strip": (h - bar, h), "top_strip": (zero, bar), "no_bottom": (zero, h - bar), "no_top": (bar, h)}
    out = None
    for name, (y0, y1) in named.items():
        s = F.struct(y0.cast("int").alias("y0"), y1.cast("int").alias("y1"))
        out = F.when(region == name, s) if out is None else out.when(region == name, s)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown region: "), region)).cast("struct<y0: int, y1: int>"))


def cut(profile: Column, rows: Column) -> Column:
    return F.slice(profile, rows["y0"] + 1, rows["y1"] - rows["y0"])


def bright(profile: Column) -> Column:
    """Rows brighter than the limit; missing rows are not."""
    return F.transform(profile, lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)) > BRIGHT)


def dark(profile: Column) -> Column:
    return F.transform(profile, lambda x: F.coalesce(F.nanvl(x, F.lit(255.0)), F.lit(255.0)) < DARK)


def runs(items: DataFrame, by: list[str], mask: str) -> DataFrame:
    """(by, start, len) of every run of true rows, by gaps and islands."""
    rows = items.select(*by, F.posexplode(mask).alias("pos", "on")).where("on")
    island = rows.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy(*by).orderBy("pos")))
    return island.groupBy(*by, "island").agg(F.min("pos").alias("start"), F.count("*").alias("len")).drop("island")


def longest_run(items: DataFrame, by: list[str], mask: str, none: int = 0) -> DataFrame:
    """(by, start, len) of the longest run, the first of equals; (none, 0) without one."""
    best = runs(items, by, mask).groupBy(*by).agg(F.max(F.struct("len", (-F.col("start")).alias("s"))).alias("b"))
    return items.select(*by).join(best, by, "left").select(*by, F.coalesce(-F.col("b.s"), F.lit(none)).alias("start"), F.coalesce("b.len", F.lit(0)).alias("len"))


def band_rates(bands: DataFrame, by: list[str], h: int) -> DataFrame:
    """Shares of items with a bright, a dark, neither band, and of bright ones that start in the lowest fifth.
    bands: (by, bright_start, bright_len, dark_len)."""
    least = max(1, round(MIN_RUN_768 * h / 768))
    b, d = F.col("bright_len") >= least, F.col("dark_len") >= least
    return bands.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(b.cast("double")).alias("bright"), F.avg(d.cast("double")).alias("dark"), F.avg((~b & ~d).cast("double")).alias("neither"),
        F.avg((b & (F.col("bright_start") >= 0.8 * h)).cast("double")).alias("bright_low"),
    )


def touches_bottom(start: Column, length: Column, h: Column) -> Column:
    return (length >= min_run(h)) & (start + length >= h - tolerance(h))


def crop_check(run_table: DataFrame, items: DataFrame, by: list[str], h: int, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """(by, fraction, n, anywhere, near): items with a bar-like run above the crop line of each fraction, anywhere and
    within the last 12% of the height above it. run_table: (id, start, len) of runs of either colour."""
    lo, hi = max(1, round(MIN_RUN_768 * h / 768)), max(1, round(MIN_RUN_768 * h / 768), round(MAX_RUN_768 * h / 768))
    bar = run_table.where(F.col("len").between(lo, hi))
    lines = F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(h - round(h * f)).alias("line")) for f in fractions])
    tagged = items.select("id", *by, F.explode(lines).alias("x")).select("id", *by, "x.fraction", "x.line")
    hit = bar.join(tagged, "id").where(F.col("start") + F.col("len") <= F.col("line"))
    marks = hit.groupBy("id", "fraction").agg(F.lit(True).alias("any"), F.max(F.col("start") + F.col("len") >= F.col("line") - 0.12 * h).alias("near"))
    full = tagged.join(marks, ["id", "fraction"], "left")
    return full.groupBy(*by, "fraction").agg(F.count("*").alias("n"), F.count_if(F.coalesce("any", F.lit(False))).alias("anywhere"), F.count_if(F.coalesce("near", F.lit(False))).alias("near"))
