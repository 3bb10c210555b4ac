"""Checks of tables: uniqueness, equal sets, missing rows, vectors, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: list[str]) -> None:
    bad = repeated(df, key).limit(3).collect()
    if bad:
        raise ValueError(f"repeated {key}: {[tuple(r)[:-1] for r in bad]}")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of what only one of two tables has."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def resolve(wanted: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """wanted with the index's columns; an error that names a few if some are missing."""
    missing = wanted.join(index, key, "left_anti").select(key)
    n = missing.count()
    if n:
        raise FileNotFoundError(f"{n} missing, such as {[r[0] for r in missing.limit(3).collect()]}")
    return wanted.join(index, key)


def sound_vector(v: Column, size: int) -> Column:
    """Of the right size and finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == size) & fine, F.lit(False))


def upload_problem(content: Column, most: int = 10 * 1024 * 1024) -> Column:
    """Why an upload is refused by its bytes, or null: size, and the magic bytes of PNG and JPEG."""
    head = F.hex(F.substring(content, 1, 8))
    known = head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF")
    return F.when(content.isNull() | (F.octet_length(content) == 0), "empty").when(F.octet_length(content) > most, "too large").when(~known, "not PNG or JPEG")


def side_problem(width: Column, height: Column, least: int = 32, most: int = 4096) -> Column:
    return F.when(F.least(width, height) < least, "too small").when(F.greatest(width, height) > most, "too large")


def within(value: Column, percent: float = 1.0) -> Column:
    return F.when(value <= percent, "PASS").otherwise("FAIL")
