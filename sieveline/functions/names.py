"""Column functions over names, variants and runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_class(name: Column) -> Column:
    return F.split(name, "/", 2)[0]


def basename(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def name_code(name: Column) -> Column:
    """What stands before the first underscore of the file's name."""
    return F.split(basename(name), "_", 2)[0]


def name_stem(name: Column) -> Column:
    """What stands behind the first underscore, without the last extension."""
    return F.regexp_replace(F.element_at(F.split(basename(name), "_", 2), -1), r"\.[^.]*$", "")


def cache_name(name: Column, sha: Column) -> Column:
    return F.concat(name_class(name), F.lit("/"), name_stem(name), F.lit("__"), F.substring(sha, 1, 8), F.lit(".jpg"))


def canonical_variant(variant: Column) -> Column:
    """random, or group:<threshold> without needless digits; anything else is an error."""
    tau = F.regexp_extract(variant, r"^group:([0-9]*\.?[0-9]+)$", 1)
    return F.when(variant == "random", variant).when(tau != "", F.concat(F.lit("group:"), tau.try_cast("double").cast("string"))).otherwise(F.raise_error(F.concat(F.lit("unknown variant: "), variant)).cast("string"))


def run_name(variant: Column, backbone: Column, seed: Column, region: Column) -> Column:
    tail = F.when(region == "full", F.lit("")).otherwise(F.concat(F.lit("__"), region))
    return F.concat(F.replace(variant, F.lit(":"), F.lit("")), F.lit("__"), backbone, F.lit("__s"), seed.cast("string"), tail)
