"""Tables that stand in for images, logits, profiles and hash codes, derived from the local tables.

Images are the rows of embeddings; their classes are the labels. Logits of backbone b, seed s and class c are
4 * (8 * embedding[30 b + 10 s + c] + bonus * (c = label)); a profile is 128 + 800 * embedding; a perceptual code packs
the first 63 components against their median. Files are documents, whose text is their content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import argmax, confidence, pack_bits, phash_bits

K = 10
HEIGHT = 64
TAUS = (0.35, 0.40, 0.45)
REGIONS = {"full": 3.0, "no_bottom": 2.9, "no_top": 2.95, "bottom_strip": 2.5, "top_strip": 2.4}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("y"), "embedding")


def logits(spark: SparkSession, sf_dir: str, bonus: float = 3.0) -> DataFrame:
    """(backbone, seed, id, y, z): two backbones, three seeds."""
    axis = F.sequence(F.lit(0), F.lit(K - 1))
    e = images(spark, sf_dir).withColumn("backbone", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("seed", F.explode(F.array(*map(F.lit, range(3)))))
    z = F.transform(axis, lambda c: 4.0 * (8.0 * F.get("embedding", 30 * F.col("backbone") + 10 * F.col("seed") + c).cast("double") + F.when(c == F.col("y"), bonus).otherwise(0.0)))
    return e.select("backbone", "seed", "id", "y", z.alias("z"))


def predictions(spark: SparkSession, sf_dir: str, bonus: float = 3.0) -> DataFrame:
    """(backbone, seed, id, pos, y, p, ok, conf, z)."""
    z = logits(spark, sf_dir, bonus)
    p = z.withColumn("p", argmax(F.col("z")))
    return p.select("backbone", "seed", "id", F.col("id").alias("pos"), "y", "p", (F.col("p") == F.col("y")).cast("int").alias("ok"), confidence(F.col("z")).alias("conf"), "z")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, seed, id, y, p): predictions of the first backbone under each region's bonus."""
    out = None
    for name, bonus in REGIONS.items():
        one = predictions(spark, sf_dir, bonus).where("backbone = 0").select(F.lit(name).alias("region"), "seed", "id", "y", "p")
        out = one if out is None else out.unionByName(one)
    return out


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, profile)."""
    return images(spark, sf_dir).select("id", "y", F.transform("embedding", lambda x: 128.0 + 800.0 * x.cast("double")).alias("profile"))


def coefficients() -> Column:
    return F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 63)


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, code): 63 bits and a zero."""
    return images(spark, sf_dir).select("id", "y", pack_bits(phash_bits(coefficients())).alias("code"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, cls, sha, md5, bytes): content as a file would have it; its name is lang/source_id.jpg."""
    d = read(spark, sf_dir, "documents")
    name = F.concat("lang", F.lit("/"), "source", F.lit("_doc"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit(".jpg"))
    content = F.encode("text", "utf-8")
    return d.select(F.col("doc_id").alias("id"), name.alias("name"), F.col("lang").alias("cls"), F.sha2(content, 256).alias("sha"), F.md5(content).alias("md5"), F.octet_length("text").cast("bigint").alias("bytes"))
