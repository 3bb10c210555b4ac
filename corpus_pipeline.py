"""The corpus pipeline: five stages over the documents, each written and read again before the next.

quality classifier -> n-gram Jaccard join -> benchmark decontamination -> mixing -> sharding

Edge cases: stages decide by row, from its text and, in mixing, its id and cell; rows that share a doc_id, or have none,
have no other effect on each other. Of rows of one doc_id and text, the join keeps one; it also keeps one row of a group
whose rows have no id, while rows that have neither id nor words all stay. The size of a table only chooses how tables are
joined, never what stays. Extra columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import decontamination, mixing, ngram_join, quality, sharding
from sieveline.llm.common import BLANKS, Scratch, prepare, table, text_or_empty, unused

SHARDS = 16
#: Keys of rows are broadcast if there are no more than so many (16 MB), else joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"])


def _by_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a hash of the text for an id, for what a stage decides by the text alone."""
    return docs.select(_text_hash(docs).alias("doc_id"), "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that a row of gone, a written table (_hash) or (_id, _hash), names."""
    names = dict(zip(gone.columns, unused(docs, *gone.columns)))
    gone = gone.withColumnsRenamed(names)
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    same = F.xxhash64("text") == F.col(names["_hash"])
    if "_id" in names:
        same = same & F.col("doc_id").cast("long").eqNullSafe(F.col(names["_id"]))
    return docs.join(gone, same, "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.kept(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that similar ones link (five words, 0.8), the one of the smallest id stays."""
    scratch = Scratch(spark, "pipeline-jaccard")
    named = ngram_join.near_duplicates(_by_text(docs), 5, 80, 100, count=False).where("n_shingles > 0")
    named = named.select(F.col("doc_id").alias("_hash"), F.col("component_id").alias("_group")).distinct()
    ids = docs.select(docs["doc_id"].cast("long").alias("_id"), _text_hash(docs).alias("_hash"))
    rows = scratch.write(ids.join(named, "_hash", "left"), "groups")
    first = rows.where("_group IS NOT NULL").groupBy("_group").agg(F.min(F.struct(F.isnull("_id").alias("none"), "_id", "_hash")).alias("_first"))
    others = rows.join(first, "_group").where("NOT (_id <=> _first._id AND _hash = _first._hash)")
    gone = scratch.write(others.select("_id", "_hash").distinct(), "dropped")
    out = _without(docs, gone)
    if rows.where("_id IS NOT NULL OR _group IS NOT NULL").groupBy("_id", "_hash").count().where("count > 1").isEmpty():
        return out
    blank = F.col("doc_id").isNull() & (F.btrim(text_or_empty(), F.lit(BLANKS)) == "")
    (name,) = unused(docs, "_hash")
    once = out.where(~blank).withColumn(name, F.xxhash64("text")).dropDuplicates(["doc_id", name]).drop(name)
    return once.unionByName(out.where(blank))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark (five words, 0.8) go."""
    scratch = Scratch(spark, "pipeline-decontamination")
    hits = decontamination.contained(_by_text(docs), table(spark, sf_dir, "benchmark"), 5, 80, 100)
    gone = scratch.write(hits.select(F.col("doc_id").alias("_hash")).distinct(), "hits")
    return _without(docs, gone)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn so that the token weights of sources, languages and topics meet their targets."""
    return mixing.drawn(docs)


def minimax_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the place in it of every document that is left."""
    return sharding.shard(docs, SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
    ("sharding", minimax_sharding),
]

#: Expectation-maximisation, a trained scorer and raking have no SQL form: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
