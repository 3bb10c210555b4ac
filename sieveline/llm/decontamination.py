"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item's set holds the hashes of its distinct runs of k words (of all its words, if fewer). Items are partitioned by
the size n of their sets. An item's sketch is its m smallest hashes; the partition's m is one more than the number of
elements that a document may lack at the wanted containment, so that a document which contains the item has one of its
sketch at least, however long that document is: the search misses nothing. Documents that hold a sketch element are
verified: the share of the item's distinct shingles that the document holds is counted exactly.

Edge cases: an item without an item_id is an item of its own, one for each text, whose pairs have a null item_id. Null,
empty and blank items are contained nowhere; null and empty documents contain nothing. Items of fewer than k words are
looked for as runs of that many words. Texts of any length are read whole. Rows that repeat an item_id, or a doc_id, are taken together as
the union of their sets. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, lower_ascii, prepare, table, text_or_empty, words

#: An index of items is broadcast if it has no more than so many rows (about 24 MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def runs(ws: Column, width: int) -> Column:
    """Hashes of all runs of that many words."""
    one = lambda _, i: F.xxhash64(F.lit(width), *(F.get(ws, i + j) for j in range(width)))
    return F.when(F.size(ws) >= width, F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - (width - 1), F.lit(0))), one))


def item_sets(items: DataFrame, k: int) -> DataFrame:
    """(item_id, own, width, h): the distinct shingles of every item; own tells items without an item_id apart."""
    own = F.when(F.isnull("item_id"), F.xxhash64("text")).otherwise(0).alias("own")
    cut = items.select("item_id", own, words(lower_ascii(text_or_empty())).alias("ws")).where(F.size("ws") > 0)
    width = F.least(F.size("ws"), F.lit(k))
    hashes = F.coalesce(*(F.when(width == w, runs(F.col("ws"), w)) for w in range(1, k + 1)))
    return cut.select("item_id", "own", width.alias("width"), F.explode(hashes).alias("h")).distinct()


def document_runs(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, h) for every run of words of one of the widths."""
    cut = docs.select("doc_id", words(lower_ascii(text_or_empty())).alias("ws"))
    out = None
    for w in widths:
        one = cut.select("doc_id", F.explode(runs(F.col("ws"), w)).alias("h"))
        out = one if out is None else out.unionByName(one)
    return out


def contained(docs: DataFrame, items: DataFrame, k: int = 5, tn: int = 80, td: int = 100) -> DataFrame:
    """(doc_id, item_id, n_item, n_found, containment) of all pairs with n_found / n_item >= tn / td."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "text")
    scratch = Scratch(spark, "decontamination")
    sets = item_sets(items, k)
    allowed = F.floor(F.col("n") * (td - tn) / td)
    # Size and rank within an item: a benchmark item is a short text, so its set is small.
    item = Window.partitionBy("item_id", "own")
    every = sets.withColumns({"n": F.count("*").over(item), "rank": F.row_number().over(item.orderBy("h"))})
    index = scratch.write(every.withColumn("sketch", F.col("rank") <= allowed + 1).drop("rank"), "index")
    widths = sorted(r.width for r in index.select("width").distinct().collect())  # k rows at most
    if not widths:
        widths = [k]
    small = index.count() <= BROADCAST_ROWS
    near = F.broadcast if small else lambda t: t
    hits = document_runs(docs, widths).join(near(index.where("sketch").select("h").distinct()), "h", "left_semi")
    candidates = scratch.write(hits.select("doc_id").distinct(), "candidates")
    few = F.broadcast(candidates) if candidates.count() <= BROADCAST_ROWS else candidates
    again = docs.join(few.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    found = document_runs(again, widths).join(near(index.select("item_id", "own", "n", "h", "sketch")), "h")
    pairs = found.distinct().groupBy("doc_id", "item_id", "own", "n").agg(F.count("*").alias("n_found"), F.max("sketch").alias("sketched"))
    pairs = pairs.where(F.col("sketched") & (F.col("n_found") * td >= F.col("n") * tn))
    return pairs.select("doc_id", "item_id", F.col("n").alias("n_item"), "n_found", F.round(F.col("n_found") / F.col("n"), 6).alias("containment"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4])) AS g
  FROM d WHERE len(ws) >= 5),
bs AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4])) AS g
  FROM b WHERE len(ws) >= 5),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, bs.item_id, n_item, count(*) AS n_found, round(count(*) / n_item, 6) AS containment
FROM ds JOIN bs ON ds.g = bs.g JOIN n ON n.item_id = bs.item_id
GROUP BY doc_id, bs.item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""
