"""Corpus-wide line deduplication over levelled sorted runs of line hashes.

A run is a table (a, b, n), bucketed and sorted by (a, b): a 96-bit hash of a line's key and the number of documents that
hold it. Each batch of documents is counted, merge-anti-joined with every run, where those keys go that the run has
decided, and what is left is a new run of level 0. As soon as a level has `fanout` runs, they are merged by full merge
joins into one run of the next level. As the counts of a batch are dealt by (a, b) into as many parts as runs have buckets,
none of these joins moves or sorts a run.

Edge cases: a null or empty text is one empty line, whose key is empty and is never dropped. Rows that repeat a doc_id
count as one document, and so do all rows without one. A document all of whose lines go keeps the empty text. Columns other than doc_id and text are
not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, lower_ascii, prepare, text_or_empty

#: A key is hot if it has over a HOT-th of all counted lines, so that no more than HOT keys can be.
HOT = 4000
#: Documents of a batch.
BATCH = 100_000_000
KEY = ["a", "b"]


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


@contextmanager
def sorted_buckets(spark: SparkSession):
    """Lets scans of bucketed tables tell that they are sorted; each bucket is one file here."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    old = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, old)


class LineRuns:
    """Levelled sorted runs of line hashes in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.scratch, self.made = Scratch(spark, "line-runs"), 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def counts(self, lines: DataFrame) -> DataFrame:
        """(a, b, n) of the lines (doc_id, a, b): how many documents hold the key."""
        docs = F.countDistinct("doc_id") + F.max(F.isnull("doc_id").cast("long"))
        return lines.where("a IS NOT NULL").groupBy(*KEY).agg(docs.alias("n"))

    def undecided(self, counts: DataFrame) -> DataFrame:
        """The counts of keys that no run has decided."""
        for run in self.runs():
            counts = counts.join(run.where(F.col("n") >= self.min_docs).select(*KEY).hint("merge"), KEY, "left_anti")
        return counts

    def add(self, lines: DataFrame) -> None:
        """Add the batch of lines (doc_id, a, b) as a run."""
        self.levels[0].append(self._write(self.undecided(self.counts(lines))))
        for level, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                merged = self._write(self._merged(names))
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
                self.levels[level] = []
                self._drop(names)

    def _merged(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnRenamed("n", "m").hint("merge")
            out = out.join(other, KEY, "full").select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def _write(self, counts: DataFrame) -> str:
        self.made += 1
        name = f"sieveline_line_run_{self.scratch.root.rsplit('-', 1)[-1]}_{self.made}"
        path = f"{self.scratch.root}/run-{self.made}"
        counts.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).format("parquet").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            self.scratch.delete(f"{self.scratch.root}/run-{name.rsplit('_', 1)[-1]}")

    def frequent(self) -> DataFrame:
        """Keys that at least min_docs documents hold. n is what was counted until the key was decided."""
        return self._merged([name for level in self.levels for name in level]).where(F.col("n") >= self.min_docs)

    def close(self) -> None:
        self._drop([name for level in self.levels for name in level])
        self.levels = [[]]


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t, pos, a, b) for every line of every document; t tells rows of the same doc_id apart. a and b are null
    where the key is empty."""
    key = F.col("key")
    out = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("t"), F.posexplode(F.split(text_or_empty(), "\n")).alias("pos", "line"))
    out = out.select("doc_id", "t", "pos", line_key(F.col("line")).alias("key"))
    return out.select("doc_id", "t", "pos", F.when(F.length(key) >= 1, F.xxhash64(key)).alias("a"), F.when(F.length(key) >= 1, F.hash(key)).alias("b"))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, batches: int | None = None, fanout: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) with every line dropped whose key at least min_docs documents hold. Documents come
    in `batches` batches, else in one for every BATCH of them and four at least."""
    spark = docs.sparkSession
    prepare(spark)
    batches = batches or max(4, -(-docs.count() // BATCH))
    runs = LineRuns(spark, min_docs, fanout)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    lines = runs.scratch.write(document_lines(docs).withColumn("batch", batch), "lines", "batch")
    with sorted_buckets(spark):
        for i in range(batches):
            runs.add(lines.where(F.col("batch") == i))
        frequent = runs.scratch.write(runs.frequent(), "frequent")
    runs.close()
    total = lines.where("a IS NOT NULL").count()
    # At most HOT keys by count, however large the corpus is: those are marked by a broadcast, the rest by a merge join.
    hot = frequent.where(F.col("n") * HOT >= total).select(*KEY, F.lit(True).alias("hot"))
    lines = lines.drop("batch").join(F.broadcast(hot), KEY, "left")
    rest = frequent.where(F.col("n") * HOT < total).select(*KEY, F.lit(True).alias("cold"))
    marked = lines.where("hot IS NULL AND a IS NOT NULL").join(rest.hint("merge"), KEY, "left").select("doc_id", "t", "pos", F.col("cold").isNull().alias("keep"))
    sure = lines.where("hot OR a IS NULL").select("doc_id", "t", "pos", F.col("hot").isNull().alias("keep"))
    mask = marked.unionByName(sure).distinct().groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("pos", "keep"))).alias("m"))
    mask = mask.select(F.col("doc_id").alias("id"), F.col("t").alias("u"), F.col("m.keep").alias("mask"))
    whole = docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("t"))
    both = whole.join(mask, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("u")))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: F.get("mask", i)), "\n")
    return both.select(
        "doc_id", F.size("mask").cast("long").alias("n_lines"),
        F.size(F.filter("mask", lambda k: ~k)).cast("long").alias("n_dropped"), kept.alias("kept"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    out = drop_frequent_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
"""
