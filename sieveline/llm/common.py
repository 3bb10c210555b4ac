"""Shared folders, written tables and text expressions of the corpus operators."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here, and of the words cut by it.
BLANKS = " \t\n\v\f\r"
BLANK_RE = r"[\x20\x09-\x0D]+"

REPO = str(Path(__file__).resolve().parents[2])


#: Python workers give the memory of large arrays back to the system, and one task keeps to one core.
WORKERS = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "8388608", "ARROW_DEFAULT_MEMORY_POOL": "system", "OPENBLAS_NUM_THREADS": "1"}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver runs from a checkout, and keep them and Arrow batches small.

    The batch size is a setting of the session: it is set only where the session still has Spark's default."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)
    for k, v in WORKERS.items():
        env.setdefault(k, v)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Where that is unset a session on this machine
    alone, as in tests, takes a folder of its own; on a cluster there is none that all would see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "/tmp/checkpoints/sieveline"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later step reads."""
        for t in tables:
            self.delete(t.scratch_path)

    def delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them that set them apart from all columns of docs."""
    taken = {c.lower() for c in docs.columns}
    tail = ""
    while any((n + tail).lower() in taken for n in names):
        tail += "_"
    return [n + tail for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(s: Column) -> Column:
    """A-Z to lower case and nothing else. Plain ASCII strings take lower(), which is far faster than translate()."""
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(
        F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def words(s: Column) -> Column:
    """The blank-separated words of s, as an array; empty for an empty text."""
    return F.filter(F.split(s, BLANK_RE), lambda w: w != "")
