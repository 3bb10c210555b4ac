"""Readers and writers of manifests, split documents, runs and checksums; schemas are given, but for
feature files and the reports of archives, which bring their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "class string, orig_name string, orig_sha256 string, cache_name string, note string"
SPLITS = (
    "meta struct<seed: int, n: long, taus: array<double>>, files array<string>, class array<string>, random array<string>, "
    "group map<string, struct<cluster: array<long>, split: array<string>>>"
)
RUN = "run_id string, variant string, backbone string, seed int, classes array<string>, splits_sha256 string, cfg struct<region: string>"


def read_manifest(spark: SparkSession, paths: list[str], kept_only: bool = True) -> DataFrame:
    m = spark.read.csv(paths, header=True, schema=MANIFEST)
    return m.where(F.col("note").startswith("kept")) if kept_only else m


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """A split document as a long table (id, file, class, variant, cluster, split)."""
    doc = spark.read.json(path, schema=SPLITS, multiLine=True)
    rand = doc.select(F.posexplode(F.arrays_zip("files", "class", "random")).alias("id", "r")).select("id", "r.files", "r.class", F.lit("random").alias("variant"), F.lit(None).cast("long").alias("cluster"), F.col("r.random").alias("split"))
    tau = doc.select("files", "class", F.explode("group").alias("tau", "g"))
    group = tau.select("tau", F.posexplode(F.arrays_zip("files", "class", F.col("g.cluster").alias("cluster"), F.col("g.split").alias("split"))).alias("id", "r"))
    group = group.select("id", "r.files", "r.class", F.concat(F.lit("group:"), F.col("tau").cast("double").cast("string")).alias("variant"), "r.cluster", "r.split")
    return rand.unionByName(group).withColumnRenamed("files", "file")


def write_splits(long: DataFrame, path: str, seed: int) -> None:
    """The inverse of read_splits: one document of parallel arrays in order of id."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("id", c))), lambda s: s[c])
    base = long.where("variant = 'random'").agg(ordered("file").alias("files"), ordered("class").alias("class"), ordered("split").alias("random"))
    g = long.where("variant <> 'random'").groupBy("variant").agg(F.struct(ordered("cluster").alias("cluster"), ordered("split").alias("split")).alias("g"))
    g = g.agg(F.map_from_entries(F.collect_list(F.struct(F.expr("substring(variant, 7)"), "g"))).alias("group"))
    meta = F.struct(F.lit(seed).alias("seed"), F.size("files").cast("long").alias("n"), F.transform(F.array_sort(F.map_keys("group")), lambda t: t.cast("double")).alias("taus"))
    base.crossJoin(g).select(meta.alias("meta"), "files", "class", "random", "group").coalesce(1).write.mode("overwrite").json(path)


def identical_random(a: DataFrame, b: DataFrame) -> bool:
    """Whether two split tables agree on files, classes and the random variant."""
    cols = ["id", "file", "class", "split"]
    x, y = (t.where("variant = 'random'").select(*cols) for t in (a, b))
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Run configurations below a folder, with whether each run has its completion marker."""
    configs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "config.json").json(root, schema=RUN, multiLine=True)
    configs = configs.withColumn("dir", F.regexp_replace(F.input_file_name(), "/[^/]*$", "")).withColumn("region", F.col("cfg.region"))
    key = lambda c: F.regexp_replace(c, "^file:/+", "/")
    flags = spark.createDataFrame([(p.rsplit("/", 1)[0],) for p in _files(spark, root) if p.endswith("/done.flag")], "flag_dir string")
    return configs.join(F.broadcast(flags.select(key(F.col("flag_dir")).alias("k")).distinct()), key(F.col("dir")) == F.col("k"), "left").withColumn("done", F.col("k").isNotNull()).drop("k")


def _files(spark: SparkSession, root: str) -> list[str]:
    """Paths of all files below a folder, by Spark's own file system; binaryFile would leave out empty markers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return out


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(hash, file) of lines "<hash>  <file>"."""
    parts = F.split("value", r"\s+", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("hash"), parts[1].alias("file"))


def write_predictions(pred: DataFrame, path: str) -> None:
    """Predictions by run, appended; a run that is already there is skipped."""
    spark = pred.sparkSession
    try:
        old = spark.read.parquet(path).select("run_id").distinct()
        pred = pred.join(old, "run_id", "left_anti")
    except Exception as e:  # nothing has been written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    pred.write.mode("append").partitionBy("run_id").parquet(path)


def summary_json(one_row: DataFrame) -> str:
    """A one-row result as JSON."""
    return one_row.select(F.to_json(F.struct("*")).alias("j")).first().j


def feature_files(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all feature files below a folder, with the file they are in; in order of file names where order counts."""
    return spark.read.option("recursiveFileLookup", "true").parquet(folder).withColumn("file", F.regexp_extract(F.input_file_name(), "[^/]+$", 0))


def archive_reports(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each archive's JSON document."""
    return spark.read.option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)


def write_features(rows: DataFrame, path: str) -> None:
    """An archive's features; what is there already stays as it is."""
    rows.write.mode("ignore").parquet(path)


def write_csv(rows: DataFrame, path: str, without: tuple[str, ...] = ()) -> None:
    """A table of the audit as CSV with a header, some columns left out."""
    rows.drop(*without).write.mode("overwrite").option("header", "true").csv(path)
