"""Files inside archives: a Python data source over tar files, plain or within a zip, that never unpacks to disk.

    spark.dataSource.register(TarInZip)
    spark.read.format("tarinzip").load("/data/*.zip")

A row is (archive, name, content, sha256, md5, bytes, error). Members that are not files are left out. A member that can't be
read has an error and no content, and where the archive itself breaks off, one last row without a name tells so:
readable() leaves such rows out, and skipped() counts them by archive. Each archive is one partition, read as a stream.
"""

from __future__ import annotations

import glob
import hashlib
import tarfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def members(stream) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """Names, contents and errors of the regular files of a tar stream."""
    try:
        with tarfile.open(fileobj=stream, mode="r|*") as tar:
            for m in tar:
                if m.isfile():
                    try:
                        yield m.name, tar.extractfile(m).read(), None
                    except (tarfile.TarError, OSError) as e:
                        yield m.name, None, str(e)
    except (tarfile.TarError, OSError, EOFError) as e:
        yield None, None, str(e)


def archive_rows(path: str) -> Iterator[tuple]:
    streams = []
    if zipfile.is_zipfile(path):
        z = zipfile.ZipFile(path)
        streams = [(f"{path}!{n}", z.open(n)) for n in z.namelist() if n.endswith((".tar", ".tar.gz", ".tgz"))]
    else:
        streams = [(path, open(path, "rb"))]
    for name, stream in streams:
        with stream:
            for member, content, error in members(stream):
                hashes = (hashlib.sha256(content).hexdigest(), hashlib.md5(content).hexdigest(), len(content)) if content is not None else (None, None, None)
                yield name, member, content, *hashes, error


def readable(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NULL").drop("error")


def skipped(rows: DataFrame) -> DataFrame:
    """(archive, skipped) of archives with unreadable members."""
    return rows.where("error IS NOT NULL").groupBy("archive").agg(F.count("*").alias("skipped"))


class OneArchive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TarReader(DataSourceReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def partitions(self):
        return [OneArchive(p) for p in sorted(glob.glob(self.pattern))]

    def read(self, partition: OneArchive):
        yield from archive_rows(partition.path)


class TarInZip(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tarinzip"

    def schema(self) -> str:
        return "archive string, name string, content binary, sha256 string, md5 string, bytes long, error string"

    def reader(self, schema) -> TarReader:
        return TarReader(self.options["path"])


def archive_totals(path: str) -> tuple[int, str, str]:
    """Bytes, MD5 and SHA-256 of a whole file, in one pass."""
    size, sums = 0, (hashlib.md5(), hashlib.sha256())
    with open(path, "rb") as f:
        for part in iter(lambda: f.read(1 << 20), b""):
            size += len(part)
            for h in sums:
                h.update(part)
    return size, *(h.hexdigest() for h in sums)


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """Every .jpg below a folder, whatever its case: path, base, content, length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][pP][gG]").load(root)
    return files.withColumn("base", F.element_at(F.split("path", "/"), -1))


def index_images(spark: SparkSession, root: str) -> DataFrame:
    """(base, path); a name that occurs twice is an error."""
    f = image_files(spark, root).select("base", "path")
    twice = f.groupBy("base").count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"names that occur more than once: {[r.base for r in twice]}")
    return f


def content_hashes(content: Column) -> list[Column]:
    return [F.sha2(content, 256).alias("sha256"), F.md5(content).alias("md5"), F.octet_length(content).alias("bytes")]
