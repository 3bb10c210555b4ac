"""Minimax contiguous partition of ordered atomic groups into shards of nearly equal bytes.

Groups are equal texts, ordered by the MD5 of the text. The smallest capacity C is searched by bisection such that
taking groups greedily in that order, and cutting whenever the next group would exceed C, needs no more than n shards.
The order is divided into 65,536 cells by the leading hex digits, of which the driver sees the sums. A cell of several
groups in which a cut of the search falls is divided into 256 finer ones, and so on, until all such cells are single
groups: some hundred cells a level, a level for every 256 times as many groups.

Slots number a shard's rows in the order of the MD5 of the id, then by id and text.

Edge cases: a null text counts as the empty text (size 1). All rows of equal texts share a shard, also if that group is
larger than a fair share; later shards can then be empty. Rows that repeat a doc_id are rows of their own. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, prepare, table, text_or_empty

#: Hex digits of the first cells, and of each finer level.
DIGITS, FINER = 4, 2
#: Rows of a shard are numbered in cells by so many hex digits of their id's MD5, so that no task orders a whole shard.
SLOT_DIGITS = 3


class Order:
    """The ordered groups as cells (first hex digits, bytes, number of groups)."""

    def __init__(self, cells: list[tuple[str, int, int]]):
        self.cells, self.missing = sorted(cells), set()
        self.before = np.concatenate([[0], np.cumsum([c[1] for c in self.cells], dtype=np.int64)]).tolist()
        self.total = self.before[-1]

    def reach(self, limit: int) -> int:
        """The largest sum of leading whole groups that is no more than limit, as far as the cells tell."""
        i = bisect_right(self.before, limit) - 1
        if i >= len(self.cells):
            return self.total
        if self.before[i] < limit and self.cells[i][2] > 1:
            self.missing.add(self.cells[i][0])
        return self.before[i]

    def cuts(self, capacity: int, shards: int) -> list[int]:
        out, at = [], 0
        for _ in range(shards):
            at = self.reach(at + capacity)
            out.append(at)
        return out

    def capacity(self, shards: int, largest: int) -> int:
        """The smallest capacity that needs no more than that many shards, as far as the cells tell."""
        lo, hi = max(largest, -(-self.total // shards)), max(largest, self.total)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.cuts(mid, shards)[-1] >= self.total else (mid + 1, hi)
        return lo

    def begins(self, at: int) -> str:
        """The leading digits of the groups from which the sum of those before is at."""
        return self.cells[bisect_right(self.before, at) - 1][0]


def cell_sums(groups: DataFrame, digits: int) -> list[tuple[str, int, int]]:
    """At most 16 ** digits rows."""
    got = groups.groupBy(F.substring("g", 1, digits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    return [(r.cell, r.bytes, r.n) for r in got.collect()]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """groups: (g hex string, bytes). The leading digits of the groups that begin the shards 1.., and the capacity."""
    order = Order(cell_sums(groups, DIGITS))
    if not order.cells:
        return [], 0
    largest = groups.agg(F.max("bytes").alias("m")).first().m
    while True:
        best = order.capacity(shards, largest)
        order.cuts(best, shards)
        if not order.missing:
            break
        cells = [c for c in order.cells if c[0] not in order.missing]
        for digits in sorted({len(c) for c in order.missing}):
            wanted = [c for c in order.missing if len(c) == digits]
            cells += cell_sums(groups.where(F.substring("g", 1, digits).isin(wanted)), digits + FINER)  # 256 rows a cell at most
        order = Order(cells)
    return [order.begins(at) for at in order.cuts(best, shards)[:-1] if at < order.total], best


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, g) with equal texts together and the largest shard as small as can be."""
    spark = docs.sparkSession
    prepare(spark)
    scratch, text = Scratch(spark, "sharding"), text_or_empty()
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.md5(F.encode(text, "utf-8")).alias("g")
    )
    rows = scratch.write(rows, "rows")
    groups = scratch.write(rows.groupBy("g").agg(F.sum("size").alias("bytes")), "groups")
    keys, _ = minimax_cuts(groups, shards)
    scratch.drop(groups)
    number = F.lit(0)
    for k in keys:
        number = number + (F.col("g") >= k).cast("int")
    place = F.md5(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8"))
    rows = rows.withColumn("shard", number).withColumn("place", place).withColumn("cell", F.substring("place", 1, SLOT_DIGITS))
    counts = rows.groupBy("shard", "cell").count()  # 16 ** SLOT_DIGITS rows a shard at most, which bounds the broadcast and the window
    w = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("place", "doc_id", "g"))
    return rows.withColumn("nth", nth).join(F.broadcast(offsets), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"), "g"
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checking SQL searches the same capacity by bisection, a shard a step, and computes CRC-32 byte by byte.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS g, strlen(coalesce(text, '')) + 1 AS size FROM documents),
b AS (SELECT g, sum(size)::BIGINT AS bytes FROM d GROUP BY g),
c AS MATERIALIZED (SELECT g, sum(bytes) OVER (ORDER BY g)::BIGINT AS upto, (sum(bytes) OVER (ORDER BY g) - bytes)::BIGINT AS before FROM b),
e AS (SELECT max(bytes)::BIGINT AS largest, sum(bytes)::BIGINT AS total FROM b),
s(lo, hi, reached, n) AS (
  SELECT greatest(largest, (total + 15) // 16)::BIGINT, greatest(largest, total)::BIGINT, 0::BIGINT, 0 FROM e
  UNION ALL
  SELECT CASE WHEN n = 16 AND reached < total THEN (lo + hi) // 2 + 1 ELSE lo END, CASE WHEN n = 16 AND reached >= total THEN (lo + hi) // 2 ELSE hi END,
         CASE WHEN n = 16 THEN 0 ELSE (SELECT coalesce(max(upto), 0) FROM c WHERE upto <= reached + (lo + hi) // 2) END, CASE WHEN n = 16 THEN 0 ELSE n + 1 END
  FROM s, e WHERE lo < hi),
k AS (SELECT max(lo) AS capacity FROM s WHERE lo = hi),
p(n, reached) AS (
  SELECT 0, 0::BIGINT
  UNION ALL
  SELECT n + 1, (SELECT coalesce(max(upto), 0) FROM c, k WHERE upto <= reached + capacity) FROM p WHERE n < 15),
h AS (SELECT c.g, count(p.n)::INTEGER AS shard FROM c LEFT JOIN p ON p.n > 0 AND p.reached <= c.before GROUP BY c.g),
z AS (SELECT list(v ORDER BY i) AS crcs FROM (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END) AS v FROM range(256) r(i))),
q AS (
  SELECT d.*, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, size), lambda i: ('0x' || substr(hex(encode(d.t)), (2 * i - 1)::INTEGER, 2))::UBIGINT)),
         lambda x, y: xor(x >> 8, z.crcs[(xor(x, y) & 255)::INTEGER + 1])), 4294967295::UBIGINT)::BIGINT AS crc
  FROM (SELECT DISTINCT t, size FROM d) d, z)
SELECT d.doc_id, d.size, q.crc AS text_crc32, 'bytes' AS law, h.shard,
       row_number() OVER (PARTITION BY h.shard ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.g) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN h ON h.g = d.g JOIN q ON q.t = d.t
"""
