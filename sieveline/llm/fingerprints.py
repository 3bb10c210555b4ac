"""Context-triggered piecewise hashing of texts, compared by edit distance at compatible block sizes.

A rolling hash of the last seven bytes ends a piece wherever it hits a value that depends on the block size; a piece
adds six bits of its hash, as one of 64 signs, to the signature. Block sizes are 3 times powers of two. A text takes the
largest block size not above its length / 64 that gives 32 pieces at least, else a smaller one. The fingerprint holds
the signature at that size and at twice the size, 64 signs at most, whose last stands for all the text that is left.
Fingerprints can be compared where their block sizes are equal or one is twice the other. Their likeness is
1 - d / (l1 + l2) for the edit distance d of insertions and deletions, and 0 if they have no run of four signs (of all
signs, in shorter ones) in common. The distance of many pairs is found at once, in the bits of 64-bit words.

Edge cases: a null text counts as the empty text, whose fingerprint is 3::. Two empty signatures, and equal
fingerprints, have likeness 1. Rows that repeat a doc_id are ordered by text. A table of one row is its own next
document. A null doc_id comes first. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as kn
from .common import prepare, table, text_or_empty

U = np.uint64
WINDOW, SMALLEST, LENGTH, LEAST, COMMON = 7, 3, 64, 32, 4
#: The signs of a signature.
SIGNS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Bytes of a text that are worked on at once.
PART = 1 << 20
#: Rows of a range of ids that one task compares, about.
ROWS_PER_RANGE = 20_000


def triggers(data: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions lo <= i < hi at which the smallest block size ends a piece, and the largest power k for which 3 * 2**k does."""
    begin = max(0, lo - WINDOW + 1)
    part = data[begin:hi].astype(np.uint32) + np.uint32(1)
    n = len(part)
    roll = np.zeros(n, np.uint32)
    for j in range(WINDOW):
        roll[j:] += part[: max(0, n - j)] * np.uint32(pow(0x01000193, j + 1, 1 << 32))
    roll = roll[lo - begin :]
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x85EBCA6B)
    roll ^= roll >> np.uint32(13)
    at = np.flatnonzero(roll % np.uint32(SMALLEST) == SMALLEST - 1)
    third = (roll[at].astype(np.int64) + 1) // SMALLEST
    return at + lo, np.log2(third & -third).astype(np.int64)


def prefix_sums(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial sums of data[:e] for the sorted ends e."""
    out, before, scale = [], U(0), 1
    for lo in range(0, len(data), PART):
        hi = min(len(data), lo + PART)
        up, _ = kn.powers(hi - lo)
        sums = (data[lo:hi].astype(U) + U(1)) * up[: hi - lo]
        sums = np.cumsum(sums, dtype=U, out=sums) * U(scale) + before if lo else np.cumsum(sums, dtype=U, out=sums)
        out.append(sums[ends[(ends > lo) & (ends <= hi)] - lo - 1])
        before, scale = sums[-1], scale * pow(int(kn.BASE), hi - lo, 1 << 64) % 2**64
    return np.concatenate(out)


def fingerprint(data: np.ndarray) -> tuple[int, bytes, bytes]:
    """Block size as a power of two, and both signatures. A long text goes through in parts."""
    n = len(data)
    if not n:
        return 0, b"", b""
    k = max(0, int(np.ceil(np.log2(max(1, n / (SMALLEST * LENGTH))))))
    counts, found = np.zeros(k + 1, np.int64), []
    for lo in range(0, n, PART):
        at, power = triggers(data, lo, min(n, lo + PART))
        counts += np.bincount(np.minimum(power, k), minlength=k + 1)
        if n > PART:  # of every power the first LENGTH places are all that a signature can need
            keep = np.zeros(len(at), bool)
            for p in range(k + 2):
                keep[np.flatnonzero(power >= p)[:LENGTH]] = True
            at, power = at[keep], power[keep]
        found.append((at, power))
    at, power = (np.concatenate([x[i] for x in found]) for i in (0, 1))
    counts = np.cumsum(counts[::-1])[::-1]
    while k and counts[k] < LEAST:
        k -= 1
    cuts = []
    for p in (k, k + 1):
        ends = at[power >= p][: LENGTH - 1] + 1
        cuts.append(ends if len(ends) and ends[-1] == n else np.append(ends, n))
    every = np.unique(np.concatenate(cuts))
    sums, inverse = prefix_sums(data, every), pow(int(kn.BASE), -1, 1 << 64)
    _, down = kn.powers(min(n, PART))

    def signature(ends: np.ndarray) -> bytes:
        upto, starts = sums[np.searchsorted(every, ends)], np.r_[0, ends[:-1]]
        shift = down[starts] if n <= PART else np.array([pow(inverse, x, 1 << 64) for x in starts.tolist()], U)
        return SIGNS[(kn.mix((upto - np.r_[U(0), upto[:-1]]) * shift) >> U(58)).astype(np.int64)].tobytes()

    return k, signature(cuts[0]), signature(cuts[1])


def spelled(f: tuple[int, bytes, bytes]) -> str:
    return f"{SMALLEST << f[0]}:{f[1].decode()}:{f[2].decode()}"


def common_run(a: bytes, b: bytes) -> bool:
    m = min(COMMON, len(a), len(b))
    return any(a[i : i + m] in b for i in range(len(a) - m + 1))


def likeness(pairs: list[tuple[bytes, bytes]]) -> np.ndarray:
    """1 - d / (l1 + l2) of every pair of signatures of 64 signs at most; the longest common subsequences in bits."""
    out = np.zeros(len(pairs))
    idx = []
    for i, (a, b) in enumerate(pairs):
        if a == b:
            out[i] = 1
        elif a and b and common_run(a, b):
            idx.append(i)
    if not idx:
        return out
    m = len(idx)
    la, lb = (np.array([len(pairs[i][s]) for i in idx]) for s in (0, 1))
    a, b = (np.zeros((m, LENGTH), np.int64) for _ in range(2))
    for row, i in enumerate(idx):
        a[row, : la[row]] = np.frombuffer(pairs[i][0], np.uint8)
        b[row, : lb[row]] = np.frombuffer(pairs[i][1], np.uint8)
    where, rows = np.zeros((m, 128), U), np.arange(m)
    for j in range(LENGTH):
        where[rows, a[:, j]] |= U(1) << U(j)  # a 0 behind the end is never looked up
    v = np.full(m, ~U(0))
    for j in range(LENGTH):
        u = v & where[rows, b[:, j]]
        v = np.where(j < lb, (v + u) | (v - u), v)
    inside = np.where(la == 64, ~U(0), (U(1) << np.minimum(la, 63).astype(U)) - U(1))
    common = np.bitwise_count(~v & inside)
    out[idx] = 2 * common / (la + lb)
    return out


def compare(pairs: list[tuple[tuple, tuple]]) -> np.ndarray:
    """Likeness of pairs of fingerprints (k, signature at k, signature at k + 1)."""
    tasks, owner = [], []
    for i, (x, y) in enumerate(pairs):
        if x[0] == y[0]:
            tasks += [(x[1], y[1]), (x[2], y[2])]
            owner += [i, i]
        elif abs(x[0] - y[0]) == 1:
            tasks.append((x[2], y[1]) if y[0] > x[0] else (x[1], y[2]))
            owner.append(i)
    out = np.zeros(len(pairs))
    if tasks:
        np.maximum.at(out, owner, likeness(tasks))
    return out


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def of_text(text: str) -> tuple[int, bytes, bytes]:
    return fingerprint(np.frombuffer(text.encode(), np.uint8))


def neighbours(batches) -> Iterator[pa.RecordBatch]:
    """Rows (range, doc_id, text, guest) in order to results. The last row of a range is its guest: the next one's first row."""
    before, held = None, []

    def out():
        names, sizes, shas, own, edited, following = map(list, zip(*held))
        near = compare(list(zip(own, edited)) + list(zip(own, following)))
        n = len(held)
        columns = [names, sizes, shas, list(map(spelled, own)), list(map(spelled, edited)), near[:n], near[n:]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

    for batch in batches:
        for part, doc_id, text, guest in zip(*(batch.column(i).to_pylist() for i in range(4))):
            f = of_text(text)
            if before is not None and before[0] == part:
                _, old_id, old, old_f = before
                cut = len(old) // 4
                changed = old[: len(old) - cut] + text[:cut]
                e = old_f if changed == old else of_text(changed)
                held.append((old_id, len(old), hashlib.sha256(changed.encode()).hexdigest(), old_f, e, f))
            before = None if guest else (part, doc_id, text, f)
            if len(held) == 2000:
                yield out()
                held = []
    if held:
        yield out()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Ids are cut into ranges by approximate quantiles; the first row of each range is also dealt to the range before it
    (to the last range from the first), so that every row meets its next without one task ordering the table.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ids = docs.select("doc_id")
    n = ids.count()
    ranges = max(1, min(100_000, max(-(-n // ROWS_PER_RANGE), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    quantiles = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], min(1_000_000, 100 * ranges))
    edges = np.array(sorted(set((ids.agg(quantiles.alias("q")).first().q if ranges > 1 else None) or [])), np.int64)

    @F.pandas_udf("int")
    def part_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(), "right").astype(np.int32))

    key = F.coalesce("doc_id", F.lit(-(2**63)))
    firsts = ids.select(key.alias("key")).groupBy(part_of("key").alias("part")).agg(F.min("key").alias("first")).orderBy("part").collect()  # one row a range
    back = spark.createDataFrame([(r.first, firsts[i - 1].part) for i, r in enumerate(firsts)], "order long, part int")
    rows = docs.select(part_of(key).alias("own"), "doc_id", "text", key.alias("order"))
    # Of rows that share the first id of a range, the one of the smallest text is the first row.
    heads = docs.select(key.alias("order"), "text").join(F.broadcast(back), "order").groupBy("order", "part").agg(F.min("text").alias("text"))
    guests = heads.select("part", F.lit(True).alias("guest"), F.col("order").alias("doc_id"), "text", F.lit(2**63 - 1).alias("order"))
    own = rows.select(F.col("own").alias("part"), F.lit(False).alias("guest"), "doc_id", "text", "order")
    both = own.unionByName(guests).repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", "guest", "order", "text")
    return both.select("part", "doc_id", "text", "guest").mapInArrow(neighbours, DDL)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
