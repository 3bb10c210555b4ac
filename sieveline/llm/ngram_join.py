"""Jaccard join of documents on word n-grams: size-banded tiles, bitmap bounds, exact intersection.

A document's set holds the hashes of its distinct runs of k words. Documents of equal sets form a class, which is
compared once. Sizes are cut into bands; the tile of a band is where sets of that band meet others of the same or a
larger size that could still be similar enough. Within a tile, sets meet under keys of two kinds, so chosen that no
similar pair is lost. Hashes that a sample of the corpus holds often are hot, and bring no sets together by themselves.

Parts: the range of hashes is cut into D + 1 + E parts, where D is the largest symmetric difference that similar pairs
of the tile can have. The cold elements of such a pair agree on E + 1 parts at least. A part without cold elements says
nothing and gives no key; a set with no more than E of those is regular, and meets every set that it is similar to.

Prefixes: two sets that aren't regular meet under single elements. Let all elements have one order, cold ones first, hot
ones last by their count. A similar pair has one of the first n - ceil(t n) + 1 elements of the one and the first
m - ceil(t m) + 1 of the other in common. Where parts would hold too few elements to tell sets apart, at low thresholds,
all sets meet by prefixes only.

Classes that meet in no tile need never be looked at. A pair that meets may be similar if bitmaps allow enough overlap:
every bit of one that the other lacks is an element that it lacks. Such pairs join classes to clumps. Tiles of up to SMALL
classes give all their pairs; larger ones give a star about their first class, and where members of a tile are then in
different clumps, those are held against each other in blocks, of which only the pairs that join clumps come out.

All links lie within clumps. The sorted arrays of a clump's classes are sent there once, in blocks; every pair of blocks is
one cell's work. A cell keeps each set as its difference to what most sets of the cell hold, bounds the overlap of
differences by bitmaps from above, and intersects the sorted differences of the pairs that are left. It returns the links
of each class, as a number, and pairs that join its components; a group's pairs are never emitted. Work on a clump grows
with the square of its classes (not of its copies), at some ten nanoseconds a pair; its arrays go to as many cells as it
has blocks.

Edge cases: a null, empty or blank text has the empty set and is linked with nothing. A text of fewer than k words has
one element, the whole sequence. Rows that repeat a doc_id, or have none, are documents of their own; the component of
such documents only has no id (null). Texts of any length are read whole. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as kn
from .components import components
from .common import Scratch, prepare, table

U = np.uint64
SMALL = 16
#: A shingle is hot if at least OFTEN different texts of a SAMPLE-th of all texts have it. Of more than HOT (16 MB), those of
#: the largest counts are. This only orders elements and picks keys: what isn't known as hot is never lost.
SAMPLE, OFTEN, HOT = 8, 3, 1_000_000
#: A hot key that about so many classes or more have is dealt to several tasks.
KEY_CLASSES = 500_000
#: Hashes of texts to be looked at again are broadcast if there are no more than so many (8 MB), else joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of keys that one task compares.
ROWS_PER_TASK = 1_000_000
#: Parts are used where they hold so many elements at least on average; E allows for sets with such a share of cold ones.
LOAD, COLD = 5, 0.8
#: Most classes, and about most bytes of their sets, in a block of a tile or clump.
BLOCK, BLOCK_BYTES = 8192, 1 << 24
#: Words of 64 bits in a cell's bitmaps at most.
WORDS = 64


@lru_cache(maxsize=8)
def bands(tn: int, td: int, top: int = 1 << 40) -> np.ndarray:
    """Where the size bands begin. Each ends at the square of 1/t times its beginning, t = tn / td: about half of the sets
    then belong to their own tile only, the rest to the one below as well."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, out[-1] * td * td // (tn * tn)))
    return np.array(out)


def band(n: int, tn: int, td: int) -> int:
    return int(np.searchsorted(bands(tn, td), n, "right")) - 1


@lru_cache(maxsize=4096)
def parts(tile: int, tn: int, td: int) -> tuple[int, int, int]:
    """The tile's D, its number of parts (0: prefixes only), and E of them."""
    edges = bands(tn, td)
    low, high = int(edges[tile]), int(edges[tile + 1]) - 1
    different = (high + high * td // tn) * (td - tn) // (td + tn)
    if low < LOAD * (different + 1):
        return different, 0, 0
    spare = 1
    while True:
        k = different + 1 + spare
        empty = k * np.exp(-COLD * low / k)
        if spare >= empty + np.sqrt(empty):
            return different, k, spare
        spare += max(1, spare // 8)
        if spare > different + 4:
            return different, 0, 0  # too few elements: prefixes of so small sets are short anyway


def tile_keys(elements: np.ndarray, hot: tuple[np.ndarray, np.ndarray], tn: int, td: int) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a sorted set of hashes, and to how many tasks each is dealt. hot: sorted hashes and their counts. Keys
    that are dealt to several tasks are odd, all others even."""
    n = len(elements)
    least = -(-n * tn // td)
    is_hot, rank = np.zeros(n, bool), None
    if len(hot[0]):
        rank = np.minimum(np.searchsorted(hot[0], elements), len(hot[0]) - 1)
        is_hot = hot[0][rank] == elements
    cold = elements[~is_hot]
    sums = np.concatenate([np.zeros(1, U), np.cumsum(kn.mix(cold ^ kn.MIX2), dtype=U)])
    first = cold[: n - least + 1]
    spread = np.ones(len(first), np.int64)
    if len(first) < n - least + 1:
        counts = hot[1][rank[is_hot]]
        order = np.lexsort((elements[is_hot], counts))[: n - least + 1 - len(first)]
        first = np.concatenate([first, elements[is_hot][order]])
        spread = np.concatenate([spread, 1 + counts[order] // KEY_CLASSES])
    out, tasks = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for tile in range(band(least, tn, td), band(n, tn, td) + 1):
        different, k, spare = parts(tile, tn, td)
        if not different:
            continue  # similar sets of this tile are equal
        empty = 1
        if k:
            ends = np.searchsorted(((cold >> U(32)) * U(k)) >> U(32), np.arange(k + 1, dtype=U))
            full = ends[1:] > ends[:-1]
            empty = k - int(full.sum())
            keys = kn.mix(sums[ends[1:]] - sums[ends[:-1]] + U((tile + 1) * int(kn.BASE) % 2**64)) + np.arange(k, dtype=U)
            out.append(kn.mix(keys[full]) & ~U(1))
            tasks.append(np.ones(len(out[-1]), np.int64))
        if empty > spare:
            out.append((kn.mix(first + U(tile * int(kn.MIX1) % 2**64)) & ~U(1)) | (spread > 1).astype(U))
            tasks.append(spread)
    return np.concatenate(out), np.concatenate(tasks)


def bitmap(elements: np.ndarray) -> bytes:
    """Twice as many bits as elements or more, a power of two, 64 at least."""
    size = 1 << max(6, int(2 * len(elements) - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[(elements & U(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps, one a row, made as small as that."""
    return np.bitwise_or.reduce(rows.reshape(len(rows), -1, words), axis=1)


def enough(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, tn: int, td: int) -> np.ndarray:
    """Whether sets of sizes n and m with these bitmaps, one a row, can have enough elements in common."""
    lacks_x, lacks_y = np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
    return np.minimum(n - lacks_x, m - lacks_y) * (td + tn) >= (n + m) * tn


def binary_rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit words of a binary column, and where each row begins in them (one more at the end)."""
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    whole = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return np.frombuffer(whole.tobytes(), U), (offsets - offsets[0]) // 8


def possible(tn: int, td: int):
    """Pairs (a, b, n of a, n of b, bitmaps of both) to those (a, b) that can be similar. The larger bitmap is folded."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            (xw, xo), (yw, yo) = binary_rows(batch.column(4)), binary_rows(batch.column(5))
            lx, ly = np.diff(xo), np.diff(yo)
            sized, keep = np.minimum(n, m) * td >= np.maximum(n, m) * tn, np.zeros(len(n), bool)
            for p, q in {(int(p), int(q)) for p, q in zip(lx[sized], ly[sized])}:
                rows = np.flatnonzero(sized & (lx == p) & (ly == q))
                step = max(1, (1 << 22) // (p + q))
                for r in (rows[i : i + step] for i in range(0, len(rows), step)):
                    x, y = xw[xo[r][:, None] + np.arange(p)], yw[yo[r][:, None] + np.arange(q)]
                    w = min(p, q)
                    keep[r] = enough(folded(x, w), folded(y, w), n[r], m[r], tn, td)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words, first = kn.word_hashes(col)
    for a, b in zip(first[:-1], first[1:]):
        yield np.unique(kn.shingles(words[a:b], k))


def class_of(elements: np.ndarray) -> int:
    """64 bits that name a set."""
    n = U(len(elements))
    x = kn.mix(np.array([np.bitwise_xor.reduce(kn.mix(elements + kn.MIX1)) if len(elements) else U(0), np.add.reduce(kn.mix(elements ^ kn.BASE), dtype=U)]))
    return int(kn.mix(x[:1] * kn.MIX2 + x[1:] + n)[0].astype(np.int64))


def counted(k: int):
    """Texts to (h, n): how many of some texts at a time have each shingle."""

    def run(batches):
        held, size = [], 0

        def out():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(h), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 20)].view(np.int64)), pa.array(n[i : i + (1 << 20)])], names=["h", "n"])

        for whole in batches:
            for batch in kn.slices(whole, 0):
                for e in sets(batch.column(0), k):
                    held.append(e)
                    size += len(e)
                if size >= 1 << 21:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return run


SIGNATURE_DDL = "doc_id long, t long, n long, cls long, bits binary"


def signatures(k: int):
    """(doc_id, t, text) to the size, class and bitmap of the text's set."""

    def run(batches):
        for whole in batches:
            for batch in kn.slices(whole, 2):
                got = [(len(e), class_of(e), bitmap(e)) for e in sets(batch.column(2), k)]
                sizes, classes, bits = zip(*got)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(bits, pa.binary())], names=["doc_id", "t", "n", "cls", "bits"]
                )

    return run


def dealt(k: int, tn: int, td: int, hot: tuple[np.ndarray, np.ndarray], p: int):
    """Texts to one row for each partition: its keys and their classes, packed. A class counts once in a task."""

    def run(batches):
        seen: set[int] = set()
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0

        def out():
            keys, tasks = np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
            classes = np.repeat(np.array([c for c, _, _ in held], np.int64), [len(x) for _, x, _ in held])
            salt = kn.mix(classes.view(U)) % tasks.astype(U)
            pid = (((kn.mix(keys + salt * kn.BASE) >> U(32)) * U(p)) >> U(32)).astype(np.int32)
            order = np.argsort(pid, kind="stable")
            keys, classes, pid = keys[order], classes[order], pid[order]
            at = np.flatnonzero(np.r_[True, pid[1:] != pid[:-1]])
            ends = np.r_[at[1:], len(pid)]
            return pa.RecordBatch.from_arrays(
                [pa.array(pid[at]), pa.array([keys[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()), pa.array([classes[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())],
                names=["pid", "keys", "classes"],
            )

        for whole in batches:
            for batch in kn.slices(whole, 0):
                for e in sets(batch.column(0), k):
                    c = class_of(e)
                    if c not in seen:
                        seen.add(c)
                        keys, tasks = tile_keys(e, hot, tn, td) if len(e) else (e, e)
                        if len(keys):
                            held.append((c, keys, tasks))
                            size += len(keys)
                if size > 1 << 20:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def bucket_pairs(batches):
    """Packed keys and classes of a partition to pairs (a, b, null) of small tiles and members of large ones (a, null, key)."""
    got: dict[int, list] = {}
    for batch in batches:
        for pid, k, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
            got.setdefault(pid, []).append((k, c))
    for pid in list(got):
        blobs = got.pop(pid)
        keys = np.frombuffer(b"".join(k for k, _ in blobs), U)
        classes = np.frombuffer(b"".join(c for _, c in blobs), np.int64)
        order = np.lexsort((classes, keys))
        keys, classes = keys[order], classes[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])]
        keys, classes = keys[new], classes[new]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        count = np.diff(np.r_[at, len(keys)])
        large = np.repeat(count, count) > SMALL
        large |= keys & U(1) == 1  # a part of a key's classes: the others are elsewhere
        pairs = []
        for d in range(1, SMALL):
            i = np.flatnonzero((keys[d:] == keys[:-d]) & ~large[d:])
            pairs.append(np.stack([classes[i], classes[i + d]]))
        pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
        big = np.flatnonzero(large)
        for columns in ((pairs[0], pairs[1], None), (classes[big], None, keys[big].view(np.int64))):
            for i in range(0, len(columns[0]), 1 << 16):
                part = [None if c is None else c[i : i + (1 << 16)] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part[0]), pa.int64()) if c is None else pa.array(c) for c in part], names=["a", "b", "key"])


def arrays(k: int):
    """Texts to (cls, elements)."""

    def run(batches):
        for whole in batches:
            for batch in kn.slices(whole, 0):
                got = [(class_of(e), e.tobytes()) for e in sets(batch.column(0), k) if len(e)]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in got], pa.int64()), pa.array([e for _, e in got], pa.binary())], names=["cls", "elements"])

    return run


class Forest:
    """Which of some nodes are joined, as one label a node."""

    def __init__(self, labels: np.ndarray):
        self.label = labels

    def join(self, nodes: np.ndarray) -> bool:
        """Whether the nodes weren't all joined before."""
        old = np.unique(self.label[nodes])
        if len(old) > 1:
            self.label[np.isin(self.label, old[1:])] = old[0]
        return len(old) > 1


def cell_rows(first: int, handle: Callable) -> Callable:
    """Batches of rows that are sorted by their first columns, the cell, to what handle makes of each cell's columns."""

    def run(batches):
        name, held = None, []
        for batch in batches:
            cells = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(first)])
            if not len(batch):
                continue
            at = np.r_[0, np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0)) + 1, len(batch)]
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                if held and tuple(cells[:, i]) != name:
                    yield from handle(name, pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                name = tuple(cells[:, i])
                held.append(batch.slice(i, j - i))
        if held:
            yield from handle(name, pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def tile_joins(tn: int, td: int):
    """Members (.., blk, cls, root, n, bits) of a tile's cell to pairs that can be similar and join different roots."""

    def handle(cell, rows):
        blk, cls, root, n = (rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6))
        names, first, size = np.unique(root, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return
        words, offsets = binary_rows(rows.column(7))
        lengths = np.diff(offsets)
        width = int(lengths.min())
        bits = np.empty((len(n), width), U)
        for w in np.unique(lengths).tolist():
            r = np.flatnonzero(lengths == w)
            bits[r] = folded(words[offsets[r][:, None] + np.arange(w)], width)
        forest, out = Forest(first.astype(np.int64)), []
        for i in np.flatnonzero(first != int(size.argmax())).tolist():
            j = np.flatnonzero((forest.label != forest.label[i]) & (np.minimum(n, n[i]) * td >= np.maximum(n, n[i]) * tn) & ((blk != blk[i]) | (cell[1] == cell[2])))
            j = j[enough(bits[j], np.broadcast_to(bits[i], (len(j), width)), n[j], n[i], tn, td)]
            for x in j.tolist():
                if forest.join(np.array([i, x])):
                    out.append((min(cls[i], cls[x]), max(cls[i], cls[x])))
        if out:
            a, b = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return cell_rows(3, handle)


def differences(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Sets, one after another, as their differences to the set H of what over half of them hold: the sorted differences, where
    each begins (one more at the end), the size of H, and how many elements of H each set lacks."""
    m = len(first) - 1
    values, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), np.diff(first))
    common = 2 * count > m
    added = ~common[code]
    inside = np.bincount(owner[~added], minlength=m)
    lacks = int(common.sum()) - inside
    core = np.flatnonzero(common)
    where = np.flatnonzero(lacks)
    # A set that lacks some of H: H without its elements. Sets are taken in turn, as H by sets may be large.
    missing = [np.setdiff1d(core, code[first[i] : first[i + 1]], assume_unique=True) for i in where.tolist()]
    who = np.concatenate([owner[added], np.repeat(where, [len(x) for x in missing])])
    what = np.concatenate([code[added], *missing]) if missing else code[added]
    order = np.lexsort((what, who))
    return what[order], np.r_[0, np.cumsum(np.bincount(who, minlength=m))], len(core), lacks


def cell_links(tn: int, td: int, count: bool):
    """Members (.., blk, cls, copies, elements) of a clump's cell to pairs (a, b, null) that join what links join, and, if
    count, the number of documents (a, null, links) that each class is linked with in this cell."""

    def handle(cell, rows):
        blk, cls, copies = (rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
        flat, first = binary_rows(rows.column(6))
        n, m = np.diff(first), len(cls)
        what, at, h, lacks = differences(flat, first)
        del flat
        d = np.diff(at)
        owner = np.repeat(np.arange(m), d)
        words = min(WORDS, 1 << max(0, int(2 * max(1, d.max(initial=1)) - 1).bit_length() - 6), max(1, (1 << 23) // m))
        words = 1 << (words.bit_length() - 1)
        place = kn.mix(what.astype(U)) & U(64 * words - 1)
        bits = np.zeros((m, words), U)
        np.bitwise_or.at(bits, (owner, (place >> U(6)).astype(np.int64)), U(1) << (place & U(63)))
        forest, links = Forest(np.arange(m)), np.zeros(m, np.int64)
        order = np.argsort(n, kind="stable")
        sizes, whole = n[order], cell[1] == cell[2]
        for k, i in enumerate(order.tolist()):
            j = order[k + 1 : np.searchsorted(sizes, n[i] * td // tn, "right")]
            if not whole:
                j = j[blk[j] != blk[i]]
            if not count:
                j = j[forest.label[j] != forest.label[i]]
            if not len(j):
                continue
            # What both sets hold of H, and what differences must still have in common.
            short = -(-(n[i] + n[j]) * tn // (td + tn)) - (h - lacks[i] - lacks[j])
            most = np.minimum(d[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(axis=1, dtype=np.int64), d[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(axis=1, dtype=np.int64))
            j, short = j[most >= short], short[most >= short]
            look = np.flatnonzero(short > 0)
            if len(look):
                mine, starts, ends = what[at[i] : at[i + 1]], at[j[look]], at[j[look] + 1]
                upto = np.r_[0, np.cumsum(ends - starts)]
                theirs = what[np.arange(upto[-1]) + np.repeat(starts - upto[:-1], ends - starts)]
                seen = np.searchsorted(mine, theirs)
                same = np.r_[0, np.cumsum(mine[np.minimum(seen, len(mine) - 1)] == theirs)] if len(mine) else np.zeros(len(theirs) + 1, np.int64)
                keep = np.ones(len(j), bool)
                keep[look] = same[upto[1:]] - same[upto[:-1]] >= short[look]
                j = j[keep]
            if len(j):
                links[i] += copies[j].sum()
                links[j] += copies[i]
                forest.join(np.r_[i, j])
        joined = np.flatnonzero(forest.label != np.arange(m))
        if len(joined):
            yield pa.RecordBatch.from_arrays([pa.array(cls[joined]), pa.array(cls[forest.label[joined]]), pa.nulls(len(joined), pa.int64())], names=["a", "b", "links"])
        linked = np.flatnonzero(links)
        if count and len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(cls[linked]), pa.nulls(len(linked), pa.int64()), pa.array(links[linked])], names=["a", "b", "links"])

    return cell_rows(3, handle)


class JaccardJoin:
    def __init__(self, docs: DataFrame, k: int, tn: int, td: int):
        self.spark, self.k, self.tn, self.td = docs.sparkSession, k, tn, td
        prepare(self.spark)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
        self.scratch = Scratch(self.spark, "ngram-join")
        self.tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def hot(self) -> tuple[np.ndarray, np.ndarray]:
        """The hot shingles, sorted, and about how many different texts have each."""
        some = self.docs.where(F.pmod("t", F.lit(SAMPLE)) == 0).groupBy("t").agg(F.first("text").alias("text")).select("text")
        counts = some.mapInArrow(counted(self.k), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
        counts = self.scratch.write(counts, "counts")
        grade = F.floor(F.log2("n") * 16)
        least, room = 0, HOT
        for r in counts.groupBy(grade.alias("grade")).count().orderBy(F.desc("grade")).collect():  # some 1,000 rows at most
            room -= r["count"]
            if room < 0:
                least = r.grade + 1
                break
        got = counts.where(grade >= least).toPandas()  # HOT rows at most
        self.scratch.drop(counts)
        h, n = got["h"].to_numpy(np.int64).view(U), got["n"].to_numpy(np.int64)
        order = np.argsort(h)
        return h[order], n[order] * SAMPLE

    def cells(self, members: DataFrame, group: str, size: Column, columns: list[str]) -> DataFrame:
        """(group, lo, hi, blk, columns): members in blocks, every block with every other and itself, sorted by cell."""
        of = members.groupBy(F.col(group).alias("g")).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(size) / BLOCK_BYTES)).alias("of")).where("of > 1")
        told = members.join(of, F.col(group) == F.col("g"), "left").withColumn("of", F.coalesce("of", F.lit(1)))
        told = told.withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("of"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
        told = told.select(group, F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", *columns)
        return told.repartition(self.tasks, group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")

    def possible(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs (a, b) that can be similar by their sizes and bitmaps."""
        x, y = (classes.select(F.col("cls").alias(a), F.col("n").alias(f"n{a}"), F.col("bits").alias(f"bits{a}")) for a in "ab")
        both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "na", "nb", "bitsa", "bitsb")
        return both.mapInArrow(possible(self.tn, self.td), "a long, b long")

    def clumps(self, found: DataFrame, classes: DataFrame) -> DataFrame:
        """(node, root) of all classes that are in a clump."""
        members = found.where("key IS NOT NULL").select("key", F.col("a").alias("cls"))
        hubs = members.groupBy("key").agg(F.min("cls").alias("hub"))
        stars = members.join(hubs, "key").where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b"))
        near = self.scratch.write(self.possible(found.where("key IS NULL").select("a", "b").unionByName(stars).distinct(), classes), "possible")
        roots = components(near, self.scratch)
        marked = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        marked = self.scratch.write(marked, "marked")
        several = marked.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        rows = marked.join(several, "key", "left_semi").join(classes.select("cls", "n", "bits"), "cls")
        cells = self.cells(rows, "key", F.length("bits"), ["cls", "root", "n", "bits"])
        more = self.scratch.write(cells.mapInArrow(tile_joins(self.tn, self.td), "a long, b long").distinct(), "joins")
        self.scratch.drop(marked)
        if more.isEmpty():
            self.scratch.drop(near, more)
            return roots
        out = components(near.unionByName(more), self.scratch)
        self.scratch.drop(near, more, roots)
        return out

    def decide(self, clumps: DataFrame, classes: DataFrame, count: bool) -> DataFrame:
        """(a, b, links): see cell_links."""
        members = self.scratch.write(clumps.select(F.col("node").alias("cls"), F.col("root").alias("clump")).join(classes.select("cls", "t", "n", "copies"), "cls"), "members")
        ids = members.select("t")
        ids = F.broadcast(ids) if members.count() <= BROADCAST_IDS else ids
        texts = self.docs.join(ids, "t", "left_semi").groupBy("t").agg(F.first("text").alias("text")).select("text")
        full = members.drop("t").join(texts.mapInArrow(arrays(self.k), "cls long, elements binary"), "cls")
        cells = self.cells(full, "clump", F.length("elements"), ["cls", "copies", "elements"])
        out = self.scratch.write(cells.mapInArrow(cell_links(self.tn, self.td, count), "a long, b long, links long"), "links")
        self.scratch.drop(members)
        return out

    def run(self, count: bool = True) -> DataFrame:
        """(doc_id, n_shingles, component_id, n_links) of every document; n_links is null unless they are counted."""
        k, tn, td, scratch = self.k, self.tn, self.td, self.scratch
        sig = scratch.write(self.docs.mapInArrow(signatures(k), SIGNATURE_DDL), "signatures")
        classes = sig.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("cid"), F.min("t").alias("t"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("copies"))
        classes = scratch.write(classes, "classes")
        size = classes.agg(F.sum("n").alias("s")).first().s or 0
        p = max(self.tasks, -(-2 * size * (td - tn) // td // ROWS_PER_TASK))
        packed = self.docs.select("text").mapInArrow(dealt(k, tn, td, self.hot(), p), "pid int, keys binary, classes binary")
        found = scratch.write(packed.repartition(p, "pid").mapInArrow(bucket_pairs, "a long, b long, key long"), "candidates")
        clumps = self.clumps(found, classes)
        links = self.decide(clumps, classes, count)
        scratch.drop(found, clumps)
        roots = components(links.where("b IS NOT NULL"), scratch)
        full = classes.select("cls", "cid", "copies").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        least = full.groupBy("root").agg(F.min("cid").alias("component_id"))
        others = links.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
        named = full.join(least, "root").join(others, "cls", "left")
        named = named.select("cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
        named = scratch.write(named, "named")
        scratch.drop(classes, links, roots)
        blank = F.col("n") == 0
        return sig.select("doc_id", "n", "cls").join(named, "cls", "left").select(
            "doc_id", F.col("n").alias("n_shingles"), F.when(blank, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            F.when(F.lit(count), F.coalesce("links", F.lit(0))).alias("n_links"),
        )


def near_duplicates(docs: DataFrame, k: int = 5, tn: int = 80, td: int = 100, count: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): documents whose sets of k-word shingles have a Jaccard index of tn/td at
    least are linked; component_id is the smallest doc_id that links lead to, n_links the number of documents that the
    document is linked with (null unless count, which components alone don't need)."""
    return JaccardJoin(docs, k, tn, td).run(count)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 90, 100)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 90 * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON r.doc_id = u.a),
c AS (SELECT a AS doc_id, count(*) AS n FROM u GROUP BY a)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.root) AS component_id, coalesce(max(c.n), 0) AS n_links
FROM r LEFT JOIN n ON n.doc_id = r.doc_id LEFT JOIN c ON c.doc_id = r.doc_id GROUP BY r.doc_id
"""
