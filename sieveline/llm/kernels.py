"""Vectorised kernels over the UTF-8 bytes of Arrow string columns: words, hashes of words, shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: An odd base of the polynomial hash of bytes, and the multipliers of the splitmix64 finaliser.
BASE = U(0x9E3779B97F4A7C15)
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Texts are worked on in runs of about so many bytes, cut between documents and, within huge ones, at blanks.
PIECE = 1 << 18
#: Bytes of a text in which words are looked for at once.
PART = 1 << 20

BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every bit of x over all bits of the result."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n + 1, BASE), np.full(n + 1, inverse)
    up[0] = down[0] = U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(n).bit_length()))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is an empty row."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: int, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about limit bytes of text each, one row at least."""
    _, offsets = utf8(batch.column(text))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every blank-separated word, and for each row the index of its first word (one more at the end)."""
    starts, ends, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], len(data)
    for lo in range(0, n, PART):
        hi = min(n, lo + PART)
        solid = ~BLANK[data[lo:hi]]
        edge = np.zeros(hi - lo + 1, dtype=bool)
        edge[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo] = True
        before, after = np.r_[lo > 0 and not BLANK[data[lo - 1]], solid[:-1]], np.r_[solid[1:], hi < n and not BLANK[data[min(hi, n - 1)]]]
        starts.append(np.flatnonzero(solid & (~before | edge[:-1])) + lo)
        ends.append(np.flatnonzero(solid & (~after | edge[1:])) + lo + 1)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def long_sum(data: np.ndarray, signs: np.ndarray | None) -> np.uint64:
    """The polynomial sum of all the bytes, part by part."""
    total, scale, up = 0, 1, powers(PIECE)[0]
    for lo in range(0, len(data), PIECE):
        part = data[lo : lo + PIECE] if signs is None else signs[data[lo : lo + PIECE]]
        total += int(((part.astype(U) + U(1)) * up[: len(part)]).sum(dtype=U)) * scale
        scale = scale * pow(int(BASE), len(part), 1 << 64) % 2**64
    return U(total % 2**64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, signs: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, or of what signs makes of them; spans are in order and don't overlap."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        if hi - lo > PIECE:  # one huge span
            out[at] = mix(np.array([long_sum(data[lo:hi], signs)]) + U(hi - lo))[0]
            at = to
            continue
        up, down = powers(hi - lo)
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum(((data[lo:hi] if signs is None else signs[data[lo:hi]]).astype(U) + U(1)) * up[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
        at = to
    return out


def word_hashes(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a string column (A-Z as a-z), and for each row the index of its first word (one more at the end)."""
    data, offsets = utf8(col)
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends, LOWER if lower else None), first


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence where it is shorter; none of no words. Order and repeats stay."""
    m = min(k, len(words))
    if not m:
        return words
    n = len(words) - m + 1
    out = np.zeros(n, U)
    for i in range(0, n, PIECE):
        part = out[i : i + PIECE]
        for j in range(m):
            part = (part ^ words[i + j : i + j + len(part)]) * MIX1 + U(j + 1)
            part ^= part >> U(29)
        out[i : i + PIECE] = mix(part + U(m))
    return out
