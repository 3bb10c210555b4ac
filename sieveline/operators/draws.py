"""Drawn units of bootstrap replicates, many at a time: the first word of md5(seed-boot-j) over arrays of j."""

from __future__ import annotations

from math import sin

import numpy as np

#: Hashes in flight: a few arrays of this length stay in a core's cache, and calls cost little beside them.
CHUNK = 32768
SINE = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _words(prefix: bytes, first: int, end: int) -> list[int | np.ndarray]:
    """The 16 words of the md5 block of prefix + str(j) for first <= j < end, which have as many digits; a number where all
    have the same word."""
    digits, at = len(str(first)), len(prefix)
    block = bytearray(64)
    block[:at], block[at + digits] = prefix, 0x80
    block[56:64] = (8 * (at + digits)).to_bytes(8, "little")
    words: list = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
    rest = np.arange(first, end, dtype=np.uint32)
    for k in range(digits - 1, -1, -1):
        higher = rest // np.uint32(10)
        digit = (rest - higher * np.uint32(10) + np.uint32(48)) << np.uint32(8 * ((at + k) % 4))
        i, rest = (at + k) // 4, higher
        words[i] = digit + np.uint32(words[i]) if isinstance(words[i], int) else words[i] + digit
    return words


def heads(prefix: bytes, first: int, end: int) -> np.ndarray:
    """The first four bytes of md5(prefix + str(j)), as a big-endian number, for first <= j < end of as many digits."""
    m, words = end - first, _words(prefix, first, end)
    a, b, c, d = (np.full(m, x, np.uint32) for x in START)
    f, t = np.empty(m, np.uint32), np.empty(m, np.uint32)
    for i in range(61):  # the later steps don't reach the first word
        turn = i // 16
        if turn < 2:
            x, y, z = (b, c, d) if turn == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16]
        np.add(f, a, out=f)
        if isinstance(word, int):
            np.add(f, np.uint32((word + SINE[i]) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, np.uint32(SINE[i]), out=f)
            np.add(f, word, out=f)
        s = TURN[turn][i % 4]
        np.right_shift(f, np.uint32(32 - s), out=t)
        np.left_shift(f, np.uint32(s), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(START[0])).byteswap()


def counts(seed: int, boot: int, n: int) -> np.ndarray:
    """How often each of n units is drawn in n draws of a replicate."""
    prefix, drawn, first = f"{seed}-{boot}-".encode(), np.empty(n, np.int64), 0
    while first < n:
        end = min(n, first + CHUNK, 10 ** len(str(first)))
        h = heads(prefix, first, end)
        drawn[first:end] = h - h // np.uint32(n) * np.uint32(n)
        first = end
    return np.bincount(drawn, minlength=n)
