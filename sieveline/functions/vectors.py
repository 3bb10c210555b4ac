"""Column functions over arrays: vector arithmetic, softmax, argmax, bit codes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column, eps: float = 1e-12) -> Column:
    """a / (|a| + eps). The norm is bound once, not once for each element."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x / (n + eps)))[0]


def softmax(z: Column, temperature: float | Column = 1.0) -> Column:
    scaled = F.transform(z, lambda x: x / temperature)
    top = F.array_max(scaled)
    e = F.transform(scaled, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def log_sum_exp(z: Column) -> Column:
    top = F.array_max(z)
    return top + F.ln(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def log_softmax(z: Column) -> Column:
    return F.transform(F.array(log_sum_exp(z)), lambda m: F.transform(z, lambda x: x - m))[0]


def confidence(z: Column, temperature: float | Column = 1.0) -> Column:
    """The largest softmax probability, 1 / sum(exp((z - max) / T))."""
    top = F.array_max(z)
    return 1.0 / F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp((x - top) / temperature))


def argmax(z: Column) -> Column:
    """Position of the first maximum, from 0."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pack_bits(bits: Column, width: int = 64) -> Column:
    """An array of booleans as a BIGINT pattern, first bit highest, zeros behind."""
    code = F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("bigint")))
    return F.call_function("shiftleft", code, (F.lit(width) - F.size(bits)).cast("int"))


def phash_bits(coefficients: Column) -> Column:
    """Which of the coefficients are larger than their median, the middle one of an odd number."""
    ordered = F.array_sort(coefficients)
    middle = F.element_at(ordered, ((F.size(coefficients) + 1) / 2).cast("int"))
    return F.transform(F.array(middle), lambda m: F.transform(coefficients, lambda x: x > m))[0]


def dct_low(grid: list[list[float]] | None = None, n: int = 32, keep: int = 8):
    """The orthonormal DCT-II matrix of size n, first `keep` rows, as literals for products with array columns."""
    from math import cos, pi, sqrt

    return [[(sqrt(1 / n) if k == 0 else sqrt(2 / n)) * cos(pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(keep)]


def phash_coefficients(gray: Column, n: int = 32, keep: int = 8) -> Column:
    """The keep * keep low-frequency DCT coefficients, without the constant one, of a flat n * n array of gray values."""
    m = F.array(*[F.array(*[F.lit(x) for x in row]) for row in dct_low(n=n, keep=keep)])
    rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.slice(gray, r * n + 1, n))
    half = F.transform(rows, lambda row: F.transform(m, lambda basis: dot(row, basis)))  # [n][keep]
    cell = lambda u, v: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, i: s + F.get(F.get(half, i), v) * F.get(F.get(m, u), i))
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda u: F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda v: cell(u, v))))
    return F.slice(flat, 2, keep * keep - 1)


def dhash(gray: Column, width: int = 9, height: int = 8) -> Column:
    """64 comparisons of horizontal neighbours in a flat height * width array of gray values, packed."""
    bits = F.flatten(
        F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.transform(F.sequence(F.lit(1), F.lit(width - 1)), lambda c: F.get(gray, r * width + c) > F.get(gray, r * width + c - 1)))
    )
    return pack_bits(bits)


def top_k(z: Column, k: int) -> Column:
    """The k largest as structs (i, p), larger first, ties by position."""
    pairs = F.transform(z, lambda p, i: F.struct((-p).alias("o"), i.alias("i"), p.alias("p")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct(s["i"].alias("i"), s["p"].alias("p")))


def uncertain(conf: Column, theta: float | Column) -> Column:
    """Strictly below the threshold; equality is accepted."""
    return conf < theta


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def learning_rate(step: Column, warmup: int, total: int, base: float) -> Column:
    """Linear warm-up, then a half cosine."""
    done = (step - warmup) / F.greatest(F.lit(1), F.lit(total - warmup))
    return F.when(step < warmup, base * (step + 1) / max(1, warmup)).otherwise(0.5 * base * (1 + F.cos(F.lit(3.141592653589793) * done)))


def row_profile(gray: Column, width: int) -> Column:
    """Mean and population deviation of every row of a flat array of gray values."""
    starts = F.sequence(F.lit(1), F.size(gray), F.lit(width))
    rows = F.transform(starts, lambda s: F.slice(gray, s, width))
    mean = lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x) / width
    square = lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x * x) / width
    return F.transform(rows, lambda r: F.struct(mean(r).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square(r) - mean(r) * mean(r))).alias("std")))


def is_gray(r: Column, g: Column, b: Column, tolerance: int = 2) -> Column:
    """Whether the channels of all pixels differ by no more than the tolerance."""
    spread = F.zip_with(F.zip_with(r, g, lambda x, y: F.struct(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))), b, lambda s, z: F.greatest(s["hi"], z) - F.least(s["lo"], z))
    return F.forall(spread, lambda d: d <= tolerance)
