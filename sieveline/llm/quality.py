"""Quality classifier from weak labels.

Eight heuristic labellers look at every document; each says bad, good, or nothing. A latent class model is fitted by
expectation-maximisation to the counts of all vote patterns, 3 to the power of 8 at most, over the whole table: it
estimates how often each labeller speaks and errs, without any given label. As bad texts seldom have two kinds of faults,
the bad class is made of one part for each labeller, of texts that have its fault, so that it says bad of them; all else
is estimated, without bounds: the share of every part, and how often every labeller gives which vote in the good class (its
false alarms) and in every part. The posterior of a document's pattern is the soft label on which a linear scorer over
hashed features of word shapes is trained, from a sample of SAMPLE documents at most, of any length. The scorer then rates
every document's whole text.

Edge cases: a null, empty or blank text has quality 0 and is rejected. A text of any length is read whole. Equal texts
have equal scores. If no labeller ever says bad, all texts with words pass. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as kn
from .common import Scratch, prepare, table

U = np.uint64
SAMPLE = 6000
BITS = 12
KEEP_FROM = 0.5
#: Words of a text that are worked on at once.
AT_ONCE = 1 << 18
#: Added to the number of words, so that a few words alone can't make a large share.
PRIOR_WORDS = 10
#: Where expectation-maximisation begins: the votes of the good class, those of other labellers on a fault, the shares.
BEGIN_GOOD, BEGIN_OTHER, BEGIN_BAD = (0.15, 0.84, 0.01), (0.2, 0.7, 0.1), 0.2
ABSTAIN, GOOD, BAD = 0, 1, 2
#: Each labeller's measure is a share; at the first value or less it says good, at the second or more it says bad.
LABELLERS = {
    "capitals": (0.20, 0.50), "symbols": (0.010, 0.035), "stutter": (0.05, 0.15), "bars": (0.04, 0.15),
    "shouting": (0.05, 0.30), "junk_ends": (0.08, 0.30), "no_letters": (0.10, 0.25), "runs": (0.02, 0.10),
}

UPPER, LETTER, SYMBOL, BANG = (np.zeros(256, np.uint8) for _ in range(4))
UPPER[65:91] = 1
LETTER[65:91] = LETTER[97:123] = 1
SYMBOL[list(b"#%&$*@^~=<>{}[]\\_+|")] = 1
BANG[ord("!")] = 1
#: Word shapes: capitals as A, other letters and all bytes of non-ASCII ones as a, digits as 9, the rest as it is.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:] = ord("A"), ord("a"), ord("9"), ord("a")
JUNK = (SYMBOL > 0) | (BANG > 0)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over the rows that offsets cut."""
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def byte_counts(kind: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of a kind each row has."""
    upto, before = np.zeros(len(offsets), np.int64), 0
    for lo in range(0, len(data), kn.PART):
        part = np.r_[0, np.cumsum(kind[data[lo : lo + kn.PART]], dtype=np.int32)]
        i, j = np.searchsorted(offsets, lo), np.searchsorted(offsets, lo + kn.PART, "right")
        upto[i:j] = before + part[offsets[i:j] - lo]
        before += int(part[-1])
    return np.diff(upto)


def measures(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every labeller's share for each text (rows) and the number of words."""
    data, offsets = kn.utf8(col)
    starts, ends, first = kn.word_spans(data, offsets)
    hashes = kn.span_hashes(data, starts, ends, kn.LOWER)
    n = np.diff(first)
    size, count = np.diff(offsets) + 50, n + PRIOR_WORDS
    same = np.r_[False, hashes[1:] == hashes[:-1]]
    same[first[:-1][n > 0]] = False
    shouts, plain = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    for i in range(0, len(starts), AT_ONCE):
        s, e = starts[i : i + AT_ONCE], ends[i : i + AT_ONCE]
        part = data[s[0] : e[-1]]
        letters, bangs = (np.r_[0, np.cumsum(x, dtype=np.int32)] for x in (LETTER[part] | (part >= 128), BANG[part]))
        s, e = s - starts[i], e - starts[i]
        shouts[i : i + AT_ONCE], plain[i : i + AT_ONCE] = bangs[e] - bangs[s] >= 2, letters[e] == letters[s]
    upper, latin, signs = (byte_counts(x, data, offsets) for x in (UPPER, LETTER, SYMBOL))
    again = same & np.r_[False, same[:-1]]
    shares = [
        upper / (latin + 20), signs / size, sums(same, first) / count, sums((ends - starts == 1) & (data[starts] == ord("|")), first) / count,
        sums(shouts, first) / count, sums(JUNK[data[ends - 1]], first) / count, sums(plain, first) / count, sums(again, first) / count,
    ]
    return np.stack(shares, axis=1), n


def votes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One number a text, whose digits to base 3 are the votes; -1 where it has no words. And the number of words."""
    got, n = measures(col)
    low, high = (np.array([x[i] for x in LABELLERS.values()]) for i in (0, 1))
    vote = np.where(got >= high, BAD, np.where(got <= low, GOOD, ABSTAIN))
    return np.where(n > 0, vote @ 3 ** np.arange(len(LABELLERS)), -1), n


def features(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed shapes of words, pairs of them, and words that repeat the one before: buckets and their weights, by text."""
    data, offsets = kn.utf8(col)
    starts, ends, first = kn.word_spans(data, offsets)
    words, shapes = kn.span_hashes(data, starts, ends, kn.LOWER), np.empty(len(starts), U)
    for i in range(0, len(starts), AT_ONCE):
        s, e = starts[i : i + AT_ONCE] - starts[i], ends[i : i + AT_ONCE] - starts[i]
        shape = SHAPE[data[starts[i] : starts[i] + e[-1]]]
        keep = np.r_[True, shape[1:] != shape[:-1]]
        keep[s] = True
        at = np.r_[0, np.cumsum(keep)]
        shapes[i : i + AT_ONCE] = kn.span_hashes(shape[keep], at[s], at[e])
    out, again = [], int(kn.mix(np.full(1, U(77)))[0] >> U(64 - BITS))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        counts = np.zeros(1 << BITS, np.int64)
        for i in range(a, b, AT_ONCE):
            s = shapes[i : min(b, i + AT_ONCE + 1)]  # with the one that the last pair ends in
            pairs = kn.mix(s[1:] * kn.MIX1 + s[:-1])
            counts += np.bincount((np.concatenate([s[:AT_ONCE], pairs]) >> U(64 - BITS)).astype(np.int64), minlength=1 << BITS)
            counts[again] += (words[i + 1 : min(b, i + AT_ONCE + 1)] == words[i : min(b - 1, i + AT_ONCE)]).sum()
        bucket = np.flatnonzero(counts)
        out.append((bucket, np.sqrt(counts[bucket] / max(1, b - a))))
    return out


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of bad for every pattern (rows of votes), and P(vote | class) by labeller, class (good, bad) and vote."""
    m, bad = patterns.shape[1], patterns == BAD
    fired = np.flatnonzero(bad.any(axis=0))  # a labeller that never says bad has no part
    theta = np.stack([np.tile(BEGIN_GOOD, (m, 1)), *np.tile(BEGIN_OTHER, (len(fired), m, 1))])
    theta[np.arange(len(fired)) + 1, fired] = np.array([0.0, 0.0, 1.0])
    begin = theta.copy()
    share = np.r_[1 - BEGIN_BAD if len(fired) else 1.0, np.full(len(fired), BEGIN_BAD / max(1, len(fired)))]
    may, onehot, post = np.concatenate([np.ones((len(patterns), 1), bool), bad[:, fired]], axis=1), np.eye(3)[patterns], np.zeros(len(patterns))
    for _ in range(rounds):
        logp = np.where(may, np.log(share) + np.einsum("pmv,cmv->pc", onehot, np.log(np.maximum(theta, 1e-300))), -np.inf)
        both = np.exp(logp - logp.max(axis=1, keepdims=True))
        both /= both.sum(axis=1, keepdims=True)
        old, post = post, 1 - both[:, 0]
        if np.abs(post - old).max(initial=0) < 1e-10:
            break
        weight = both * counts[:, None]
        share = (weight.sum(axis=0) + 1) / (counts.sum() + len(share))
        theta = np.einsum("pc,pmv->cmv", weight, onehot) + begin  # one document's worth of what it began with
        theta /= theta.sum(axis=2, keepdims=True)
    parts = share[1:, None, None] * theta[1:]
    return post, np.stack([theta[0], parts.sum(axis=0) / max(share[1:].sum(), 1e-300)], axis=1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels (1 is bad) by Adam over all rows at once."""
    w, b, dim = np.zeros(1 << BITS), 0.0, 1 << BITS
    if not rows:
        return w, b
    owner = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    index, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
    m, v, mb, vb = np.zeros(dim), np.zeros(dim), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(owner, value * w[index], len(rows)) + b)))
        d = (p - labels) / len(rows)
        g, gb = np.bincount(index, value * d[owner], dim) + 1e-5 * w, d.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w, b = w - 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-9), b - 0.1 * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, float(b)


def voter(batches):
    for whole in batches:
        for batch in kn.slices(whole, 1):
            pattern, n = votes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pattern), pa.array(n.astype(np.int64))], names=["doc_id", "pattern", "n_words"])


def featurer(batches):
    for whole in batches:
        for batch in kn.slices(whole, 1):
            got = features(batch.column(1))
            pattern, _ = votes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pattern), pa.array([i.astype(np.int16).tobytes() for i, _ in got], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in got], pa.binary())], names=["draw", "pattern", "i", "x"])


def judged(texts: pa.Array, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pattern of votes, number of words and score of each text."""
    pattern, n = votes(texts)
    z = np.array([x @ w[i] + b for i, x in features(texts)])
    return pattern, n, np.where(n > 0, 1 / (1 + np.exp(z)), 0.0)


def scorer(w: np.ndarray, b: float, posts: dict[int, float]):
    def run(batches):
        for whole in batches:
            for batch in kn.slices(whole, 1):
                pattern, n, score = judged(batch.column(1), w, b)
                weak = np.array([1 - posts.get(int(p), 1.0) for p in pattern])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n.astype(np.int64)), pa.array(np.round(weak, 6)), pa.array(np.round(score, 6)), pa.array(score >= KEEP_FROM)], names=["doc_id", "n_words", "weak_quality", "quality", "keep"]
                )

    return run


def keeper(w: np.ndarray, b: float, text: int):
    """Rows of any columns to those whose text is kept."""

    def run(batches):
        for whole in batches:
            for batch in kn.slices(whole, text):
                yield batch.filter(pa.array(judged(batch.column(text), w, b)[2] >= KEEP_FROM))

    return run


def train(docs: DataFrame) -> tuple[np.ndarray, float, dict[int, float], np.ndarray]:
    """Weights and bias of the scorer, the posterior of bad by pattern, and the labellers' probabilities."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = docs.mapInArrow(voter, "doc_id long, pattern long, n_words long").groupBy("pattern").count().collect()  # 3 ** 8 + 1 rows at most
    counted = sorted((r.pattern, r["count"]) for r in counted)
    total = sum(c for _, c in counted)
    known = [(p, c) for p, c in counted if p >= 0]
    digits = np.array([[p // 3**j % 3 for j in range(len(LABELLERS))] for p, _ in known], int).reshape(len(known), len(LABELLERS))
    post, theta = em(digits, np.array([c for _, c in known], float))
    posts = {p: float(x) for (p, _), x in zip(known, post)}
    share = min(1.0, SAMPLE / max(1, total))
    drawn = docs.select(F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(1 << 40)).alias("draw"), "text").where(F.col("draw") < int(min(1.0, 1.3 * share) * (1 << 40)))
    some = drawn.mapInArrow(featurer, "draw long, pattern long, i binary, x binary").where("pattern >= 0")
    some = some.orderBy("draw", "pattern", "i", "x").limit(SAMPLE).collect()  # 1 << BITS features a document at most
    rows = [(np.frombuffer(r.i, np.int16).astype(int), np.frombuffer(r.x, np.float32).astype(float)) for r in some]
    w, b = fit(rows, np.array([posts[r.pattern] for r in some]))
    return w, b, posts, theta


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, weak_quality, quality, keep) of every document."""
    prepare(docs.sparkSession)
    w, b, posts, _ = train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scorer(w, b, posts), "doc_id long, n_words long, weak_quality double, quality double, keep boolean")


def kept(docs: DataFrame) -> DataFrame:
    """The documents that score() keeps, all columns; a row is decided by its own text, whatever its id."""
    prepare(docs.sparkSession)
    w, b, _, _ = train(docs)
    return docs.mapInArrow(keeper(w, b, docs.columns.index("text")), docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
