"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are of documents; tokens are labelled from them. A unit is a word, without signs at its ends, or one of its
beginnings of PREFIXES code points. A unit that sets toxic training documents apart (log odds ratio LIFT at least, signed
root of the likelihood ratio Z at least) marks the words of toxic documents that have it. Units are counted over all
training documents where they lie; the field is trained on segments of WORDS words drawn from them.
The field has two labels; its features are the hashed units of a word and its neighbours. For a text, forward-backward
gives every word's probability of being toxic; the document's score is a logistic function, fitted on the training
documents, of the log of the sum of the words' odds. Runs of words with p of a half or more are the offending spans.

Training documents are SAMPLE at most of either label, drawn by a hash of the id whatever their length; of near copies
among them only one counts. The driver sees UNITS units, SEGMENTS segments and two numbers a document at most.

Both passes of forward-backward work on all texts of a batch as one chain that starts anew with each text: products of
the step matrices of many blocks at once, a short pass over blocks, then all blocks at once again; a long chain goes
through this part by part.

Edge cases: null, empty and blank texts have no words and the lowest score there is. Labels that are null are not used;
a doc_id that has several labels counts as toxic if one of them says so; a row without a doc_id is scored, but has no
label. Without training documents of both labels every score is 0. Texts of any length are read whole, for training too.
Extra columns, and those of clashing names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as kn
from .common import Scratch, prepare, table

U = np.uint64
SAMPLE = 5000
SEGMENTS, WORDS, UNITS = 4000, 64, 100_000
PREFIXES = (3, 4, 6)
#: Size of the table, in bits, in which the features that have a weight are looked up.
BITS = 22
LIFT, Z = 2.0, 3.4
THRESHOLD = 0.7
ROUNDS = 60
ODDS = 0.05
#: Penalties on the squared weights of a word's units and of its neighbours, in training.
PENALTY = (0.02, 2.0)
#: Words whose features are held at once.
AT_ONCE = 1 << 18
SIGN = np.zeros(256, bool)
SIGN[list(range(33, 48)) + list(range(58, 65)) + list(range(91, 97)) + list(range(123, 127))] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3 == 1, F.lit(False))


class Words:
    """The words of a string column without signs at their ends (a word of signs only is its last): bytes, first word of each
    row, start and end bytes, row offsets, and hashes."""

    def __init__(self, col: pa.Array):
        self.data, self.offsets = kn.utf8(col)
        self.s, self.e, self.first = kn.word_spans(self.data, self.offsets)
        for i in range(0, len(self.s), AT_ONCE):
            self.strip(self.s[i : i + AT_ONCE], self.e[i : i + AT_ONCE])
        self.hashes = self.spans(self.s, self.e)

    def strip(self, s: np.ndarray, e: np.ndarray) -> None:
        """Take the signs off both ends of these words, in place."""
        lo = int(s[0])
        plain = np.flatnonzero(~SIGN[self.data[lo : e[-1]]]) + lo
        if not len(plain):
            s[:] = e - 1
            return
        begin = plain[np.minimum(np.searchsorted(plain, s), len(plain) - 1)]
        end = plain[np.searchsorted(plain, e) - 1] + 1
        some = (begin >= s) & (begin < e)
        s[:], e[:] = np.where(some, begin, e - 1), np.where(some, end, e)

    def spans(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return kn.span_hashes(self.data, s, e, kn.LOWER)

    def heads(self, lo: int, hi: int) -> np.ndarray:
        """Where code points begin from byte lo to hi."""
        return np.flatnonzero((self.data[lo:hi] & 0xC0) != 0x80) + lo

    def points(self, at: np.ndarray) -> np.ndarray:
        """How many code points begin before each of these bytes."""
        out, before = np.zeros(len(at), np.int64), 0
        for lo in range(0, len(self.data), kn.PART):
            heads = self.heads(lo, min(len(self.data), lo + kn.PART))
            here = at > lo
            out[here] = before + np.searchsorted(heads, at[here])
            before += len(heads)
        return out

    def units(self, i: int, j: int) -> np.ndarray:
        """Hashes of the words i to j and of their beginnings (rows); 0 where a word is no longer than the beginning."""
        s, e = self.s[i:j], self.e[i:j]
        heads = self.heads(int(s[0]), int(e[-1])) if j > i else s
        at, stop = np.searchsorted(heads, s), np.searchsorted(heads, e)
        out = [kn.mix(self.hashes[i:j])]
        for c in PREFIXES:
            longer = stop - at > c
            upto = np.where(longer, heads[np.minimum(at + c, len(heads) - 1)], e) if len(heads) else e
            out.append(np.where(longer, kn.mix(self.spans(s, upto) + U(c)), U(0)))
        return np.stack(out)

    def neighbours(self, i: int, j: int) -> np.ndarray:
        """Hashed features of the words before and after the words i to j; 0 at the ends of a text."""
        n, edge = len(self.hashes), np.zeros(j - i + 1, bool)
        at = self.first[(self.first >= i) & (self.first <= j)] - i
        edge[at] = True
        before, after = np.r_[self.hashes[max(i - 1, 0) : i], self.hashes[i : j - 1]], np.r_[self.hashes[i + 1 : j], self.hashes[j : j + 1]]
        before, after = (np.r_[U(0), before] if len(before) < j - i else before), (np.r_[after, U(0)] if len(after) < j - i else after)
        end = edge[1:].copy()
        end[-1] |= j == n
        return np.stack([np.where(edge[:-1], U(0), kn.mix(before + U(101))), np.where(end, U(0), kn.mix(after + U(102)))])

    def features(self, i: int, j: int) -> np.ndarray:
        return np.concatenate([self.units(i, j), self.neighbours(i, j)]) if j > i else np.zeros((len(PREFIXES) + 3, 0), U)


def chain(step: np.ndarray, r: float = 1.0) -> np.ndarray:
    """step[2, 2, n]: ratios r_t = (m00 r + m01) / (m10 r + m11) along the chain, from r."""
    n = step.shape[2]
    if not n:
        return np.zeros(0)
    length = max(1, int(np.sqrt(n)) // 2)
    blocks = -(-n // length)
    pad = np.zeros((2, 2, blocks * length))
    pad[0, 0], pad[1, 1] = 1.0, 1.0
    pad[:, :, :n] = step
    m = np.ascontiguousarray(pad.reshape(2, 2, blocks, length).transpose(3, 0, 1, 2))
    a, b, c, d = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for i in range(length):
        w, x, y, z = m[i, 0, 0], m[i, 0, 1], m[i, 1, 0], m[i, 1, 1]
        a, b, c, d = w * a + x * c, w * b + x * d, y * a + z * c, y * b + z * d
        s = a + b + c + d
        a, b, c, d = a / s, b / s, c / s, d / s
    enter = np.empty(blocks)
    for i, (p, q, s, t) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        enter[i] = r
        r = (p * r + q) / (s * r + t)
    out, r = np.empty((length, blocks)), enter
    for i in range(length):
        r = (m[i, 0, 0] * r + m[i, 0, 1]) / (m[i, 1, 0] * r + m[i, 1, 1])
        out[i] = r
    return out.T.ravel()[:n]


class Field:
    """Weights of a chain of two labels: by hashed feature, the four transitions (from, to) and the two starts."""

    def __init__(self):
        self.keys, self.w, self.table = np.zeros(0, U), np.zeros(1), np.zeros(1 << BITS, np.int32)
        self.bias, self.jump, self.start = -2.0, np.zeros((2, 2)), np.zeros(2)

    def put(self, keys: np.ndarray, weights: np.ndarray) -> None:
        """Features with their weights. Of those that share a place in the table, the one of the largest weight stays."""
        order = np.argsort(np.abs(weights), kind="stable")
        self.keys, self.w = np.r_[U(0), keys[order]], np.r_[0.0, weights[order]]
        self.table[:] = 0
        self.table[(self.keys[1:] >> U(64 - BITS)).astype(np.int64)] = np.arange(1, len(self.keys), dtype=np.int32)

    def emission(self, feats: np.ndarray) -> np.ndarray:
        total = np.zeros(feats.shape[1])
        for f in feats:
            at = self.table[(f >> U(64 - BITS)).astype(np.int64)]
            hit = np.flatnonzero(at)
            hit = hit[self.keys[at[hit]] == f[hit]]
            total[hit] += self.w[at[hit]]
        return total

    def emissions(self, words: Words) -> np.ndarray:
        """The sums of the weights of all words' features."""
        n = len(words.hashes)
        out = np.empty(n)
        for i in range(0, n, AT_ONCE):
            out[i : i + AT_ONCE] = self.emission(words.features(i, min(n, i + AT_ONCE)))
        return out

    def ratios(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward ratios of toxic to clean of every word, part by part."""
        n = len(emission)
        begins = np.zeros(n + 1, bool)
        begins[first[:-1][np.diff(first) > 0]] = True
        begins[n] = True
        t, s = np.exp(self.jump), np.exp(self.start)
        alpha, beta, r = np.empty(n), np.empty(n), 1.0
        for i in range(0, n, AT_ONCE):
            j = min(n, i + AT_ONCE)
            psi, on = np.exp(np.clip(emission[i:j] + self.bias, -30, 30)), begins[i:j]
            step = np.array([[psi * t[1, 1], psi * t[0, 1]], np.broadcast_to([[t[1, 0]], [t[0, 0]]], (2, j - i))])
            step[:, :, on] = np.array([[0 * psi, psi * s[1]], [0 * psi, np.full(j - i, s[0])]])[:, :, on]
            alpha[i:j] = chain(step, r)
            r = float(alpha[j - 1])
        r = 1.0
        for j in range(n, 0, -AT_ONCE):
            i = max(0, j - AT_ONCE)
            nxt = np.exp(np.clip(np.r_[emission[i + 1 : j], emission[j : j + 1] if j < n else 0.0] + self.bias, -30, 30))
            step = np.array([[nxt * t[1, 1], np.full(j - i, t[1, 0])], [nxt * t[0, 1], np.full(j - i, t[0, 0])]])
            step[:, :, begins[i + 1 : j + 1]] = np.array([[0.0, 1.0], [0.0, 1.0]])[:, :, None]
            beta[i:j] = chain(step[:, :, ::-1], r)[::-1]
            r = float(beta[i])
        return alpha, beta

    def marginals(self, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(toxic) of every word, from the sums of its features' weights."""
        if not len(emission):
            return np.zeros(0)
        odds, beta = self.ratios(emission, first)
        odds *= beta
        return np.divide(odds, np.add(odds, 1, out=beta), out=beta)

    def pairs(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of every word, and P(label before, label) of it, [2, 2, n]."""
        alpha, beta = self.ratios(emission, first)
        psi, t = np.exp(np.clip(emission + self.bias, -30, 30)), np.exp(self.jump)
        before = np.r_[1.0, alpha[:-1]]
        pair = np.array([[np.full(len(psi), t[0, 0]), t[0, 1] * psi * beta], [before * t[1, 0], before * t[1, 1] * psi * beta]])
        pair /= pair.sum(axis=(0, 1))
        pair[:, :, first[:-1][np.diff(first) > 0]] = 0
        return alpha * beta / (1 + alpha * beta), pair


def train_field(feats: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Field:
    """Gradient ascent (Adam) on the conditional likelihood of all labels at once."""
    f, n = Field(), max(1, feats.shape[1])
    begins = first[:-1][np.diff(first) > 0]
    y = labels.astype(float)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:-1], labels[1:]), 1.0)
    np.subtract.at(seen, (labels[begins[1:] - 1], labels[begins[1:]]), 1.0)
    starts = np.array([(1 - y[begins]).sum(), y[begins].sum()])
    used, back = np.unique(feats, return_inverse=True)
    back = back.reshape(feats.shape)
    dense, penalty = np.zeros(len(used)), np.full(len(used), PENALTY[1])
    penalty[back[:-2].ravel()] = PENALTY[0]
    dense_of = used != 0  # 0 stands for no feature
    state = [np.zeros(len(used) + 7), np.zeros(len(used) + 7)]
    scale = max(1.0, y.sum())
    for t in range(1, ROUNDS + 1):
        p, pair = f.pairs(dense[back].sum(axis=0), first)
        d = y - p
        g = np.concatenate([
            sum(np.bincount(b, d, len(used)) for b in back) - penalty * dense, [d.sum()], (seen - pair.sum(axis=2)).ravel(), starts - np.array([(1 - p[begins]).sum(), p[begins].sum()])
        ]) / scale
        state[0], state[1] = 0.9 * state[0] + 0.1 * g, 0.99 * state[1] + 0.01 * g * g
        step = 0.3 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-6)
        dense += step[: len(used)] * dense_of
        f.bias += step[len(used)]
        f.jump += step[len(used) + 1 : len(used) + 5].reshape(2, 2)
        f.start += step[len(used) + 5 :]
    heavy = np.abs(dense) > 0.02
    f.put(used[heavy], dense[heavy])
    return f


def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the log of the sum of the odds p / (1 - p) of its words, those under ODDS left out."""
    odds = p / np.maximum(1 - p, 1e-6)
    total = np.r_[0, np.cumsum(np.where(odds >= ODDS, odds, 0))]
    return np.log(np.maximum(total[first[1:]] - total[first[:-1]], 0) + ODDS)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by damped Newton steps; the slope is not negative."""
    centre, spread = x.mean(), x.std() + 1e-9
    z, ab = np.stack([(x - centre) / spread, np.ones(len(x))]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(ab @ z, -30, 30)))
        h = (z * (p * (1 - p))) @ z.T + 0.5 * np.eye(2)
        ab = ab + np.linalg.solve(h, z @ (y - p) - 0.5 * ab)
    a = max(0.0, ab[0]) / spread
    return a, float(ab[1] - a * centre)


class Model:
    """A trained field, without its table, and the logistic function of documents."""

    def __init__(self, field: Field, slope: float, intercept: float):
        self.keys, self.weights, self.slope, self.intercept = field.keys[1:], field.w[1:], slope, intercept
        self.rest = (field.bias, field.jump, field.start)

    def field(self) -> Field:
        f = Field()
        f.put(self.keys, self.weights)
        f.bias, f.jump, f.start = self.rest
        return f


def sketcher(batches):
    """(text, toxic) with two minimum hashes of the text's shingles of three words."""
    for whole in batches:
        for batch in kn.slices(whole, 0):
            w = Words(batch.column(0))
            low = []
            for a, b in zip(w.first[:-1], w.first[1:]):
                x = kn.shingles(w.hashes[a:b], 3)
                low.append([int(kn.mix(x ^ U(salt)).min().astype(np.int64)) if len(x) else 0 for salt in (1, 2)])
            m, n = (pa.array([v[i] for v in low], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([m, n, *batch.columns], names=["m", "n", "text", "toxic"])


def unit_counter(batches):
    """(text, toxic) to (unit, bad, good): in how many toxic and clean documents each unit is, for some documents at a time."""
    held, size = [], 0

    def out():
        unit, back = np.unique(np.concatenate([u for u, _ in held]), return_inverse=True)
        toxic = np.repeat([t for _, t in held], [len(u) for u, _ in held])
        bad, good = (np.bincount(back, toxic == t, len(unit)).astype(np.int64) for t in (1, 0))
        return pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.array(bad), pa.array(good)], names=["unit", "bad", "good"])

    for whole in batches:
        for batch in kn.slices(whole, 0):
            w, toxic = Words(batch.column(0)), batch.column(1).to_pylist()
            for t, a, b in zip(toxic, w.first[:-1].tolist(), w.first[1:].tolist()):
                u = np.unique(np.concatenate([np.zeros(1, U), *(np.unique(w.units(i, min(b, i + AT_ONCE))) for i in range(a, b, AT_ONCE))]))
                held.append((u[1:], t))
                size += len(u)
            if size > 1 << 20:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def cutter(marks: np.ndarray):
    """(text, toxic) to segments (draw, labelled, features, labels): a word of a toxic text is labelled if a unit of it is marked."""

    def run(batches):
        for whole in batches:
            for batch in kn.slices(whole, 0):
                w, toxic = Words(batch.column(0)), batch.column(1).to_pylist()
                rows = []
                for t, a, b in zip(toxic, w.first[:-1].tolist(), w.first[1:].tolist()):
                    for i in range(a, b, AT_ONCE):
                        f = w.features(i, min(b, i + AT_ONCE))
                        on = np.isin(f[: 1 + len(PREFIXES)], marks).any(axis=0) & (t > 0)
                        for j in range(0, f.shape[1], WORDS):
                            part, y = f[:, j : j + WORDS], on[j : j + WORDS]
                            rows.append((int(kn.mix(np.bitwise_xor.reduce(kn.mix(part[0] + U(7)), keepdims=True))[0] >> U(1)), bool(y.any()), part.tobytes(), y.astype(np.uint8).tobytes()))
                        if len(rows) * WORDS >= AT_ONCE:
                            yield out(rows)
                            rows = []
                if rows:
                    yield out(rows)

    def out(rows):
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.bool_(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["draw", "labelled", "features", "labels"])

    return run


def weigher(field: Field):
    """(text, toxic) to (x, toxic): the evidence of each text."""

    def run(batches):
        for whole in batches:
            for batch in kn.slices(whole, 0):
                w = Words(batch.column(0))
                x = evidence(field.marginals(field.emissions(w), w.first), w.first)
                yield pa.RecordBatch.from_arrays([pa.array(x), batch.column(1).cast(pa.int32())], names=["x", "toxic"])

    return run


def training_texts(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame | None:
    """(text, toxic) of the training documents; of those whose sketches meet, the one of the smallest text hash."""
    ids = labels.select(F.col("doc_id").cast("long").alias("id"), "toxic").where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
    ids = ids.where(~held_out(F.col("id")))
    n = {r.toxic: r["count"] for r in ids.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    drawn, some = F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(1 << 40)), None
    for y in (0, 1):
        one = ids.where((F.col("toxic") == y) & (drawn < int(min(1.0, 1.3 * sample / n[y]) * (1 << 40)))).orderBy(drawn, "id").limit(sample)
        some = one if some is None else some.unionByName(one)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(some), F.col("doc_id") == F.col("id")).selectExpr("text", "cast(toxic AS int) AS toxic")  # 2 * sample ids
    rows = rows.mapInArrow(sketcher, "m long, n long, text string, toxic int")
    first = F.min(F.struct(F.xxhash64("text").alias("t"), "toxic", "text", "n")).alias("r")
    rows = rows.groupBy("m").agg(first).select("r.n", "r.text", "r.toxic")
    return rows.groupBy("n").agg(F.min(F.struct(F.xxhash64("text").alias("t"), "toxic", "text")).alias("r")).select("r.text", "r.toxic")


def marked_units(rows: DataFrame, bad_docs: int, good_docs: int) -> np.ndarray:
    """The units that set toxic documents apart, UNITS at most."""
    n = rows.mapInArrow(unit_counter, "unit long, bad long, good long").groupBy("unit").agg(F.sum("bad").cast("double").alias("bad"), F.sum("good").cast("double").alias("good"))
    b, g = F.col("bad"), F.col("good")
    lift = F.log((b + 0.5) / (bad_docs - b + 0.5)) - F.log((g + 0.5) / (good_docs - g + 0.5))
    share, parts = bad_docs / (bad_docs + good_docs), F.lit(0.0)
    for seen, docs, p in ((b, bad_docs, share), (g, good_docs, 1 - share)):
        for x, of in ((seen, b + g), (docs - seen, F.lit(bad_docs + good_docs) - b - g)):
            parts = parts + F.when(x > 0, x * F.log(x / (of * p))).otherwise(0.0)
    best = n.where((b >= 2) & (lift >= LIFT)).select("unit", (2 * parts).alias("g")).where(F.col("g") >= Z * Z).orderBy(F.desc("g"), "unit").limit(UNITS)
    return np.sort(np.array([r.unit for r in best.select("unit").collect()], np.int64).view(U))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model from labelled documents outside the held-out third; at most `sample` documents of either label."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = training_texts(docs, labels, sample)
    if rows is None:
        return None
    rows = scratch.write(rows, "training")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        scratch.drop(rows)
        return None
    marks = marked_units(rows, n[1], n[0])
    cut = scratch.write(rows.mapInArrow(cutter(marks), "draw long, labelled boolean, features binary, labels binary"), "segments")
    got, size = [], {r.labelled: r["count"] for r in cut.groupBy("labelled").count().collect()}
    for on in (True, False):
        share = min(1.0, 0.75 * SEGMENTS / max(1, size.get(on, 0)))  # so that few more than are taken go to the driver
        some = cut.where((F.col("labelled") == on) & (F.col("draw") <= min(int(share * 2**63), 2**63 - 1)))
        got += some.orderBy("draw", "features").limit(SEGMENTS // 2).select("features", "labels").collect()
    feats = [np.frombuffer(r.features, U).reshape(len(PREFIXES) + 3, -1) for r in got]
    first = np.r_[0, np.cumsum([f.shape[1] for f in feats])].astype(np.int64)
    y = np.frombuffer(b"".join(bytes(r.labels) for r in got), np.uint8).astype(np.int64)
    field = train_field(np.concatenate([np.zeros((len(PREFIXES) + 3, 0), U), *feats], axis=1), first, y)
    seen = sorted((r.x, r.toxic) for r in rows.mapInArrow(weigher(field), "x double, toxic int").collect())  # 2 * sample rows
    scratch.drop(rows, cut)
    return Model(field, *logistic(np.array([x for x, _ in seen]), np.array([t for _, t in seen], float)))


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
DDL = "doc_id long, score double, spans array<struct<begin: long, end: long, p: double>>"


def tagger(model: Model):
    """(doc_id, text) to (doc_id, score, spans); spans are code points from the text's beginning, the end not included."""

    def run(batches):
        field = model.field()
        for whole in batches:
            for batch in kn.slices(whole, 1):
                w = Words(batch.column(1))
                first, s, e, offsets = w.first, w.s, w.e, w.offsets
                p = field.marginals(field.emissions(w), first)
                score = 1 / (1 + np.exp(-(model.slope * evidence(p, first) + model.intercept)))
                spans: list[list] = [[] for _ in range(len(batch))]
                hot = np.flatnonzero(p >= 0.5)
                doc = np.searchsorted(first, hot, "right") - 1
                base = w.points(offsets[doc]) if len(hot) else hot
                begins, ends = ((w.points(x[hot]) - base).tolist() if len(hot) else [] for x in (s, e))
                before = -2, -1
                for i, d, begin, end in zip(hot.tolist(), doc.tolist(), begins, ends):
                    if before == (i - 1, d):
                        spans[d][-1]["end"], spans[d][-1]["p"] = end, max(spans[d][-1]["p"], float(p[i]))
                    else:
                        spans[d].append({"begin": begin, "end": end, "p": float(p[i])})
                    before = i, d
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(score, 6)), pa.array(spans, SPANS)], names=["doc_id", "score", "spans"])

    return run


def tag(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, spans) of every document."""
    prepare(docs.sparkSession)
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.from_json(F.lit("[]"), "array<struct<begin: long, end: long, p: double>>").alias("spans"))
    return rows.mapInArrow(tagger(model), DDL)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"), F.transform("spans", lambda s: s["begin"]).alias("span_begins"),
    )
