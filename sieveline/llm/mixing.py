"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Documents are counted into cells (source, language, topic) with their tokens, the blank-separated words. Raking scales
the cells' token weights until their sums by source, by language and by topic meet the target shares; a target is a
parameter, or else the observed share to the power of a temperature. A cell's documents are then kept with probability
min(1, c * weight / tokens), where c is found by bisection so that the expected tokens make up the budget. A document is
kept if a hash of its id falls under its probability, so the same documents are kept in every run.

Topics are cheap forms of text, disjoint and exhaustive: tabular, listing, short, long, prose.

The cells are gathered on the driver if there are no more than CELLS of them; beyond that the same rounds run as
aggregations and joins of the cell table.

Edge cases: a null source or language is a value of its own. A null, empty or blank text has 0 tokens; a cell without
tokens has probability 1, as it costs nothing. Values without a target share one share of what is left. Rows that repeat a doc_id
are kept or left together. Extra columns are ignored by the counts; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_RE, BLANKS, Scratch, prepare, table, text_or_empty, unused

CELLS = 200_000
DIMS = ("source", "lang", "topic")
TEMPERATURE = 0.7
BUDGET = 0.6
ROUNDS, CLOSE = 200, 1e-9
#: Halvings that one pass over a large cell table decides.
DEPTH = 5
TOPICS = ("tabular", "listing", "short", "long", "prose")


def n_tokens(text: Column) -> Column:
    t = F.btrim(text, F.lit(BLANKS))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, BLANK_RE))).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    chars, without = F.length(text), lambda x: F.length(F.replace(text, F.lit(x), F.lit("")))
    return (
        F.when((chars - without("|")) * 100 >= chars + 1, "tabular")
        .when((chars - without("\n")) * 50 >= chars + 1, "listing")
        .when(tokens < 100, "short").when(tokens >= 1000, "long").otherwise("prose")
    )


def value(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("(null)"))


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens)."""
    out = docs.select("doc_id", value("source").alias("source"), value("lang").alias("lang"), text_or_empty().alias("text"), n_tokens(text_or_empty()).alias("n_tokens"))
    return out.select("doc_id", "source", "lang", topic(F.col("text"), F.col("n_tokens")).alias("topic"), "n_tokens")


def shares(values: dict[str, float], target: dict[str, float] | None) -> dict[str, float]:
    """Target shares of the observed values, which sum to 1."""
    if target is None:
        raw = {v: t**TEMPERATURE if t > 0 else 0.0 for v, t in values.items()}
    else:
        left, free = max(0.0, 1 - sum(target.values())), [v for v in values if v not in target]
        raw = {v: target.get(v, left / len(free) if free else 0.0) for v in values}
    total = sum(raw.values()) or 1.0
    return {v: x / total for v, x in raw.items()}


def rake(tokens: np.ndarray, codes: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """Weights of cells whose sums by each dimension meet the wanted shares, starting from the tokens."""
    w = tokens / max(tokens.sum(), 1.0)
    for _ in range(ROUNDS):
        worst = 0.0
        for code, want in zip(codes, wanted):
            have = np.bincount(code, w, minlength=len(want))
            factor = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            worst = max(worst, float(np.abs(have - want)[have > 0].max(initial=0)))
            w = w * factor[code]
        if worst < CLOSE:
            break
    return w


def calibrate(weight: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities in proportion to weight / tokens, 1 at most, whose expected tokens make up the budget."""
    ratio = np.divide(weight, tokens, out=np.zeros_like(weight), where=tokens > 0)
    lo, hi = 0.0, tokens.sum() / max(ratio[ratio > 0].min(initial=1.0), 1e-300)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (np.minimum(1, mid * ratio) * tokens).sum() < budget * tokens.sum() else (lo, mid)
    return np.where(tokens > 0, np.minimum(1, hi * ratio), 1.0)


def rake_distributed(cells: DataFrame, targets: dict, budget: float, scratch: Scratch) -> DataFrame:
    """The same shares, rounds and bisection over a cell table that the driver can't hold."""
    total = cells.agg(F.sum("tokens").alias("t")).first().t or 1
    w = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for dim in DIMS:
        by = cells.groupBy(dim).agg(F.sum("tokens").alias("t"))
        target = targets.get(dim)
        if target is None:
            by = by.withColumn("raw", F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(TEMPERATURE))).otherwise(0.0))
        else:
            named = F.try_element_at(F.create_map(*[F.lit(x) for v, share in target.items() for x in (v, float(share))]), F.col(dim)) if target else F.lit(None).cast("double")
            by = scratch.write(by.withColumn("named", named), "shares")
            free = by.where("named IS NULL").count()
            by = by.withColumn("raw", F.coalesce("named", F.lit(max(0.0, 1 - sum(target.values())) / max(free, 1))))
        by = by.crossJoin(F.broadcast(by.agg(F.sum("raw").alias("all"))))  # one row
        w = w.join(by.select(dim, F.when(F.col("all") > 0, F.col("raw") / F.col("all")).otherwise(0.0).alias(f"{dim}_share")), dim)
    w = scratch.write(w, "weights")
    for _ in range(ROUNDS):
        old = w
        for dim in DIMS:
            have, want = F.col("have"), F.col(f"{dim}_share")
            w = w.join(w.groupBy(dim).agg(F.sum("weight").alias("have")), dim)
            w = w.withColumns({"weight": F.when(have > 0, F.col("weight") * want / have).otherwise(F.col("weight")), f"{dim}_off": F.when(have > 0, F.abs(have - want)).otherwise(0.0)}).drop("have")
        w = scratch.write(w, "weights")
        worst = w.agg(F.max(F.greatest(*(f"{dim}_off" for dim in DIMS))).alias("x")).first().x or 0.0
        scratch.drop(old)
        if worst < CLOSE:
            break
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0))
    w = w.withColumn("ratio", ratio)
    least = w.where("ratio > 0").agg(F.min("ratio").alias("m")).first().m or 1.0
    lo, hi = 0.0, float(total) / max(min(least, 1.0), 1e-300)
    for _ in range(200 // DEPTH):
        ends, mids = [(lo, hi)], []
        for _ in range(DEPTH):  # all middles that the next DEPTH halvings can ask for
            mids += [(a + b) / 2 for a, b in ends]
            ends = [e for a, b in ends for e in ((a, (a + b) / 2), ((a + b) / 2, b))]
        got = w.agg(*(F.sum(F.least(F.lit(1.0), F.col("ratio") * F.lit(m)) * F.col("tokens")).alias(f"s{i}") for i, m in enumerate(mids))).first()
        at = 0
        for _ in range(DEPTH):
            low = (got[at] or 0.0) < budget * total
            lo, hi = (mids[at], hi) if low else (lo, mids[at])
            at = 2 * at + (2 if low else 1)
    return w.select(*DIMS, "weight", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("ratio") * hi)).otherwise(1.0).alias("probability"))


def fit(cells: DataFrame, targets: dict[str, dict[str, float]], budget: float, scratch: Scratch) -> DataFrame:
    """(source, lang, topic, weight, probability) of the written cells (source, lang, topic, tokens)."""
    if cells.count() > CELLS:
        return rake_distributed(cells, targets, budget, scratch)
    got = sorted(cells.collect())
    tokens = np.array([r.tokens for r in got], float)
    codes, wanted = [], []
    for dim in DIMS:
        values: dict[str, float] = {}
        for r in got:
            values[r[dim]] = values.get(r[dim], 0.0) + r.tokens
        want = shares(values, targets.get(dim))
        place = {v: i for i, v in enumerate(values)}
        codes.append(np.array([place[r[dim]] for r in got], int))
        wanted.append(np.array([want[v] for v in values]))
    weight = rake(tokens, codes, wanted) if got else tokens
    chance = calibrate(weight, tokens, budget)
    fitted = [(*(r[d] for d in DIMS), float(w), float(p)) for r, w, p in zip(got, weight, chance)]
    return F.broadcast(cells.sparkSession.createDataFrame(fitted, "source string, lang string, topic string, weight double, probability double"))


def draw(seed: int) -> Column:
    """A number from 0 to 1 for the doc_id."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 53)) / float(1 << 53)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: int = 0) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, sampled) of every document; budget is the share of all
    tokens that is to be kept in expectation."""
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.write(describe(docs), "documents")
    cells = scratch.write(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    out = rows.join(fit(cells, targets or {}, budget, scratch), list(DIMS))
    return out.select("doc_id", *DIMS, "n_tokens", "weight", "probability", (draw(seed) < F.col("probability")).alias("sampled"))


def drawn(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: int = 0) -> DataFrame:
    """The documents that mix() samples, all columns; a row is decided by its own id and cell."""
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "mixing")
    cells = scratch.write(describe(docs).groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    own = dict(zip((*DIMS, "tokens", "draw"), unused(docs, *(f"_its_{c}" for c in (*DIMS, "tokens", "draw")))))
    cell = dict(zip((*DIMS, "probability"), unused(docs, *(f"_cell_{c}" for c in (*DIMS, "probability")))))
    fitted = fit(cells, targets or {}, budget, scratch).select(*(F.col(c).alias(name) for c, name in cell.items()))
    told = docs.withColumns({own["source"]: value("source"), own["lang"]: value("lang"), own["tokens"]: n_tokens(text_or_empty()), own["draw"]: draw(seed)})
    told = told.withColumn(own["topic"], topic(text_or_empty(), F.col(own["tokens"])))
    same = [F.col(own[d]) == F.col(cell[d]) for d in DIMS]
    out = told.join(fitted, [*same, F.col(own["draw"]) < F.col(cell["probability"])], "left_semi")
    return out.select(*(F.col(c) for c in docs.columns))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
