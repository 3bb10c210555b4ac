"""Queries over predictions: confusion metrics, calibration, selective prediction, temperature."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import calibration as cal
from ..operators import metrics as met
from ..operators import reporting as rep
from ..operators import splits as sp
from ..sources import standins as st
from . import sql

RUN, K = ["backbone", "seed"], st.K
QUERIES, ORACLE_SQL = {}, {}


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return keep


CELLS = "cells AS (SELECT backbone, seed, y, p, count(*) AS n FROM m GROUP BY ALL)"
W = f"WITH {sql.pred()}, "


@query("step0_run_metrics", W + CELLS + "," + sql.f1("cells", "backbone, seed") + " SELECT backbone, seed, CAST(n AS BIGINT) AS n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(macro_f1_present, 6) AS macro_f1_present FROM f1")
def run_metrics(spark, d):
    s = met.summary(met.cells(st.predictions(spark, d), RUN), RUN, K)
    return s.select(*RUN, "n", *r6("accuracy", "macro_f1", "macro_f1_present"))


@query("agg19_confusion", W + CELLS + ", k AS (SELECT unnest(range(10)) AS y), l AS (SELECT unnest(range(10)) AS p), r AS (SELECT DISTINCT backbone, seed FROM m) SELECT r.backbone, r.seed, CAST(k.y AS INTEGER) AS y, CAST(l.p AS INTEGER) AS p, coalesce(n, 0) AS n FROM r, k, l LEFT JOIN cells c ON c.backbone = r.backbone AND c.seed = r.seed AND c.y = k.y AND c.p = l.p")
def confusion(spark, d):
    return met.confusion(st.predictions(spark, d), RUN, K)


PER_CLASS = W + CELLS + "," + sql.f1("cells", "backbone, seed")


@query("agg20_23_per_class", PER_CLASS + " SELECT backbone, seed, CAST(c AS INTEGER) AS c, CAST(tp AS BIGINT) AS tp, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall, round(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END, 6) AS f1 FROM f1_c")
def per_class(spark, d):
    return met.per_class(met.cells(st.predictions(spark, d), RUN), RUN, K).select(*RUN, "c", "tp", "support", "predicted", *r6("recall", "f1"))


BINS = "(CASE WHEN conf <= 1/15 THEN 0 ELSE CAST(ceil(conf * 15) AS INTEGER) - 1 END)"
EDGES = " + ".join(f"CASE WHEN conf > CAST({i} AS DOUBLE) / 15 THEN 1 ELSE 0 END" for i in range(1, 15))
ECE = f"e AS (SELECT backbone, seed, sum(abs(hit - c)) / sum(n) AS ece FROM (SELECT backbone, seed, {EDGES} AS bin, count(*) AS n, sum(ok) AS hit, sum(conf) AS c FROM m GROUP BY ALL) GROUP BY backbone, seed)"


@query("agg25_ece", W + ECE + " SELECT backbone, seed, round(ece, 6) AS ece FROM e")
def ece(spark, d):
    return met.ece(st.predictions(spark, d), RUN).select(*RUN, *r6("ece"))


NLL = "list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) - z[y + 1]"


@query("agg26_nll", W + f"n AS (SELECT backbone, seed, avg({NLL}) AS nll FROM m GROUP BY ALL) SELECT backbone, seed, round(nll, 6) AS nll FROM n")
def nll(spark, d):
    return met.nll(st.predictions(spark, d), RUN).select(*RUN, *r6("nll"))


@query("agg27_seed_mean", W + CELLS + "," + sql.f1("cells", "backbone, seed") + " SELECT backbone, count(*) AS seeds, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_samp(accuracy), 6) AS accuracy_sd, round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_samp(macro_f1), 6) AS macro_f1_sd FROM f1 GROUP BY backbone")
def seed_mean(spark, d):
    s = met.summary(met.cells(st.predictions(spark, d), RUN), RUN, K)
    a = met.across_seeds(s, ["backbone"], ["accuracy", "macro_f1"])
    return a.select("backbone", "seeds", *r6("accuracy_mean", "accuracy_sd", "macro_f1_mean", "macro_f1_sd"))


@query("fn1_2_softmax", W + "s AS (SELECT backbone, seed, id, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda w: exp(w - list_max(z))))) AS soft, z, y FROM m) SELECT backbone, seed, id, round(soft[1], 6) AS first, round(list_max(soft), 6) AS top, round(z[1] - list_max(z) - ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))), 6) + 0.0 AS log_first FROM s")
def softmax(spark, d):
    p = st.predictions(spark, d)
    s = p.select(*RUN, "id", v.softmax(F.col("z")).alias("s"), v.log_softmax(F.col("z")).alias("l"))
    return s.select(*RUN, "id", F.round(F.get("s", 0), 6).alias("first"), F.round(F.array_max("s"), 6).alias("top"), F.round(F.get("l", 0), 6).alias("log_first"))


@query("fn3_5_confidence", W + "c AS (SELECT backbone, seed, id, 1.0 / list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / 1.5))) AS c FROM m) SELECT backbone, seed, id, round(c, 6) AS conf, c < 0.9 AS uncertain FROM c")
def confidence(spark, d):
    p = st.predictions(spark, d).select(*RUN, "id", v.confidence(F.col("z"), 1.5).alias("c"))
    return p.select(*RUN, "id", F.round("c", 6).alias("conf"), v.uncertain(F.col("c"), 0.9).alias("uncertain"))


@query("srt5_top3", W + "o AS (SELECT backbone, seed, id, zz, i, row_number() OVER (PARTITION BY backbone, seed, id ORDER BY zz DESC, i) AS rank FROM (SELECT backbone, seed, id, unnest(z) AS zz, unnest(range(10)) AS i FROM m)) SELECT backbone, seed, id, CAST(rank AS INTEGER) AS rank, CAST(i AS INTEGER) AS cls, round(zz, 6) AS z FROM o WHERE rank <= 3")
def top3(spark, d):
    p = st.predictions(spark, d).select(*RUN, "id", F.posexplode(v.top_k(F.col("z"), 3)).alias("rank", "s"))
    return p.select(*RUN, "id", (F.col("rank") + 1).alias("rank"), F.col("s.i").alias("cls"), F.round("s.p", 6).alias("z"))


RUNNING = "w AS (SELECT backbone, seed, id, conf, ok, row_number() OVER o AS k, sum(ok) OVER (PARTITION BY backbone, seed ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING) AS hits, lead(conf) OVER o AS nxt FROM m WINDOW o AS (PARTITION BY backbone, seed ORDER BY conf DESC, id))"


@query("win1_7_running_accuracy", W + RUNNING + " SELECT backbone, seed, id, k, round(hits / k, 6) AS accuracy, (nxt IS NULL OR nxt <> conf) AS tie_end FROM w")
def running(spark, d):
    return cal.running(st.predictions(spark, d), RUN).select(*RUN, F.col("pos").alias("id"), F.col("k").cast("bigint").alias("k"), *r6("accuracy"), "tie_end")


THETA = "th AS (SELECT backbone, seed, min(CASE WHEN n >= 50 AND hit / n >= {target} THEN conf END) AS theta FROM (SELECT backbone, seed, conf, count(*) OVER t AS n, sum(ok) OVER t AS hit FROM m WINDOW t AS (PARTITION BY backbone, seed ORDER BY conf DESC)) GROUP BY ALL)"


@query("win2_threshold", W + THETA.format(target=0.99) + " SELECT backbone, seed, round(theta, 6) AS theta FROM th")
def threshold(spark, d):
    return cal.threshold(st.predictions(spark, d), RUN).select(*RUN, *r6("theta"))


@query("win2_threshold_unattainable", f"WITH {sql.pred(1.5)}, " + THETA.format(target=0.99) + " SELECT backbone, seed, theta IS NULL AS unattainable FROM th")
def unattainable(spark, d):
    return cal.threshold(st.predictions(spark, d, 1.5), RUN).select(*RUN, F.isnull("theta").alias("unattainable"))


@query("win3_aurc", W + RUNNING + " SELECT backbone, seed, round(avg(1 - hits / k), 6) AS aurc FROM w GROUP BY ALL")
def aurc(spark, d):
    return cal.aurc(st.predictions(spark, d), RUN).select(*RUN, *r6("aurc"))


@query("win4_accuracy_at_coverage", W + RUNNING + ", t AS (SELECT backbone, seed, count(*) AS n FROM m GROUP BY ALL) SELECT backbone, seed, round(avg(CASE WHEN k <= greatest(1, round_even(n * 0.9, 0)) THEN ok END), 6) AS acc_at_90, round(avg(CASE WHEN k <= greatest(1, round_even(n * 0.95, 0)) THEN ok END), 6) AS acc_at_95 FROM w JOIN t USING (backbone, seed) GROUP BY ALL")
def at_coverage(spark, d):
    return cal.accuracy_at_coverage(st.predictions(spark, d), RUN, [0.9, 0.95]).select(*RUN, *r6("acc_at_90", "acc_at_95"))


@query("agg31_32_selective", W + THETA.format(target=0.95) + " SELECT backbone, seed, round(avg(CASE WHEN conf >= theta THEN 1 ELSE 0 END), 6) AS coverage, round(avg(CASE WHEN conf >= theta THEN ok END), 6) AS selective_accuracy, round(avg(CASE WHEN ok = 0 THEN CASE WHEN conf < theta THEN 1 ELSE 0 END END), 6) AS error_capture FROM m JOIN th USING (backbone, seed) GROUP BY ALL")
def selective(spark, d):
    p = st.predictions(spark, d)
    return cal.selective(p.join(F.broadcast(cal.threshold(p, RUN, 0.95)), RUN), RUN).select(*RUN, *r6("coverage", "selective_accuracy", "error_capture"))


@query("agg33_rejection_by_class", W + THETA.format(target=0.95) + " SELECT backbone, seed, y, count(*) AS n, round(avg(CASE WHEN conf < theta THEN 1 ELSE 0 END), 6) AS rejected FROM m JOIN th USING (backbone, seed) GROUP BY ALL")
def rejection(spark, d):
    p = st.predictions(spark, d)
    return cal.rejection_by_class(p.join(F.broadcast(cal.threshold(p, RUN, 0.95)), RUN), RUN).select(*RUN, "y", "n", *r6("rejected"))


@query("agg34_support", "SELECT CAST(c AS INTEGER) AS c, count(e.vec_id) AS n FROM (SELECT unnest(range(12)) AS c) k LEFT JOIN embeddings e ON e.label = k.c GROUP BY c")
def support(spark, d):
    k = spark.range(12).select(F.col("id").cast("int").alias("c"))
    n = st.images(spark, d).groupBy(F.col("y").alias("c")).agg(F.count("*").alias("n"))
    return k.join(n, "c", "left").select("c", F.coalesce("n", F.lit(0)).alias("n"))


GRID = [round(0.05 * (10 / 0.05) ** (i / 20), 6) for i in range(21)]


@query("fit1_temperature_grid", W + f"g AS (SELECT unnest({GRID}) AS t), n AS (SELECT backbone, seed, t, avg(ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / t)))) + (list_max(z) - z[y + 1]) / t) AS nll FROM m, g GROUP BY ALL) SELECT backbone, seed, CAST(t AS DOUBLE) AS t, round(nll, 6) AS nll FROM n")
def temperature_grid(spark, d):
    return cal.grid_loss(st.predictions(spark, d), RUN, GRID).select(*RUN, "t", *r6("nll"))


def fitted(rows: str, name: str = "fit") -> str:
    """name: (backbone, seed, temperature) by bisection of the loss's slope in 1 / T. Needs WITH RECURSIVE."""
    mean = "list_sum(list_transform(z, lambda x: x * exp((x - list_max(z)) * mid))) / list_sum(list_transform(z, lambda x: exp((x - list_max(z)) * mid)))"
    return f"""
{name}_b(backbone, seed, low, high, k) AS (
  SELECT DISTINCT backbone, seed, CAST(0.1 AS DOUBLE), CAST(20 AS DOUBLE), 0 FROM {rows}
  UNION ALL
  SELECT backbone, seed, CASE WHEN g > 0 THEN low ELSE mid END, CASE WHEN g > 0 THEN mid ELSE high END, k + 1
  FROM (SELECT b.backbone, b.seed, low, high, k, mid, avg({mean} - z[y + 1]) AS g
        FROM (SELECT *, (low + high) / 2 AS mid FROM {name}_b WHERE k < 45) b JOIN {rows} r ON r.backbone = b.backbone AND r.seed = b.seed GROUP BY ALL)),
{name} AS (SELECT backbone, seed, 2 / (low + high) AS temperature FROM {name}_b WHERE k = 45)"""


@query("fit1_temperature", W.replace("WITH", "WITH RECURSIVE") + fitted("m") + " SELECT backbone, seed, round(temperature, 5) AS temperature FROM fit")
def temperature(spark, d):
    return cal.fit_temperature(st.predictions(spark, d), RUN).select(*RUN, F.round("temperature", 5).alias("temperature"))


EDGES = " + ".join(f"CASE WHEN c > CAST({i} AS DOUBLE) / 15 THEN 1 ELSE 0 END" for i in range(1, 15))


def _measured(part: str) -> str:
    """Calibration error and mean loss of a part before (c0) and after (c1) scaling, by run."""
    out = []
    for k in (0, 1):
        out.append(f"{part}b{k} AS (SELECT backbone, seed, {EDGES} AS bin, count(*) AS n, sum(ok) AS hit, sum(c) AS total FROM (SELECT *, c{k} AS c FROM {part}) GROUP BY ALL), {part}e{k} AS (SELECT backbone, seed, sum(abs(hit - total)) / sum(n) AS ece FROM {part}b{k} GROUP BY ALL)")
    return ", ".join(out) + f", {part}m AS (SELECT x.backbone, x.seed, x.ece AS ece_before, z.ece AS ece_after, nll_before, nll_after FROM {part}e0 x JOIN {part}e1 z USING (backbone, seed) JOIN (SELECT backbone, seed, avg(l0) AS nll_before, avg(l1) AS nll_after FROM {part} GROUP BY ALL) USING (backbone, seed))"


SCALED = "SELECT m.*, temperature, split, conf AS c0, 1.0 / list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / temperature))) AS c1, ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) + list_max(z) - z[y + 1] AS l0, ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / temperature)))) + (list_max(z) - z[y + 1]) / temperature AS l1 FROM m JOIN (SELECT id, split FROM strat) USING (id) JOIN fit USING (backbone, seed)"
RECORD = (
    f"WITH RECURSIVE {sql.STRATIFIED}, {sql.pred()}, va0 AS (SELECT m.* FROM m JOIN strat USING (id) WHERE split = 'train'), {fitted('va0')}, sc AS ({SCALED}), va AS (SELECT * FROM sc WHERE split = 'train'), te AS (SELECT * FROM sc WHERE split <> 'train'), {_measured('va')}, {_measured('te')}, "
    "th AS (SELECT backbone, seed, min(CASE WHEN n >= 50 AND hit / n >= 0.95 THEN c1 END) AS theta FROM (SELECT backbone, seed, c1, count(*) OVER t AS n, sum(ok) OVER t AS hit FROM va WINDOW t AS (PARTITION BY backbone, seed ORDER BY c1 DESC)) GROUP BY ALL), "
    "se AS (SELECT backbone, seed, avg(CASE WHEN c1 >= theta THEN 1.0 ELSE 0 END) AS coverage, avg(CASE WHEN c1 >= theta THEN ok END) AS selective_accuracy, avg(CASE WHEN ok = 0 THEN CASE WHEN c1 < theta THEN 1 ELSE 0 END END) AS error_capture FROM te JOIN th USING (backbone, seed) GROUP BY ALL), "
    "w AS (SELECT backbone, seed, row_number() OVER o AS k, sum(ok) OVER (PARTITION BY backbone, seed ORDER BY c1 DESC, id ROWS UNBOUNDED PRECEDING) AS hits FROM te WINDOW o AS (PARTITION BY backbone, seed ORDER BY c1 DESC, id)), au AS (SELECT backbone, seed, avg(1 - hits / k) AS aurc FROM w GROUP BY ALL), "
    "rec AS (SELECT backbone, seed, temperature, theta, v.ece_before AS val_ece_before, v.ece_after AS val_ece_after, v.nll_before AS val_nll_before, v.nll_after AS val_nll_after, e.ece_before, e.ece_after, e.nll_before, e.nll_after, coverage, selective_accuracy, error_capture, aurc "
    "FROM vam v JOIN tem e USING (backbone, seed) JOIN th USING (backbone, seed) JOIN se USING (backbone, seed) JOIN au USING (backbone, seed) JOIN fit USING (backbone, seed))"
)
FITTED = ("temperature", "theta", "val_ece_before", "val_ece_after", "val_nll_before", "val_nll_after", "ece_before", "ece_after", "nll_before", "nll_after", "coverage", "selective_accuracy", "error_capture", "aurc")


def _record(spark, d):
    p = st.predictions(spark, d).join(sp.stratified(st.images(spark, d).select("id", "y")).select("id", "split"), "id")
    t = cal.fit_temperature(p.where("split = 'train'"), RUN)
    cooled = F.transform("z", lambda x: x / F.col("temperature"))
    scaled = p.join(F.broadcast(t), RUN).withColumns({"before": F.col("conf"), "conf": v.confidence(F.col("z"), F.col("temperature")), "l0": met.nll_term(F.col("z"), F.col("y")), "l1": met.nll_term(cooled, F.col("y"))})
    val, test = scaled.where("split = 'train'"), scaled.where("split <> 'train'")
    theta = cal.threshold(val, RUN, 0.95)
    s = test.join(F.broadcast(theta), RUN)
    out = cal.selective(s, RUN).join(cal.aurc(s, RUN), RUN).join(theta, RUN).join(t, RUN)
    for part, prefix in ((val, "val_"), (test, "")):
        before = met.ece(part.withColumn("conf", F.col("before")), RUN).withColumnRenamed("ece", f"{prefix}ece_before")
        loss = part.groupBy(*RUN).agg(F.avg("l0").alias(f"{prefix}nll_before"), F.avg("l1").alias(f"{prefix}nll_after"))
        out = out.join(before, RUN).join(met.ece(part, RUN).withColumnRenamed("ece", f"{prefix}ece_after"), RUN).join(loss, RUN)
    return out


@query("fit2_3_calibration_record", RECORD + " SELECT backbone, seed, " + ", ".join(f"round({c}, 6) AS {c}" for c in FITTED) + " FROM rec")
def calibration_record(spark, d):
    """Temperature and threshold fitted on the larger part of a stratified split, and what they give there and on the rest."""
    return _record(spark, d).select(*RUN, *r6(*FITTED))


@query("q13_per_seed", RECORD + " SELECT backbone, seed, (backbone = 1 AND seed = 2) AS demo, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("temperature", "theta", "coverage", "selective_accuracy", "ece_after")) + " FROM rec")
def per_seed(spark, d):
    """The record's main columns by seed; one run is marked as the one that a demo would use."""
    demo = ((F.col("backbone") == 1) & (F.col("seed") == 2)).alias("demo")
    return _record(spark, d).select(*RUN, demo, *r6("temperature", "theta", "coverage", "selective_accuracy", "ece_after"))


HISTORY = "h AS (SELECT backbone, seed, CAST(id AS INTEGER) AS epoch, conf AS val_macro_f1 FROM m)"


@query("win11_best_epoch", W + HISTORY + """, b AS (SELECT *, max(val_macro_f1) OVER (PARTITION BY backbone, seed ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
 s AS (SELECT *, epoch - max(CASE WHEN before IS NULL OR val_macro_f1 > before THEN epoch END) OVER (PARTITION BY backbone, seed ORDER BY epoch) AS since FROM b),
 e AS (SELECT backbone, seed, coalesce(min(CASE WHEN since >= 5 THEN epoch END), max(epoch)) AS last FROM s GROUP BY ALL),
 ran AS (SELECT s.*, row_number() OVER (PARTITION BY s.backbone, s.seed ORDER BY val_macro_f1 DESC, epoch) AS r, last FROM s JOIN e ON s.backbone = e.backbone AND s.seed = e.seed AND epoch <= last)
 SELECT backbone, seed, epoch AS best_epoch, round(val_macro_f1, 6) AS best, last AS epochs_run FROM ran WHERE r = 1""")
def best_epoch(spark, d):
    h = st.predictions(spark, d).select(*RUN, F.col("id").cast("int").alias("epoch"), F.col("conf").alias("val_macro_f1"))
    return cal.best_epoch(h, RUN).select(*RUN, "best_epoch", *r6("best"), "epochs_run")


@query("srt4_q6_top_confusions", W + "cells AS (SELECT backbone, y, p, count(*) AS n FROM m GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY backbone, y) AS rate FROM cells), o AS (SELECT *, row_number() OVER (PARTITION BY backbone ORDER BY rate DESC, y, p) AS rank FROM s WHERE y <> p) SELECT backbone, y, p, n, round(rate, 6) AS rate, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 5")
def top_confusions(spark, d):
    c = met.confusion(st.predictions(spark, d), ["backbone"], K)
    return rep.top_confusions(c, ["backbone"]).select("backbone", "y", "p", "n", *r6("rate"), "rank")


@query("q5_recall_by_class", PER_CLASS + ", r AS (SELECT backbone, c, avg(CASE WHEN support > 0 THEN tp / support ELSE 0 END) AS recall FROM f1_c GROUP BY ALL) SELECT CAST(c AS INTEGER) AS c, round(max(CASE WHEN backbone = 0 THEN recall END), 6) AS backbone_0, round(max(CASE WHEN backbone = 1 THEN recall END), 6) AS backbone_1 FROM r GROUP BY c")
def recall_by_class(spark, d):
    pc = met.per_class(met.cells(st.predictions(spark, d), RUN), RUN, K).select("backbone", "c", "recall")
    wide = rep.recall_table(pc, [], "backbone", [0, 1])
    return wide.select("c", F.round("0", 6).alias("backbone_0"), F.round("1", 6).alias("backbone_1"))


@query("q14_rejection_table", W + THETA.format(target=0.95) + ", r AS (SELECT backbone, y, count(*) AS n, avg(CASE WHEN conf < theta THEN 1 ELSE 0 END) AS rejected FROM m JOIN th USING (backbone, seed) GROUP BY ALL) SELECT y, max(n) AS n, round(max(CASE WHEN backbone = 0 THEN rejected END), 6) AS backbone_0, round(max(CASE WHEN backbone = 1 THEN rejected END), 6) AS backbone_1 FROM r GROUP BY y")
def rejection_table(spark, d):
    p = st.predictions(spark, d)
    r = cal.rejection_by_class(p.join(F.broadcast(cal.threshold(p, RUN, 0.95)), RUN), ["backbone"])
    wide = r.groupBy("y").agg(F.max("n").alias("n"), *(F.round(F.max(F.when(F.col("backbone") == b, F.col("rejected"))), 6).alias(f"backbone_{b}") for b in (0, 1)))
    return wide


TABLE = ("temperature", "val_ece_before", "val_ece_after", "val_nll_before", "val_nll_after", "ece_before", "ece_after", "nll_before", "nll_after")


@query("q11_calibration_table", RECORD + " SELECT backbone, count(*) AS seeds, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in TABLE) + ", round(avg(ece_after - ece_before), 6) AS ece_change, round(avg(nll_after - nll_before), 6) AS nll_change FROM rec GROUP BY backbone")
def calibration_table(spark, d):
    """Seed means of the calibration record, and the changes of calibration error and loss."""
    change = [F.round(F.avg(F.col(f"{x}_after") - F.col(f"{x}_before")), 6).alias(f"{x}_change") for x in ("ece", "nll")]
    return _record(spark, d).groupBy("backbone").agg(F.count("*").alias("seeds"), *(F.round(F.avg(c), 6).alias(c) for c in TABLE), *change)


@query("fn13_row_profile", "SELECT id, CAST(pos AS INTEGER) AS pos, round(list_avg(r), 6) AS mean, round(sqrt(greatest(0, list_avg(list_transform(r, lambda x: x * x)) - list_avg(r) * list_avg(r))), 6) AS std FROM (SELECT vec_id AS id, unnest(range(8)) AS pos, unnest(list_transform(range(8), lambda i: list_transform(embedding[8 * i + 1 : 8 * i + 8], lambda x: CAST(x AS DOUBLE)))) AS r FROM embeddings)")
def row_profile(spark, d):
    x = st.images(spark, d).select("id", F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    p = x.select("id", F.posexplode(v.row_profile(F.col("x"), 8)).alias("pos", "s"))
    return p.select("id", "pos", F.round("s.mean", 6).alias("mean"), F.round("s.std", 6).alias("std"))


@query("fn14_gray_test", "SELECT vec_id AS id, list_max(list_transform(range(1, 17), lambda i: greatest(embedding[i], embedding[i + 16], embedding[i + 32]) - least(embedding[i], embedding[i + 16], embedding[i + 32]))) * 1000 <= 400 AS gray FROM embeddings")
def gray_test(spark, d):
    part = lambda i: F.slice(F.transform("embedding", lambda e: e * 1000), 1 + 16 * i, 16)
    return st.images(spark, d).select("id", v.is_gray(part(0), part(1), part(2), 400).alias("gray"))


@query("fn24_learning_rate", "SELECT CAST(s AS INTEGER) AS step, round(CASE WHEN s < 5 THEN 0.001 * (s + 1) / 5 ELSE 0.5 * 0.001 * (1 + cos(pi() * (s - 5) / 45)) END, 9) AS rate FROM (SELECT unnest(range(50)) AS s)")
def learning_rate(spark, d):
    s = spark.range(50).select(F.col("id").cast("int").alias("step"))
    return s.select("step", F.round(v.learning_rate(F.col("step"), 5, 50, 0.001), 9).alias("rate"))


@query("srt6_display_order", "SELECT * FROM (VALUES ('random', 0), ('group:0.9', 1), ('group:0.94', 2), ('group:0.98', 3), ('other', 4)) t(variant, place)")
def display_order(spark, d):
    names = spark.createDataFrame([(x,) for x in ("other", "group:0.98", "group:0.9", "random", "group:0.94")], "variant string")
    return names.select("variant", rep.display_rank(F.col("variant")).alias("place")).orderBy("place")


@query("srt7_seed_sets", "SELECT DISTINCT CAST(b AS INTEGER) AS backbone, '0,1,2' AS seeds FROM embeddings, (SELECT unnest([0, 1]) AS b)")
def seed_sets(spark, d):
    return st.predictions(spark, d).groupBy("backbone").agg(F.array_join(F.array_sort(F.collect_set("seed")), ",").alias("seeds"))
