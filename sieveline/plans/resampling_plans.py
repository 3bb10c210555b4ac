"""Queries of bootstrap intervals, gaps, contrasts, strata and the report tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import bootstrap as bs
from ..operators import calibration as cal
from ..operators import graph as gr
from ..operators import metrics as met
from ..operators import reporting as rep
from ..operators import similarity as sim
from ..operators import splits as sp
from ..sources import standins as st
from . import sql

QUERIES, ORACLE_SQL = {}, {}
B, K = bs.N_BOOT, st.K
BOTH = ["accuracy", "macro_f1"]


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return keep


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _clusters(spark, d, tau=0.4):
    links = sim.cosine_links(sim.centre(st.images(spark, d)), tau)
    return gr.joined(st.images(spark, d), links)


def ci(values, where="reps"):
    return ", ".join(f"round(quantile_cont({v}, 0.025), 6) AS {v}_lo, round(quantile_cont({v}, 0.975), 6) AS {v}_hi" for v in values)


IMG = f"WITH {sql.pred()}, un AS (SELECT DISTINCT id AS unit FROM m), {sql.draws('un', B)}, cells AS (SELECT backbone, seed, boot, y, p, sum(w) AS n FROM m JOIN dr ON unit = id GROUP BY ALL),{sql.f1('cells', 'backbone, seed, boot')}, reps AS (SELECT backbone, boot, avg(accuracy) AS accuracy, avg(macro_f1) AS macro_f1 FROM f1 GROUP BY ALL)"
CLU = f"WITH RECURSIVE {sql.PAIRS}, {sql.components(0.4)}, {sql.pred()}, un AS (SELECT DISTINCT cluster AS unit FROM cl), {sql.draws('un', B)}, cells AS (SELECT backbone, seed, boot, y, p, sum(w) AS n FROM m JOIN cl USING (id) JOIN dr ON unit = cluster GROUP BY ALL),{sql.f1('cells', 'backbone, seed, boot')}, reps AS (SELECT backbone, boot, avg(accuracy) AS accuracy, avg(macro_f1) AS macro_f1 FROM f1 GROUP BY ALL)"


def _image_reps(spark, d, seed=0, p=None):
    p = (p or st.predictions(spark, d)).withColumn("unit", F.col("id"))
    return bs.seed_mean(bs.replicates(p, ["backbone", "seed"], K, B, seed), ["backbone"], BOTH)


def _cluster_reps(spark, d, seed=0, clusters=None, p=None):
    c = (clusters or _clusters(spark, d)).withColumnRenamed("cluster", "unit")
    p = (p or st.predictions(spark, d)).join(c, "id")
    return bs.seed_mean(bs.replicates(p, ["backbone", "seed"], K, B, seed), ["backbone"], BOTH)


NAMES = [f"{v}_{s}" for v in BOTH for s in ("lo", "hi")]


@query("bst1_3_image_ci", IMG + f" SELECT backbone, {ci(BOTH)} FROM reps GROUP BY backbone")
def image_ci(spark, d):
    return bs.interval(_image_reps(spark, d), ["backbone"], BOTH).select("backbone", *r6(*NAMES))


@query("bst2_cluster_ci", CLU + f" SELECT backbone, {ci(BOTH)} FROM reps GROUP BY backbone")
def cluster_ci(spark, d):
    return bs.interval(_cluster_reps(spark, d), ["backbone"], BOTH).select("backbone", *r6(*NAMES))


def _reps_sql(name, rows, by, unit, seed=0, where="true"):
    """r{name}: (by, boot, accuracy, macro_f1), seed means of replicates over units; rows has them as a column."""
    some = f"{by}, " if by else ""
    return (
        f"u{name} AS (SELECT DISTINCT {unit} AS unit FROM {rows}), {sql.draws('u' + name, B, seed, 'd' + name)}, c{name} AS (SELECT {some}seed, boot, y, p, sum(w) AS n FROM {rows} JOIN d{name} ON unit = {unit} WHERE {where} GROUP BY ALL),"
        f"{sql.f1('c' + name, some + 'seed, boot', 'f' + name)}, r{name} AS (SELECT {some}boot, avg(accuracy) AS accuracy, avg(macro_f1) AS macro_f1 FROM f{name} GROUP BY ALL)"
    )


def _renamed(df, by, suffix):
    return df.select(*by, *(F.col(n).alias(n.replace("_lo", f"_{suffix}_lo").replace("_hi", f"_{suffix}_hi")) for n in NAMES))


def ci_as(suffix):
    return ", ".join(f"round(quantile_cont({v}, {q}), 6) AS {v}_{suffix}_{e}" for v in BOTH for q, e in ((0.025, "lo"), (0.975, "hi")))


MC = f"WITH RECURSIVE {sql.PAIRS}, {sql.components(0.4)}, {sql.pred()}, mc AS (SELECT m.*, cluster FROM m JOIN cl USING (id))"
POINT = f"pc AS (SELECT backbone, seed, y, p, count(*) AS n FROM m GROUP BY ALL),{sql.f1('pc', 'backbone, seed', 'pt')}"


def _gap_sql(kind, unit):
    a, b = _reps_sql(kind + "a", "mc", "", unit, 0, "backbone = 0"), _reps_sql(kind + "b", "mc", "", unit, 1, "backbone = 1")
    return f"{a}, {b}, g{kind} AS (SELECT x.accuracy - z.accuracy AS accuracy, x.macro_f1 - z.macro_f1 AS macro_f1 FROM r{kind}a x JOIN r{kind}b z USING (boot)), o{kind} AS (SELECT {ci_as('image' if kind == 'i' else 'cluster')} FROM g{kind})"


@query("bst4_q2_gap", f"{MC}, {POINT}, {_gap_sql('i', 'id')}, {_gap_sql('c', 'cluster')}, d AS (SELECT " + ", ".join(f"round(avg(CASE WHEN backbone = 0 THEN {v} END) - avg(CASE WHEN backbone = 1 THEN {v} END), 6) AS {v}" for v in BOTH) + " FROM pt) SELECT * FROM d, oi, oc")
def gap(spark, d):
    """The gap between two sides, here the backbones, with intervals over images and over clusters; sides are drawn apart."""
    s = met.summary(met.cells(st.predictions(spark, d), ["backbone", "seed"]), ["backbone", "seed"], K)
    out = s.agg(*(F.round(F.avg(F.when(F.col("backbone") == 0, F.col(v))) - F.avg(F.when(F.col("backbone") == 1, F.col(v))), 6).alias(v) for v in BOTH))
    clusters = gr.checkpointed(_clusters(spark, d))  # once for both sides
    for suffix, reps in (("image", partial(_image_reps, spark, d)), ("cluster", partial(_cluster_reps, spark, d, clusters=clusters))):
        a, b = reps(seed=0).where("backbone = 0"), reps(seed=1).where("backbone = 1")
        out = out.crossJoin(_renamed(bs.gap(a, b, BOTH).select(*r6(*NAMES)), [], suffix))  # one row each
    return out


def _region_sql():
    parts = []
    for i, (r, b) in enumerate(st.REGIONS.items()):
        body = sql.pred(b).replace("pred AS", f"pred{i} AS").replace("FROM pred)", f"FROM pred{i})").replace("\nq AS", f"\nq{i} AS").replace("FROM q)", f"FROM q{i})").replace("\nm AS", f"\nm{i} AS")
        parts.append(body)
    union = " UNION ALL ".join(f"SELECT '{r}' AS region, seed, id, y, p FROM m{i} WHERE backbone = 0" for i, r in enumerate(st.REGIONS))
    return ", ".join(parts) + f", rg AS ({union})"


REG = f"WITH {_region_sql()}, cells AS (SELECT region, seed, y, p, count(*) AS n FROM rg GROUP BY ALL),{sql.f1('cells', 'region, seed')}"


@query("agg30_q8_regions", REG + " SELECT region, count(*) AS seeds, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_samp(accuracy), 6) AS accuracy_sd, round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_samp(macro_f1), 6) AS macro_f1_sd FROM f1 GROUP BY region")
def regions(spark, d):
    s = met.summary(met.cells(st.regions(spark, d), ["region", "seed"]), ["region", "seed"], K)
    return met.across_seeds(s, ["region"], BOTH).select("region", "seeds", *r6("accuracy_mean", "accuracy_sd", "macro_f1_mean", "macro_f1_sd"))


def _contrast_sql(kind, unit):
    return (
        f"{_reps_sql(kind, 'rgc', 'region', unit)}, o{kind} AS (SELECT prs.a, prs.b, {ci_as('image' if kind == 'i' else 'cluster').replace('quantile_cont(', 'quantile_cont(d_')} FROM "
        f"(SELECT prs.a, prs.b, 100 * (x.accuracy - z.accuracy) AS d_accuracy, 100 * (x.macro_f1 - z.macro_f1) AS d_macro_f1 FROM prs JOIN r{kind} x ON x.region = prs.a JOIN r{kind} z ON z.region = prs.b AND x.boot = z.boot) prs GROUP BY prs.a, prs.b)"
    )


PRS = "prs AS (SELECT * FROM (VALUES ('full', 'no_bottom'), ('full', 'no_top'), ('no_top', 'no_bottom'), ('bottom_strip', 'top_strip')) t(a, b))"
CON = f"WITH RECURSIVE {sql.PAIRS}, {sql.components(0.4)}, {_region_sql()}, rgc AS (SELECT rg.*, cluster FROM rg JOIN cl USING (id)), {PRS}, pc AS (SELECT region, seed, y, p, count(*) AS n FROM rg GROUP BY ALL),{sql.f1('pc', 'region, seed', 'pt')}, pm AS (SELECT region, avg(accuracy) AS accuracy, avg(macro_f1) AS macro_f1 FROM pt GROUP BY region), {_contrast_sql('i', 'id')}, {_contrast_sql('c', 'cluster')}"


@query("bst5_q9_contrasts", CON + " SELECT prs.a, prs.b, round(100 * (x.accuracy - z.accuracy), 6) AS accuracy, round(100 * (x.macro_f1 - z.macro_f1), 6) AS macro_f1, oi.* EXCLUDE (a, b), oc.* EXCLUDE (a, b) FROM prs JOIN pm x ON x.region = prs.a JOIN pm z ON z.region = prs.b JOIN oi ON oi.a = prs.a AND oi.b = prs.b JOIN oc ON oc.a = prs.a AND oc.b = prs.b")
def contrasts(spark, d):
    """Paired contrasts in percentage points, on the same draws of images and of clusters."""
    p = gr.checkpointed(st.regions(spark, d))  # once for the point values and both draws
    pair = F.broadcast(spark.createDataFrame(list(rep.CONTRASTS), "a string, b string"))

    def differences(values, on):
        x, y = values.alias("x"), values.alias("y")
        both = pair.join(x, F.col("a") == F.col("x.region")).join(y, (F.col("b") == F.col("y.region")) & on)
        return both.select("a", "b", *((100 * (F.col(f"x.{v}") - F.col(f"y.{v}"))).alias(v) for v in BOTH))

    s = met.summary(met.cells(p, ["region", "seed"]), ["region", "seed"], K).groupBy("region").agg(*(F.avg(v).alias(v) for v in BOTH))
    out = differences(s, F.lit(True)).select("a", "b", *r6(*BOTH))
    clusters = _clusters(spark, d).withColumnRenamed("cluster", "unit")
    for suffix, rows in (("image", p.withColumn("unit", F.col("id"))), ("cluster", p.join(clusters, "id"))):
        reps = bs.seed_mean(bs.replicates(rows, ["region", "seed"], K, B), ["region"], BOTH)
        diff = bs.interval(differences(reps, F.col("x.boot") == F.col("y.boot")), ["a", "b"], BOTH).select("a", "b", *r6(*NAMES))
        out = out.join(_renamed(diff, ["a", "b"], suffix), ["a", "b"])
    return out


@query("q10_recall_by_region", REG + ", r AS (SELECT region, c, avg(CASE WHEN support > 0 THEN tp / support ELSE 0 END) AS recall FROM f1_c GROUP BY ALL) SELECT CAST(c AS INTEGER) AS c, " + ", ".join(f"round(max(CASE WHEN region = '{r}' THEN recall END), 6) AS {r}" for r in st.REGIONS) + " FROM r GROUP BY c")
def recall_by_region(spark, d):
    pc = met.per_class(met.cells(st.regions(spark, d), ["region", "seed"]), ["region", "seed"], K)
    wide = rep.recall_table(pc, [], "region", list(st.REGIONS))
    return wide.select("c", *(F.round(r, 6).alias(r) for r in st.REGIONS))


STRATA = f"WITH RECURSIVE {sql.PAIRS}, {sql.STRATIFIED}, {sql.components(0.4)}, {sql.pred()}, tr AS (SELECT DISTINCT cluster FROM cl JOIN strat USING (id) WHERE split = 'train'), fl AS (SELECT s.id, (tr.cluster IS NOT NULL) AS in_train FROM strat s JOIN cl ON cl.id = s.id LEFT JOIN tr ON tr.cluster = cl.cluster WHERE s.split = 'test'), cells AS (SELECT backbone, in_train, seed, y, p, count(*) AS n FROM m JOIN fl USING (id) GROUP BY ALL),{sql.f1('cells', 'backbone, in_train, seed')}"


@query("q3_bst6_strata", STRATA + " SELECT backbone, in_train, CAST(max(n) AS BIGINT) AS n, round(avg(accuracy), 6) AS accuracy, round(avg(macro_f1_present), 6) AS macro_f1_present FROM f1 GROUP BY backbone, in_train")
def strata(spark, d):
    s = sp.stratified(st.images(spark, d).select("id", "y"))
    flag = sp.neighbour_in_train(s.where("split = 'test'"), _clusters(spark, d), s)
    p = st.predictions(spark, d).join(flag, "id")
    by = ["backbone", "in_train"]
    got = met.summary(met.cells(p, [*by, "seed"]), [*by, "seed"], K)
    return got.groupBy(*by).agg(F.max("n").alias("n"), F.round(F.avg("accuracy"), 6).alias("accuracy"), F.round(F.avg("macro_f1_present"), 6).alias("macro_f1_present"))


@query("bst6_strata_ci")
def strata_ci(spark, d):
    """Cluster intervals within each stratum: clusters are drawn among those of the stratum."""
    s = sp.stratified(st.images(spark, d).select("id", "y"))
    c = gr.checkpointed(_clusters(spark, d))
    flag = sp.neighbour_in_train(s.where("split = 'test'"), c, s)
    p = st.predictions(spark, d).join(flag, "id").join(c.withColumnRenamed("cluster", "unit"), "id")
    by = ["backbone", "in_train"]
    reps = bs.replicates(p, [*by, "seed"], K, B, 0, ["in_train"])
    return bs.interval(bs.seed_mean(reps, by, ["accuracy", "macro_f1_present"]), by, ["accuracy", "macro_f1_present"]).select(*by, *r6("accuracy_lo", "accuracy_hi", "macro_f1_present_lo", "macro_f1_present_hi"))


E4 = f"WITH {sql.pred()}, un AS (SELECT DISTINCT id AS unit FROM m), {sql.draws('un', B)}, t AS (SELECT m.*, w, boot, list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) - z[y + 1] AS nll FROM m JOIN dr ON unit = id), reps AS (SELECT backbone, boot, sum(w * nll) / sum(w) AS nll, sum(w * CASE WHEN conf >= 0.9 THEN 1 ELSE 0 END) / sum(w) AS coverage, sum(w * CASE WHEN conf >= 0.9 THEN ok ELSE 0 END) / sum(w * CASE WHEN conf >= 0.9 THEN 1 ELSE 0 END) AS selective FROM t GROUP BY ALL)"


@query("bst7_selective_ci", E4 + f" SELECT backbone, {ci(['nll', 'coverage', 'selective'])} FROM reps GROUP BY backbone")
def selective_ci(spark, d):
    p = st.predictions(spark, d).withColumn("unit", F.col("id"))
    hit = F.when(F.col("conf") >= 0.9, 1.0).otherwise(0.0)
    terms = {"nll": (met.nll_term(F.col("z"), F.col("y")), F.lit(1.0)), "coverage": (hit, F.lit(1.0)), "selective": (hit * F.col("ok"), hit)}
    reps = bs.weighted_means(p, ["backbone"], terms, B)
    return bs.interval(reps, ["backbone"], list(terms)).select("backbone", *r6(*(f"{v}_{s}" for v in terms for s in ("lo", "hi"))))


EDGES = " + ".join(f"CASE WHEN conf > CAST({i} AS DOUBLE) / 15 THEN 1 ELSE 0 END" for i in range(1, 15))


@query("bst7_ece_ci", f"WITH {sql.pred()}, un AS (SELECT DISTINCT id AS unit FROM m), {sql.draws('un', B)}, bn AS (SELECT backbone, seed, boot, {EDGES} AS bin, sum(w) AS n, sum(w * ok) AS hit, sum(w * conf) AS c FROM m JOIN dr ON unit = id GROUP BY ALL), e AS (SELECT backbone, seed, boot, sum(abs(hit - c)) / sum(n) AS ece FROM bn GROUP BY backbone, seed, boot), reps AS (SELECT backbone, boot, avg(ece) AS ece FROM e GROUP BY backbone, boot) SELECT backbone, {ci(['ece'])} FROM reps GROUP BY backbone")
def ece_ci(spark, d):
    p = st.predictions(spark, d).select("backbone", "seed", F.col("id").alias("unit"), "conf", "ok", met.ece_bin(F.col("conf")).alias("bin"))
    bins = bs.weighted_sums(p, ["backbone", "seed", "bin"], {"n": F.lit(1), "hit": F.col("ok"), "conf": F.col("conf")}, B)
    e = met.ece_of_bins(bins, ["backbone", "seed", "boot"])
    return bs.interval(bs.seed_mean(e, ["backbone"], ["ece"]), ["backbone"], ["ece"]).select("backbone", *r6("ece_lo", "ece_hi"))


Q1 = (
    f"{MC}, {POINT}, {_reps_sql('i', 'mc', 'backbone', 'id')}, {_reps_sql('c', 'mc', 'backbone', 'cluster')}, oi AS (SELECT backbone, {ci_as('image')} FROM ri GROUP BY backbone), oc AS (SELECT backbone, {ci_as('cluster')} FROM rc GROUP BY backbone), "
    f"bn AS (SELECT backbone, seed, {EDGES} AS bin, count(*) AS n, sum(ok) AS hit, sum(conf) AS c FROM m GROUP BY ALL), e AS (SELECT backbone, round(avg(x), 6) AS ece FROM (SELECT backbone, seed, sum(abs(hit - c)) / sum(n) AS x FROM bn GROUP BY ALL) GROUP BY backbone), "
    "s AS (SELECT backbone, count(*) AS seeds, CAST(max(n) AS BIGINT) AS n, " + ", ".join(f"round(avg({v}), 6) AS {v}_mean, round(stddev_samp({v}), 6) AS {v}_sd" for v in BOTH) + " FROM pt GROUP BY backbone)"
)


@query("q1_main_table", Q1 + " SELECT * FROM s JOIN e USING (backbone) JOIN oi USING (backbone) JOIN oc USING (backbone)")
def main_table(spark, d):
    """A row a backbone: seeds, rows, means and deviations over seeds, calibration error, intervals over images and clusters.
    Images and clusters are the units of two strata, so both are drawn and added up at once."""
    p, by, run = gr.checkpointed(st.predictions(spark, d).select("backbone", "seed", "id", "y", "p", "ok", "conf")), ["backbone"], ["backbone", "seed"]  # once for all
    s = met.summary(met.cells(p, run), run, K)
    out = s.groupBy(*by).agg(F.count("*").alias("seeds"), *(F.round(f(v), 6).alias(f"{v}_{e}") for v in BOTH for f, e in ((F.avg, "mean"), (F.stddev_samp, "sd"))), F.max("n").alias("n"))
    out = out.join(met.ece(p, run).groupBy(*by).agg(F.round(F.avg("ece"), 6).alias("ece")), by)
    rows = p.select(*run, "id", "y", "p")
    units = rows.withColumn("kind", F.lit("image")).withColumn("unit", F.col("id")).unionByName(rows.join(_clusters(spark, d), "id").withColumn("kind", F.lit("cluster")).withColumnRenamed("cluster", "unit"))
    reps = bs.seed_mean(bs.replicates(units, ["kind", *run], K, B, 0, ["kind"]), ["kind", *by], BOTH)
    names = [f"{v}_{k}" for k in ("image", "cluster") for v in BOTH]
    wide = reps.select(*by, *(F.when(F.col("kind") == n.rpartition("_")[2], F.col(n.rpartition("_")[0])).alias(n) for n in names))
    return out.join(bs.interval(wide, by, names).select(*by, *r6(*(f"{n}_{e}" for n in names for e in ("lo", "hi")))), by)


SELECT_ON = (
    f"WITH {sql.STRATIFIED}, {sql.pred()}, va AS (SELECT m.* FROM m JOIN strat USING (id) WHERE split = 'train'), te AS (SELECT m.* FROM m JOIN strat USING (id) WHERE split <> 'train'), "
    "th AS (SELECT backbone, seed, min(CASE WHEN n >= 50 AND hit / n >= {target} THEN conf END) AS theta FROM (SELECT backbone, seed, conf, count(*) OVER t AS n, sum(ok) OVER t AS hit FROM va WINDOW t AS (PARTITION BY backbone, seed ORDER BY conf DESC)) GROUP BY ALL), "
)
PER_SEED = (
    "sv AS (SELECT backbone, seed, avg(CASE WHEN conf >= theta THEN 1.0 ELSE 0 END) AS val_coverage, avg(CASE WHEN conf >= theta THEN ok END) AS val_accuracy FROM va JOIN th USING (backbone, seed) GROUP BY ALL), "
    "se AS (SELECT backbone, seed, avg(ok) AS accuracy, avg(CASE WHEN conf >= theta THEN 1.0 ELSE 0 END) AS coverage, avg(CASE WHEN conf >= theta THEN ok END) AS selective_accuracy, avg(CASE WHEN ok = 0 THEN CASE WHEN conf < theta THEN 1 ELSE 0 END END) AS error_capture FROM te JOIN th USING (backbone, seed) GROUP BY ALL), "
    "w AS (SELECT backbone, seed, ok, row_number() OVER o AS k, sum(ok) OVER (PARTITION BY backbone, seed ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING) AS hits, count(*) OVER (PARTITION BY backbone, seed) AS n FROM te WINDOW o AS (PARTITION BY backbone, seed ORDER BY conf DESC, id)), "
    "sw AS (SELECT backbone, seed, avg(1 - hits / k) AS aurc, avg(CASE WHEN k <= greatest(1, round_even(n * 0.9, 0)) THEN ok END) AS acc_at_90, avg(CASE WHEN k <= greatest(1, round_even(n * 0.95, 0)) THEN ok END) AS acc_at_95 FROM w GROUP BY ALL)"
)
SELECTED = ("theta", "val_coverage", "val_accuracy", "coverage", "selective_accuracy", "error_capture", "accuracy", "aurc", "acc_at_90", "acc_at_95")


def _selected(spark, d, target):
    run = ["backbone", "seed"]
    p = st.predictions(spark, d).join(sp.stratified(st.images(spark, d).select("id", "y")).select("id", "split"), "id")
    theta = cal.threshold(p.where("split = 'train'"), run, target)
    val, s = (p.where(w).join(F.broadcast(theta), run) for w in ("split = 'train'", "split <> 'train'"))
    seen = cal.selective(val, run).select(*run, F.col("coverage").alias("val_coverage"), F.col("selective_accuracy").alias("val_accuracy"))
    whole = s.groupBy(*run).agg(F.avg(F.col("ok").cast("double")).alias("accuracy"))
    return cal.selective(s, run).join(whole, run).join(seen, run).join(cal.aurc(s, run), run).join(cal.accuracy_at_coverage(s, run, [0.9, 0.95]), run).join(theta, run)


def _table_sql(target):
    means = ", ".join(f"CASE WHEN count(theta) = count(*) THEN round(avg({c}), 6) END AS {c}" if c in SELECTED[:6] else f"round(avg({c}), 6) AS {c}" for c in SELECTED)
    return SELECT_ON.replace("{target}", str(target)) + PER_SEED + f" SELECT backbone, count(*) AS seeds, count(theta) = count(*) AS attainable, {means} FROM th JOIN sv USING (backbone, seed) JOIN se USING (backbone, seed) JOIN sw USING (backbone, seed) GROUP BY backbone"


def _table(spark, d, target):
    per, all_seeds = _selected(spark, d, target), F.count("theta") == F.count("*")
    mean = lambda c: F.round(F.avg(c), 6)
    return per.groupBy("backbone").agg(F.count("*").alias("seeds"), all_seeds.alias("attainable"), *((F.when(all_seeds, mean(c)) if c in SELECTED[:6] else mean(c)).alias(c) for c in SELECTED))


@query("q12_selective_table", _table_sql(0.95))
def selective_table(spark, d):
    """Thresholds of the larger part of a stratified split, what they give there and on the rest, as seed means; where a seed
    has no threshold the target isn't attainable, and what depends on it is null."""
    return _table(spark, d, 0.95)


@query("q12_not_attainable", _table_sql(1.1))
def not_attainable(spark, d):
    return _table(spark, d, 1.1)


def _split_sql(name, variant, split):
    """A row of the split report for a table (id, y, split, cluster)."""
    tab = ", ".join(f"count(*) FILTER (WHERE split = '{x}') AS {x}" for x in ("train", "val", "test"))
    return (
        f"SELECT '{variant}' AS variant, * FROM (SELECT count(*) AS n, {tab} FROM {split}), (SELECT min(least(v, t)) AS least FROM (SELECT y, count(*) FILTER (WHERE split = 'val') AS v, count(*) FILTER (WHERE split = 'test') AS t FROM {split} GROUP BY y)), "
        f"(SELECT count(*) AS pairs, count(*) FILTER (WHERE x.split <> z.split) AS crossing FROM pairs JOIN {split} x ON x.id = a JOIN {split} z ON z.id = b WHERE v >= 0.4), "
        f"(SELECT count(*) FILTER (WHERE k > 1) AS spanning, count(*) AS clusters, count(*) FILTER (WHERE size = 1) AS singletons, max(size) AS largest, CAST(coalesce(sum(size) FILTER (WHERE size >= 3), 0) AS BIGINT) AS in_big FROM (SELECT cluster, count(*) AS size, count(DISTINCT split) AS k FROM {split} GROUP BY cluster))"
    )


@query("q16_split_report", f"WITH RECURSIVE {sql.PAIRS}, {sql.STRATIFIED}, {sql.components(0.4)}, rs AS (SELECT strat.*, cluster FROM strat JOIN cl USING (id)) " + _split_sql("r", "random", "rs"))
def split_report(spark, d):
    return _split_rows(spark, d, ["random"])


def _split_rows(spark, d, variants):
    """Of each variant: sizes of the parts, the least of a class in val or test, pairs that cross parts, clusters that span
    them, and the clusters' statistics."""
    pairs = gr.checkpointed(sim.cosine_pairs(sim.centre(st.images(spark, d)), 0.4))
    c = gr.checkpointed(gr.connected(st.images(spark, d), pairs).join(st.images(spark, d).select("id", "y"), "id"))
    out = None
    for name in variants:
        split = sp.stratified(st.images(spark, d).select("id", "y")).join(c.select("id", "cluster"), "id") if name == "random" else sp.by_clusters(c)
        split = gr.checkpointed(split)
        parts = split.agg(F.count("*").alias("n"), *(F.count_if(F.col("split") == x).alias(x) for x in ("train", "val", "test")))
        least = sp.crosstab(split).agg(F.min("least").alias("least"))
        size = split.groupBy("cluster").agg(F.count("*").alias("size"))
        stats = size.agg(F.count("*").alias("clusters"), F.count_if(F.col("size") == 1).alias("singletons"), F.max("size").alias("largest"), F.coalesce(F.sum(F.when(F.col("size") >= 3, F.col("size"))), F.lit(0)).alias("in_big"))
        one = parts.crossJoin(least).crossJoin(sp.crossing(pairs, split, [0.4]).select("pairs", "crossing")).crossJoin(sp.spanning(split)).crossJoin(stats)  # one row each
        one = one.select(F.lit(name).alias("variant"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("q16_group_report")
def group_report(spark, d):
    return _split_rows(spark, d, ["group:0.4"])


@query("q4_sensitivity", REG + " SELECT region AS variant, CAST(n AS BIGINT) AS n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM f1 WHERE seed = 0")
def sensitivity(spark, d):
    """One seed's metrics under every variant; the regions stand in for the variants."""
    s = met.summary(met.cells(st.regions(spark, d).where("seed = 0"), ["region"]), ["region"], K)
    return s.select(F.col("region").alias("variant"), "n", *r6("accuracy", "macro_f1"))


@query("q7_report_json")
def report_json(spark, d):
    """The main table as one JSON document."""
    rows = main_table(spark, d)
    return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).alias("report"))
