"""Hand-computed values of metrics, calibration, bands, names and vectors."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions import names as nm
from sieveline.functions import vectors as v
from sieveline.operators import bands, bootstrap, calibration, draws, metrics


def predictions(spark, y, p):
    return spark.createDataFrame([(1, int(a), int(b)) for a, b in zip(y, p)], "g int, y int, p int")


def test_metrics_of_a_small_table(spark):
    # class 0: 2 of 3 found, one more predicted; class 1: 1 of 2 found; class 2: nothing found; class 3: never seen
    y, p = [0, 0, 0, 1, 1, 2], [0, 0, 1, 1, 0, 0]
    s = metrics.summary(metrics.cells(predictions(spark, y, p), ["g"]), ["g"], 4).first()
    f = [2 * 2 / (3 + 4), 2 * 1 / (2 + 2), 0, 0]
    assert s.macro_f1 == pytest.approx(sum(f) / 4) and s.macro_f1_present == pytest.approx(sum(f) / 3) and s.accuracy == pytest.approx(3 / 6) and s.n == 6
    c = {(r.y, r.p): r.n for r in metrics.confusion(predictions(spark, y, p), ["g"], 4).collect()}
    assert len(c) == 16 and {k: n for k, n in c.items() if n} == {(0, 0): 2, (0, 1): 1, (1, 1): 1, (1, 0): 1, (2, 0): 1}


def test_calibration_error_is_the_weighted_distance_of_bins(spark):
    # 3 rows about 0.2 of which one is right, 5 rows about 0.9 of which four are
    rows = [(1, x, o) for x, o in ((0.18, 0), (0.19, 1), (0.2, 0), (0.88, 1), (0.89, 1), (0.9, 0), (0.91, 1), (0.92, 1))]
    got = metrics.ece(spark.createDataFrame(rows, "g int, conf double, ok int"), ["g"]).first().ece
    assert got == pytest.approx((abs(1 - 0.57) + abs(4 - 4.5)) / 8)


def test_ece_bins_are_closed_on_the_right(spark):
    xs = [0.0, 1e-9, 1 / 15, 1 / 15 + 1e-9, 0.5, 1.0]
    got = [r.b for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(metrics.ece_bin(F.col("x")).alias("b")).collect()]
    assert got == [0, 0, 0, 1, 7, 14]


def confident(spark, conf, ok):
    return spark.createDataFrame([(1, i, float(c), int(o)) for i, (c, o) in enumerate(zip(conf, ok))], "g int, pos int, conf double, ok int")


def test_thresholds_take_ties_whole(spark):
    # accuracy from above: 1, 1, 2/3 (tie of two at .6, one right), 4/6, 4/7
    p = confident(spark, [0.95, 0.85, 0.6, 0.6, 0.41, 0.4, 0.2], [1, 1, 0, 0, 1, 1, 0])
    theta = lambda target, least: calibration.threshold(p, ["g"], target, least).first().theta
    assert [theta(1.0, 1), theta(1.0, 3), theta(0.5, 4), theta(0.6, 5), theta(0.55, 7)] == [0.85, None, 0.2, 0.4, 0.2]


def test_acceptance_at_a_threshold(spark):
    p = confident(spark, [0.99, 0.7, 0.7, 0.55, 0.3], [1, 0, 1, 0, 0])
    s = calibration.selective(p.withColumn("theta", F.lit(0.7)), ["g"]).first()
    assert s.coverage == pytest.approx(3 / 5) and s.selective_accuracy == pytest.approx(2 / 3) and s.error_capture == pytest.approx(2 / 3)
    assert calibration.selective(p.withColumn("theta", F.lit(1.0)), ["g"]).first().selective_accuracy is None
    at = calibration.accuracy_at_coverage(p, ["g"], [0.2, 0.5, 0.9]).first()  # 1, 2 (2.5 to even) and 4 (4.5 to even) rows
    assert (at.acc_at_20, at.acc_at_50, at.acc_at_90) == (1.0, 0.5, 0.5)


def test_temperature_has_no_slope_and_scales_with_the_logits(spark):
    rows = []
    for i in range(420):
        y = i % 3
        z = [math.sin(0.7 * i + 2 * c) + (1.1 if c == y else 0.0) for c in range(3)]
        rows += [(1, y, z), (2, y, [2.5 * x for x in z]), (3, y, [1000 * x for x in z]), (4, 0, [1.0, 0.0, 0.0])]
    got = {r.g: r.temperature for r in calibration.fit_temperature(spark.createDataFrame(rows, "g int, y int, z array<double>"), ["g"]).collect()}
    assert got[2] == pytest.approx(2.5 * got[1], rel=1e-6) and got[3] == pytest.approx(10, rel=1e-6) and got[4] == pytest.approx(0.05, rel=1e-6)

    def loss(t):
        return sum(math.log(sum(math.exp(x / t) for x in z)) - z[y] / t for g, y, z in rows if g == 1)

    assert loss(got[1]) < min(loss(got[1] * 1.001), loss(got[1] / 1.001))


def test_early_stopping(spark):
    h = [0.1, 0.3, 0.3, 0.2, 0.5, 0.4, 0.4, 0.4, 0.9]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(h)], "g int, epoch int, val_macro_f1 double")
    r = calibration.best_epoch(df, ["g"], 3).first()
    assert (r.best_epoch, r.best, r.epochs_run) == (4, 0.5, 7)


def masks(spark, *rows):
    return spark.createDataFrame([(i, [bool(x) for x in r]) for i, r in enumerate(rows)], "id int, m array<boolean>")


def test_runs(spark):
    df = masks(spark, [0, 1, 1, 0, 1, 1, 1, 0], [0, 0], [1, 1, 0, 1, 1])
    got = {r.id: (r.start, r.len) for r in bands.longest_run(df, ["id"], "m").collect()}
    assert got == {0: (4, 3), 1: (0, 0), 2: (0, 2)}
    assert {r.id: r.start for r in bands.longest_run(df, ["id"], "m", -1).collect()}[1] == -1
    assert sorted((r.id, r.start, r.len) for r in bands.runs(masks(spark, [0, 1, 1, 0, 1]), ["id"], "m").collect()) == [(0, 1, 2), (0, 4, 1)]


def test_missing_rows_are_neither_bright_nor_dark(spark):
    df = spark.createDataFrame([([math.nan, 250.0, 5.0, None],)], "h array<double>")
    r = df.select(bands.bright(F.col("h")).alias("b"), bands.dark(F.col("h")).alias("d")).first()
    assert r.b == [False, True, False, False] and r.d == [False, False, True, False]


def test_unknown_names_are_errors(spark):
    df = spark.createDataFrame([("group:0.90", "full"), ("odd", "odd")], "v string, r string")
    assert df.where("v <> 'odd'").select(nm.canonical_variant(F.col("v")).alias("v")).first().v == "group:0.9"
    for c in (nm.canonical_variant(F.col("v")), bands.region_rows(F.lit(384), F.col("r"))):
        with pytest.raises(Exception, match="unknown"):
            df.where("v = 'odd'").select(c.alias("c")).collect()


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], [0.0, 0.0, 0.0])], "z array<double>, o array<double>")
    r = df.select(v.argmax(F.col("z")).alias("a"), v.softmax(F.col("z")).alias("s"), v.log_softmax(F.col("z")).alias("l"), v.confidence(F.col("z"), 2.0).alias("c"), v.top_k(F.col("z"), 2).alias("t"), v.l2_normalise(F.col("o")).alias("n")).first()
    e = np.exp([1, 3, 3])
    assert r.a == 1 and np.allclose(r.s, e / e.sum()) and np.allclose(r.l, np.log(e / e.sum())) and [t.i for t in r.t] == [1, 2] and r.n == [0, 0, 0]
    assert r.c == pytest.approx(1 / (2 + math.exp(-1)))


def test_equality_is_accepted(spark):
    assert spark.range(1).select(v.uncertain(F.lit(0.915), 0.915).alias("u")).first().u is False


def test_hash_codes(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=63)
    g = rng.uniform(0, 255, size=(8, 9))
    gray = rng.uniform(0, 255, size=(32, 32))
    df = spark.createDataFrame([(c.tolist(), g.ravel().tolist(), gray.ravel().tolist())], "c array<double>, g array<double>, x array<double>")
    r = df.select(v.pack_bits(v.phash_bits(F.col("c"))).alias("p"), v.dhash(F.col("g")).alias("d"), v.phash_coefficients(F.col("x")).alias("k")).first()
    bits = lambda b: int("".join("01"[int(x)] for x in b).ljust(64, "0"), 2)
    assert r.p % 2**64 == bits(c > np.median(c)) and r.d % 2**64 == bits((g[:, 1:] > g[:, :-1]).ravel())
    m = np.array(v.dct_low())
    assert np.allclose(r.k, (m @ gray @ m.T).ravel()[1:])


def test_intervals_over_clusters_of_equal_rows_are_wider(spark):
    # 40 clusters of 6 rows that are all right or all wrong
    rows = [(1, 6 * c + j, c, 0, int(c % 4 == 0)) for c in range(40) for j in range(6)]
    df = spark.createDataFrame(rows, "g int, id long, grp long, y int, p int")
    width = {}
    for unit in ("id", "grp"):
        r, again = (bootstrap.interval(bootstrap.replicates(df.withColumn("unit", F.col(unit)), ["g"], 2, 150, 5), ["g"], ["accuracy"]).first() for _ in range(2))
        assert r == again and r.accuracy_lo < 0.75 < r.accuracy_hi
        width[unit] = r.accuracy_hi - r.accuracy_lo
    assert width["grp"] > 1.7 * width["id"]


def test_units_are_numbered_alike_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(i % 2, 7 * i % 101) for i in range(300)], "s int, unit long")
    for by in ([], ["s"]):
        whole = sorted(map(tuple, bootstrap.numbered(df, by).collect()))
        monkeypatch.setattr(bootstrap, "PART", 10)
        assert sorted(map(tuple, bootstrap.numbered(df, by).collect())) == whole
        monkeypatch.undo()
        units = sorted({r[-3] for r in whole})
        assert by or [r[1] for r in whole] == list(range(len(units)))


def test_sums_over_drawn_units_make_no_table_of_draws(spark, monkeypatch):
    df = spark.createDataFrame([(i % 2, ("a", "b", None)[i % 3], 7 * i % 101, i / 8) for i in range(300)], "s int, y string, unit long, x double")
    values = {"n": F.lit(1), "x": F.col("x")}
    for stratum in ([], ["s"]):
        joined = df.join(bootstrap.draws(df, 12, 3, stratum), [*stratum, "unit"]).groupBy("s", "y", "boot").agg(F.sum("w").alias("n"), F.sum(F.col("x") * F.col("w")).alias("x"))
        want = sorted(map(str, joined.collect()))
        monkeypatch.setattr(bootstrap, "draws", None)
        for held in (bootstrap.HELD, 500):  # in one block, and in some
            monkeypatch.setattr(bootstrap, "HELD", held)
            assert sorted(map(str, bootstrap.weighted_sums(df, ["s", "y"], values, 12, 3, stratum).collect())) == want
        bootstrap.replicates(df.selectExpr("s", "unit", "0 AS y", "s AS p"), ["s"], 2, 3, 0, stratum).collect()
        monkeypatch.undo()


def test_drawn_units_are_those_of_md5():
    for seed, boot, n in ((0, 1, 1), (1, 37, 1234), (12345, 1000, 20001)):
        j = [int(hashlib.md5(f"{seed}-{boot}-{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
        assert (draws.counts(seed, boot, n) == np.bincount(j, minlength=n)).all()
