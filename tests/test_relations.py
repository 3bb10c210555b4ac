"""Splits, graphs, similarity joins, runs, files and access rules."""

import io
import itertools
import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import audit, graph, reporting, similarity, splits, validation
from sieveline.sources import archives, documents


def long_splits(spark):
    rows = [(i, f"f{i}.jpg", "abc"[i % 3], v, i // 2, ("train", "train", "val", "test")[i % 4]) for i in range(12) for v in ("random", "group:0.9", "group:0.94")]
    return spark.createDataFrame(rows, "id int, file string, class string, variant string, cluster long, split string")


def test_the_test_part_is_guarded(spark):
    s = long_splits(spark)
    with pytest.raises(PermissionError):
        splits.get_split(s, "random", ["test"])
    with pytest.raises(ValueError):
        splits.get_split(s, "random", ["dev"])
    with pytest.raises(KeyError):
        splits.get_split(s, "group:0.5", ["train"])
    assert splits.get_split(s, "group:0.90", ["train", "val", "test"], allow_test=True).count() == 12
    assert splits.get_split(s, "random", ["train"]).count() + splits.get_split(s, "random", ["val"]).count() == 9


def test_components_make_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(len(b))
            yield b

    edges = spark.range(0, 50, 1, 1).selectExpr("id AS a", "id + 1 AS b").mapInArrow(seen, "a long, b long")
    assert graph.connected(spark.range(51), edges).where("cluster = 0").count() == 51 and made.value == 50


def test_group_split_keeps_clusters_whole(spark):
    rng = np.random.default_rng(3)
    cluster = np.repeat(np.arange(300), rng.integers(1, 8, 300))
    rows = [(i, int(rng.integers(4)), int(c)) for i, c in enumerate(cluster)]
    df = spark.createDataFrame(rows, "id long, y int, cluster long")
    for exact in (10**6, 10):
        got = splits.by_clusters(df, exact=exact)
        assert got.count() == len(rows) and splits.spanning(got).first().spanning == 0
        n = {r.split: r.n for r in got.groupBy("split").agg(F.count("*").alias("n")).collect()}
        assert abs(n["train"] / len(rows) - 0.7) < 0.02


def test_group_split_is_the_same_at_any_size(spark):
    rows = [(i, i % 3, i // 3 if i < 60 else i) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, y int, cluster long")
    one, other = (sorted(map(tuple, splits.by_clusters(df, exact=n).collect())) for n in (10**6, 10))
    assert one == other


def test_greedy_prefers_the_first_of_equals():
    assert splits.assign([{0: 10}])[0] == 0
    assert sorted(set(splits.assign([{0: 1}] * 20))) == [0, 1, 2]


def test_verify_raises_on_leaks(spark):
    pairs = spark.createDataFrame([(1, 2, 0.95)], "a long, b long, v double")
    s = spark.createDataFrame([(1, 0, 1, "train"), (2, 0, 1, "test")], "id long, y int, cluster long, split string")
    with pytest.raises(AssertionError):
        splits.verify(pairs, s, 0.9)
    splits.verify(pairs, s.where("id = 1"), 0.99)


def test_components(spark):
    nodes = spark.range(40)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 35), (35, 31)], "a long, b long")
    got = {r.id: r.cluster for r in graph.connected(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[31] == got[35] == 30 and got[25] == 25 and len(got) == 40


@pytest.mark.parametrize("held", [1_000_000, 150, 20])  # one task; several, then one; several, whose trees don't halve
def test_components_by_trees_equal_those_by_rounds(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "HELD", held)
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in np.r_[rng.integers(0, 90, (400, 2)), rng.integers(100, 180, (40, 2))]] + [(5, 5), (190, 190)]
    df, nodes = spark.createDataFrame(edges, "a long, b long"), spark.range(200)
    parts = lambda f, e: sorted(map(tuple, f(nodes, e).collect()))
    assert parts(graph.joined, df) == parts(graph.connected, df)
    assert parts(graph.joined, df.where("a < 0")) == [(i, i) for i in range(200)]


@pytest.mark.parametrize("block,part,held", [(1000, 20_000, 1_000_000), (7, 5, 40)])
def test_near_copies_are_counted_where_they_meet(spark, monkeypatch, block, part, held):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "PART", part)
    monkeypatch.setattr(graph, "HELD", held)
    rng = np.random.default_rng(6)
    x, codes = rng.normal(size=(90, 5)), rng.integers(-(2**63), 2**63, 30)
    x[60:] = x[:30] + 0.1 * rng.normal(size=(30, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = [int(codes[i % 30]) ^ sum(1 << int(b) for b in rng.choice(63, i % 7, replace=False)) for i in range(90)]
    y = [None if i % 11 == 0 else i % 3 for i in range(90)]
    df = spark.createDataFrame([(i * 7 % 90, y[i], codes[i], x[i].tolist()) for i in range(90)], "id long, y int, code long, x array<double>")
    at = {i * 7 % 90: i for i in range(90)}
    dist = {(a, b): ((codes[at[a]] ^ codes[at[b]]) & (2**64 - 1)).bit_count() for a, b in itertools.combinations(range(90), 2) if x[at[a]] @ x[at[b]] >= 0.3}
    got = similarity.alike_statistics(df, (4, 9), 0.3).cache()
    counts = {r.t: (r.n, r.same, r.cross) for r in got.groupBy("t").agg(F.sum("pairs").alias("n"), F.sum("same").alias("same"), F.sum("cross").alias("cross")).collect()}
    edges = {t: [p for p, n in dist.items() if n <= t] for t in (4, 9)}
    kinds = lambda t, f: sum(y[at[a]] is not None and y[at[b]] is not None and f(y[at[a]], y[at[b]]) for a, b in edges[t])
    assert counts == {t: (len(edges[t]), kinds(t, lambda p, q: p == q), kinds(t, lambda p, q: p != q)) for t in (4, 9)}
    links = got.where("a IS NOT NULL").select("t", "a", "b")
    assert {(r.a, r.b) for r in links.where("t = 4").collect()} <= set(edges[4])
    nodes = spark.range(90).crossJoin(spark.createDataFrame([(4,), (9,)], "t int"))
    all_edges = spark.createDataFrame([(t, *p) for t in edges for p in edges[t]], "t int, a long, b long")
    parts = lambda e, few: sorted(map(tuple, graph.connected(nodes, e, by=["t"], few=few).select("t", "id", "cluster").collect()))
    assert parts(links, True) == parts(all_edges, False)


def test_links_join_trees_that_meet_beside_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    axis = np.eye(4)
    x = np.r_[np.repeat(axis[:1], 40, axis=0), np.repeat(axis[1:2], 9, axis=0), axis[2:], [(axis[2] + axis[3]) / 2**0.5]]  # a large tree, a small one, and two rows that a third joins
    df = spark.createDataFrame([(i * 37 % 52, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    found = [sorted((r.id, r.cluster) for r in graph.joined(df, f(df, 0.7)).collect()) for f in (similarity.cosine_links, similarity.cosine_pairs)]
    assert found[0] == found[1] and len({c for _, c in found[0]}) == 3


@pytest.mark.parametrize("block,group", [(1000, 100_000), (7, 20)])
def test_pairs_equal_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "GROUP", group)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if x[i] @ x[j] >= 0.4}
    assert {(r.a, r.b) for r in similarity.cosine_pairs(df, 0.4).collect()} == want
    links = similarity.cosine_links(df, 0.4).cache()
    parts = lambda edges: {r.id: r.cluster for r in graph.connected(df, edges).collect()}
    assert {(r.a, r.b) for r in links.collect()} <= want and parts(links) == parts(spark.createDataFrame(sorted(want), "a long, b long"))
    stats = similarity.cosine_statistics(df, 0.1).cache()
    best = {r.id: r.v for r in similarity.nearest(stats).collect()}
    assert len(best) == 60 and all(abs(best[i] - max(x[i] @ x[j] for j in range(60) if j != i)) < 1e-9 for i in range(60))
    bins = {}
    for i, j in itertools.combinations(range(60), 2):
        k = int(np.floor((x[i] @ x[j] + 1) / 0.1))
        bins[k] = bins.get(k, 0) + 1
    assert {r.bin: r.n for r in similarity.histogram(stats).collect()} == bins
    codes = rng.integers(-(2**63), 2**63, 50).tolist()
    codes += [c ^ (1 << int(b)) for c, b in zip(codes[:10], rng.integers(0, 63, 10))] + codes[:3]
    cd = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
    dist = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    all_pairs = {(i, j): dist(codes[i], codes[j]) for i, j in itertools.combinations(range(len(codes)), 2)}
    for limit in (0, 2, 7, 8, 30):
        got = {(r.a, r.b): r.dist for r in similarity.hamming_pairs(cd, limit).collect()}
        assert got == {k: v for k, v in all_pairs.items() if v <= limit}
    hist = {r.dist: r.n for r in similarity.distance_histogram(cd).collect()}
    assert sum(hist.values()) == len(all_pairs) and hist[0] == 3 and hist[1] >= 10


def runs(spark):
    rows = [("a", "random", "b", 0, "s1", True, "full"), ("b", "random", "b", 1, "s0", True, "full"), ("c", "group:0.9", "b", 0, "s0", True, "full"), ("d", "random", "b", 2, "s1", True, "no_top"), ("e", "random", "b", 3, "s1", False, "full")]
    return spark.createDataFrame(rows, "run_id string, variant string, backbone string, seed int, splits_sha256 string, done boolean, region string")


def test_runs_are_filtered_with_reasons(spark):
    kept, skipped = reporting.load_runs(runs(spark), "s1", ("s0",))
    assert {r.run_id for r in kept.collect()} == {"a", "b"}
    assert {r.run_id: r.reason for r in skipped.collect()} == {"c": "other splits", "d": "region run", "e": "not finished"}
    with pytest.raises(ValueError):
        reporting.load_runs(runs(spark).union(runs(spark).where("run_id = 'a'")), "s1")


def test_runs_need_the_same_images(spark):
    p = spark.createDataFrame([(s, i, 0) for s in (0, 1) for i in range(3)], "seed int, id long, y int").withColumn("g", F.lit(1))
    reporting.check_same(p, ["g"], ["seed"])
    with pytest.raises(ValueError):
        reporting.check_same(p.where("NOT (seed = 1 AND id = 2)"), ["g"], ["seed"])


def test_manifest_round_trip(spark, tmp_path):
    f = spark.createDataFrame([("A/x_one.jpg", "s" * 64, "A", 5, 6), ("B/y_two.jpg", "s" * 64, "B", 5, 6), ("A/z_three.v2.jpg", "t" * 64, "A", 7, 8)], "name string, sha string, cls string, w int, h int")
    m = audit.manifest(f, "cls", "name", "sha", "w", "h")
    documents.write_manifest(m, str(tmp_path / "m"))
    back = documents.read_manifest(spark, [str(tmp_path / "m")])
    assert {r.cache_name for r in back.collect()} == {"A/one__ssssssss.jpg", "A/three.v2__tttttttt.jpg"}
    assert {r.note for r in documents.read_manifest(spark, [str(tmp_path / "m")], False).collect()} == {"kept;orig_size=5x6", "kept;orig_size=7x8", "dropped_exact_duplicate_of:A/x_one.jpg"}


def test_split_documents_round_trip(spark, tmp_path):
    s = long_splits(spark).withColumn("cluster", F.when(F.col("variant") != "random", F.col("cluster")))
    documents.write_splits(s, str(tmp_path / "s"), 42)
    back = documents.read_splits(spark, str(tmp_path / "s"))
    key = lambda t: sorted((r.id, r.file, r["class"], r.variant, r.cluster if r.cluster is not None else -1, r.split) for r in t.collect())
    assert key(back) == key(s) and documents.identical_random(s, back)


def test_tar_in_zip(spark, tmp_path):
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as t:
        for name, data in (("A/a.jpg", b"one"), ("A/b.jpg", b"two")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("A.tar", inner.getvalue())
    spark.dataSource.register(archives.TarInZip)
    got = {r.name: (bytes(r.content), r.bytes) for r in spark.read.format("tarinzip").load(str(tmp_path / "*.zip")).collect()}
    assert got == {"A/a.jpg": (b"one", 3), "A/b.jpg": (b"two", 3)}
    assert archives.archive_totals(str(tmp_path / "x.zip"))[0] == (tmp_path / "x.zip").stat().st_size


def test_image_index(spark, tmp_path):
    for d, n in (("a", "x.jpg"), ("b", "y.JPG"), ("b", "z.txt")):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / n).write_bytes(b"1")
    assert {r.base for r in archives.index_images(spark, str(tmp_path)).collect()} == {"x.jpg", "y.JPG"}
    (tmp_path / "b" / "x.jpg").write_bytes(b"2")
    with pytest.raises(ValueError):
        archives.index_images(spark, str(tmp_path))


def test_run_folders(spark, tmp_path):
    for name, done in (("r1", True), ("r2", False)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "config.json").write_text(json.dumps({"run_id": name, "variant": "random", "backbone": "b", "seed": 0, "classes": ["x"], "splits_sha256": "s", "cfg": {"region": "full"}}, indent=1))
        if done:
            (tmp_path / name / "done.flag").write_text("")
    assert {r.run_id: r.done for r in documents.read_runs(spark, str(tmp_path)).collect()} == {"r1": True, "r2": False}


def test_predictions_are_written_once(spark, tmp_path):
    p = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, y int")
    documents.write_predictions(p, str(tmp_path / "p"))
    documents.write_predictions(p.union(spark.createDataFrame([("r3", 3)], p.schema)), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_uploads(spark):
    png, jpg = b"\x89PNG\r\n\x1a\n1234", b"\xff\xd8\xff\xe0abcdef"
    rows = [(0, bytearray(png)), (1, bytearray(jpg)), (2, bytearray(b"GIF89a..")), (3, bytearray(b"")), (4, None), (5, bytearray(png * 20))]
    df = spark.createDataFrame(rows, "i int, c binary").select("i", validation.upload_problem(F.col("c"), 100).alias("p"), validation.side_problem(F.lit(10), F.lit(50)).alias("s"))
    assert {r.i: r.p for r in df.collect()} == {0: None, 1: None, 2: "not PNG or JPEG", 3: "empty", 4: "empty", 5: "too large"}
    assert {r.s for r in df.collect()} == {"too small"}


def test_missing_rows_are_named(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("x", 1)], "k string, v int")
    with pytest.raises(FileNotFoundError, match="y"):
        validation.resolve(a, b, "k")
    with pytest.raises(ValueError):
        validation.require_unique(a.union(a), ["k"])
    assert [(r.k, r.side) for r in validation.set_difference(a, b, "k").collect()] == [("y", "left")]


def test_streams(spark, tmp_path):
    from sieveline.streaming import dedup

    src = tmp_path / "in"
    rows = [("a", "2024-01-01 00:00:00", 0, 0), ("a", "2024-01-01 00:01:00", 1, 0), ("b", "2024-01-01 00:02:00", 1, 1)]
    df = spark.createDataFrame(rows, "k string, ts string, y int, p int").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(src))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(src))
    for name, out, mode in (("firsts", dedup.first_of_content(stream(), "k", "ts"), "append"), ("acc", dedup.windowed_accuracy(stream(), "ts"), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert {r.k for r in spark.table("firsts").collect()} == {"a", "b"} and spark.table("firsts").count() == 2
    assert spark.table("acc").first().n == 3


def test_markdown(spark):
    t = spark.createDataFrame([("x", 0.5, None)], "a string, b double, c int")
    assert reporting.markdown(t).splitlines()[-1] == "| x | 0.5000 | — |"


def test_broken_archives_tell_what_they_skip(spark, tmp_path):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as tar:
        for name, size in (("a.jpg", 700), ("b.jpg", 5000)):
            info = tarfile.TarInfo(name)
            info.size = size
            tar.addfile(info, io.BytesIO(bytes(size)))
    (tmp_path / "whole.tar").write_bytes(buffer.getvalue())
    (tmp_path / "cut.tar").write_bytes(buffer.getvalue()[:4000])
    spark.dataSource.register(archives.TarInZip)
    rows = spark.read.format("tarinzip").load(str(tmp_path / "*.tar"))
    assert sorted((r.archive.rsplit("/", 1)[1], r.name, r.bytes) for r in archives.readable(rows).collect()) == [("cut.tar", "a.jpg", 700), ("whole.tar", "a.jpg", 700), ("whole.tar", "b.jpg", 5000)]
    assert [r.archive.rsplit("/", 1)[1] for r in archives.skipped(rows).collect()] == ["cut.tar"]


def test_feature_files_reports_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(5)], "id long, name string, x double")
    documents.write_features(df, str(tmp_path / "f/one"))
    documents.write_features(df.where("id > 99"), str(tmp_path / "f/one"))
    got = documents.feature_files(spark, str(tmp_path / "f"))
    assert got.count() == 5 and all(r.file.endswith(".parquet") for r in got.collect())
    documents.write_csv(df, str(tmp_path / "csv"), ("x",))
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert back.columns == ["id", "name"] and back.count() == 5
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text('{\n "archive": "a",\n "n": 3\n}')
    assert [(r.archive, r.n) for r in documents.archive_reports(spark, str(tmp_path / "r")).collect()] == [("a", 3)]
    assert [r.id for r in audit.ordered_prefix(df.orderBy("x", ascending=False), ["id"], 2).collect()] == [0, 1] and audit.ordered_prefix(df, ["id"], None).count() == 5
