"""The pipeline's stages against plain Python on the same rows."""

import corpus_pipeline as cp
from tests.llm.test_operators import brute_components, shingles


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing", "sharding"]
    good = cp.quality_classifier(spark, docs, small).cache()
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    one = cp.ngram_jaccard(spark, good, small).cache()
    rows = sorted(good.collect(), key=lambda r: r.doc_id)
    roots = brute_components([r.text for r in rows], 5, 80, 100)
    assert {r.doc_id for r in one.collect()} == {rows[i].doc_id for i, (_, root) in roots.items() if root == i}
    assert one.columns == docs.columns
    clean = cp.benchmark_decontamination(spark, one, small).cache()
    sets = [shingles(t, 5) for t in bench]
    want = {r.doc_id for r in one.collect() if not any(100 * len(s & shingles(r.text, 5)) >= 80 * len(s) for s in sets if s)}
    assert {r.doc_id for r in clean.collect()} == want and clean.columns == docs.columns
    mixed = cp.source_mixing(spark, clean, small).cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} < want
    shards = cp.minimax_sharding(spark, mixed, small).collect()
    assert {r.doc_id for r in shards} == {r.doc_id for r in mixed.collect()}


def test_run_is_the_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, small)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, cp.run(spark, small).collect()))


def test_repeated_rows_leave_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    twice = cp.ngram_jaccard(spark, docs.union(docs), small)
    assert twice.count() == twice.select("doc_id").distinct().count()


def test_rows_are_decided_by_themselves_at_any_size(spark, small, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet")
    keep = {r.doc_id: r.keep for r in cp.quality.score(docs).collect()}
    none = docs.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(5, "a " + passage), (5, "quite another text of its own"), (9, "b " + passage), (6, "quite another text of its own"), (None, "no id " * 9), (None, "no id " * 9), (None, "x y z"), (None, ""), (None, ""), (3, "quite another text of its own more")]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    leaky = spark.createDataFrame([(None, bench), (None, "clean words without any passage"), (1, bench), (1, "clean words")], "doc_id long, text string")
    for limit in (cp.BROADCAST_IDS, 0):
        monkeypatch.setattr(cp, "BROADCAST_IDS", limit)
        assert cp.quality_classifier(spark, none, small).count() == sum(keep.values())
        got = [(r.doc_id, r.text) for r in cp.ngram_jaccard(spark, odd, small).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(got, key=key) == sorted([rows[i] for i in (0, 1, 4, 6, 7, 8, 9)], key=key)
        got = [(r.doc_id, r.text) for r in cp.benchmark_decontamination(spark, leaky, small).collect()]
        assert sorted(got, key=key) == [(1, "clean words"), (None, "clean words without any passage")]
    both = docs.unionByName(docs.withColumn("source", F.lit("another source")))
    want = cp.mixing.mix(both).where("sampled").groupBy("doc_id", "source").count()
    got = cp.source_mixing(spark, both, small).groupBy("doc_id", "source").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stages_on_odd_rows_and_clashing_columns(spark, small):
    from pyspark.sql import functions as F

    from tests.llm.test_edges import CLASHING, DOCS

    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, " \n\t ", None, "s", 4), (4, "Word", "en", "s", 4), (5, "word " * 40_000, "en", "s", 1), (6, "same text here for all", "de", "s", 2), (7, "same text here for all", "de", "s", 2), (7, "same text here for all", "de", "s", 2), (None, "no id at all", "en", "s", 3)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in (*CLASHING, "_hash", "_id", "_group", "_first", "_source", "_topic", "bits", "blk", "copies", "links", "own", "place"):
        docs = docs.withColumn(c, F.lit(f"extra {c}"))
    want = {"quality classifier": {4, 6, 7, None}, "n-gram Jaccard join": {1, 2, 3, 4, 5, 6, None}, "benchmark decontamination": {1, 2, 3, 4, 5, 6, 7, None}}
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), small).collect() == []
        got = stage(spark, docs, small)
        ids = [r.doc_id for r in got.collect()]
        assert set(ids) <= {1, 2, 3, 4, 5, 6, 7, None}
        if name != "sharding":
            assert got.columns == docs.columns and all(r[c] == f"extra {c}" for r in got.collect() for c in CLASHING)
        else:
            assert len(ids) == len(rows)
        if name in want:
            assert set(ids) - {5} == want[name] - {5}
