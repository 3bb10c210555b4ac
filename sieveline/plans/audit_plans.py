"""Queries of the audit: names, counts, duplicates, manifests, bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as nm
from ..operators import audit as au
from ..operators import bands as bd
from ..operators import validation as va
from ..sources import standins as st
from . import sql

QUERIES, ORACLE_SQL = {}, {}
W = f"WITH {sql.FILES} "


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return keep


@query("src2_content_hashes", W + "SELECT id, md5, sha, bytes FROM files")
def hashes(spark, d):
    return st.files(spark, d).select("id", "md5", "sha", "bytes")


@query("prj1_2_names", W + r"SELECT id, split_part(name, '/', 1) AS cls, split_part(split_part(name, '/', 2), '_', 1) AS code, regexp_replace(split_part(split_part(name, '/', 2), '_', 2), '\.[^.]*$', '') AS stem, split_part(name, '/', 1) || '/' || regexp_replace(split_part(split_part(name, '/', 2), '_', 2), '\.[^.]*$', '') || '__' || substr(sha, 1, 8) || '.jpg' AS cache FROM files")
def names(spark, d):
    f, n = st.files(spark, d), F.col("name")
    return f.select("id", nm.name_class(n).alias("cls"), nm.name_code(n).alias("code"), nm.name_stem(n).alias("stem"), nm.cache_name(n, F.col("sha")).alias("cache"))


@query("prj3_agg1_class_counts", W + ", n AS (SELECT cls, count(*) AS n FROM files GROUP BY cls) SELECT cls, n, round_even(100 * n / sum(n) OVER (), 2) AS share, round_even(max(n) OVER () / min(n) OVER (), 1) AS imbalance FROM n")
def class_counts(spark, d):
    return au.class_counts(st.files(spark, d), "cls")


@query("prj4_class_ids", W + "SELECT DISTINCT cls, CAST(dense_rank() OVER (ORDER BY cls) - 1 AS INTEGER) AS class_id FROM files")
def class_ids(spark, d):
    from pyspark.sql.window import Window

    return st.files(spark, d).select("cls").distinct().select("cls", (F.dense_rank().over(Window.orderBy("cls")) - 1).alias("class_id"))


@query("prj5_7_variants", "SELECT * FROM (VALUES ('random', 'random', 'random__b__s1'), ('group:0.90', 'group:0.9', 'group0.9__b__s1'), ('group:0.94', 'group:0.94', 'group0.94__b__s1')) t(given, canonical, run)")
def variants(spark, d):
    v = spark.createDataFrame([("random",), ("group:0.90",), ("group:0.94",)], "given string").withColumn("canonical", nm.canonical_variant(F.col("given")))
    return v.withColumn("run", nm.run_name(F.col("canonical"), F.lit("b"), F.lit(1), F.lit("full")))


@query("agg2_code_counts", W + "SELECT cls, split_part(split_part(name, '/', 2), '_', 1) AS code, count(*) AS n FROM files GROUP BY ALL")
def code_counts(spark, d):
    f = st.files(spark, d).withColumn("code", nm.name_code(F.col("name")))
    return au.size_histogram(f, ["cls", "code"])


@query("agg3_size_histogram", "SELECT lang AS cls, n_chars // 1000 AS kilo, count(*) AS n FROM documents GROUP BY ALL")
def size_histogram(spark, d):
    return au.size_histogram(st.read(spark, d, "documents").select(F.col("lang").alias("cls"), F.floor(F.col("n_chars") / 1000).alias("kilo")), ["cls", "kilo"])


@query("agg4_conditional_mean", "SELECT lang AS cls, count(*) FILTER (WHERE l.quality = 1) AS n, round(avg(l.toxic) FILTER (WHERE l.quality = 1), 6) AS share FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def conditional_mean(spark, d):
    j = st.read(spark, d, "documents").select("doc_id", F.col("lang").alias("cls")).join(st.read(spark, d, "labels"), "doc_id", "left")
    return au.conditional_mean(j, ["cls"], "toxic", "quality = 1").select("cls", "n", F.round("share", 6).alias("share"))


@query("agg5_median_kb", W + "SELECT cls, round_even(median(bytes) / 1024, 3) AS kb FROM files GROUP BY cls")
def median_kb(spark, d):
    return st.files(spark, d).groupBy("cls").agg(F.bround(F.median("bytes") / 1024, 3).alias("kb"))


DUP = "g AS (SELECT sha, count(*) AS n, count(DISTINCT cls) AS n_classes, string_agg(DISTINCT cls, ',' ORDER BY cls) AS classes FROM files GROUP BY sha HAVING count(*) > 1)"


@query("agg6_duplicate_groups", W + "," + DUP + " SELECT * FROM g")
def duplicate_groups(spark, d):
    return au.duplicate_groups(st.files(spark, d), "sha", "cls")


@query("agg7_duplicate_totals", W + "," + DUP + " SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS items, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra, count(*) FILTER (WHERE n_classes > 1) AS cross_class FROM g")
def duplicate_totals(spark, d):
    return au.duplicate_totals(au.duplicate_groups(st.files(spark, d), "sha", "cls"))


@query("agg7_collisions", "SELECT CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS colliding FROM (SELECT source || '/' || n_chars AS k, count(*) AS n FROM documents GROUP BY 1)")
def collisions(spark, d):
    k = st.read(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("n_chars").cast("string")).alias("k"))
    return au.collisions(k, "k")


@query("win8_jn8_manifest", W + r", f AS (SELECT *, min(name) OVER (PARTITION BY sha) AS first FROM files) SELECT cls AS class, name AS orig_name, sha AS orig_sha256, CASE WHEN name = first THEN split_part(name, '/', 1) || '/' || regexp_replace(split_part(split_part(name, '/', 2), '_', 2), '\.[^.]*$', '') || '__' || substr(sha, 1, 8) || '.jpg' END AS cache_name, CASE WHEN name = first THEN 'kept;orig_size=' || bytes || 'x1' ELSE 'dropped_exact_duplicate_of:' || first END AS note FROM f")
def manifest(spark, d):
    return au.manifest(st.files(spark, d).withColumn("one", F.lit(1)), "cls", "name", "sha", "bytes", "one")


@query("flt7_src6_kept_rows", W + ", f AS (SELECT *, min(name) OVER (PARTITION BY sha) AS first FROM files) SELECT name FROM f WHERE name = first")
def kept_rows(spark, d):
    m = au.manifest(st.files(spark, d).withColumn("one", F.lit(1)), "cls", "name", "sha", "bytes", "one")
    return m.where(F.col("note").startswith("kept")).select(F.col("orig_name").alias("name"))


@query("agg35_archive_totals", W + "SELECT cls AS archive, count(*) AS images, CAST(sum(bytes) AS BIGINT) AS bytes FROM files GROUP BY cls")
def archive_totals(spark, d):
    return st.files(spark, d).groupBy(F.col("cls").alias("archive")).agg(F.count("*").alias("images"), F.sum("bytes").alias("bytes"))


@query("flt9_jn13_shards", "SELECT v, b, s FROM (SELECT *, row_number() OVER (ORDER BY v, b, s) - 1 AS job FROM (SELECT unnest(['random', 'group:0.94']) AS v), (SELECT unnest(['a', 'b']) AS b), (SELECT unnest([0, 1, 2]) AS s)) WHERE job % 3 = 1")
def shards(spark, d):
    one = lambda name, xs, t: spark.createDataFrame([(x,) for x in xs], f"{name} {t}")
    return au.shards(one("v", ["random", "group:0.94"], "string"), one("b", ["a", "b"], "string"), one("s", [0, 1, 2], "int"), index=1, of=3, order=["v", "b", "s"]).drop("job")


@query("set4_val2_difference", "(SELECT doc_id, 'left' AS side FROM documents EXCEPT SELECT doc_id, 'left' FROM labels) UNION ALL (SELECT doc_id, 'right' FROM labels EXCEPT SELECT doc_id, 'right' FROM documents)")
def difference(spark, d):
    return va.set_difference(st.read(spark, d, "documents"), st.read(spark, d, "labels"), "doc_id")


@query("val1_repeated", W + "SELECT sha, count(*) AS n FROM files GROUP BY sha HAVING count(*) > 1")
def repeated(spark, d):
    return va.repeated(st.files(spark, d), ["sha"])


@query("val6_sound_vectors", "SELECT vec_id, len(embedding) = 64 AS sound FROM embeddings")
def sound(spark, d):
    return st.read(spark, d, "embeddings").select("vec_id", va.sound_vector(F.col("embedding"), 64).alias("sound"))


@query("set1_3_union_distinct", "SELECT lang AS k, count(*) AS n FROM (SELECT lang FROM documents UNION ALL SELECT source FROM documents) GROUP BY 1")
def union_distinct(spark, d):
    x = st.read(spark, d, "documents")
    return x.select(F.col("lang").alias("k")).unionByName(x.select(F.col("source").alias("k"))).groupBy("k").agg(F.count("*").alias("n"))


@query("src8_basename_index", r"SELECT base, count(*) AS n FROM (SELECT regexp_extract(url, '[^/]*$') AS base FROM pages) GROUP BY base")
def basename_index(spark, d):
    return st.read(spark, d, "pages").select(nm.basename(F.col("url")).alias("base")).groupBy("base").agg(F.count("*").alias("n"))


P = f"WITH {sql.PROFILES} "


def _bands(spark, d):
    p = st.profiles(spark, d).select("id", "y", bd.bright(F.col("profile")).alias("bright"), bd.dark(F.col("profile")).alias("dark"))
    b = bd.longest_run(p, ["id", "y"], "bright").withColumnsRenamed({"start": "bright_start", "len": "bright_len"})
    k = bd.longest_run(p, ["id", "y"], "dark").withColumnsRenamed({"start": "dark_start", "len": "dark_len"})
    return b.join(k, ["id", "y"]), p


@query("win5_longest_runs", P + "SELECT id, y, CAST(bright_start AS INTEGER) AS bright_start, bright_len, CAST(dark_start AS INTEGER) AS dark_start, dark_len FROM bands")
def longest_runs(spark, d):
    return _bands(spark, d)[0]


@query("win6_all_runs", P + "SELECT id, colour, CAST(start AS INTEGER) AS start, len FROM runs")
def all_runs(spark, d):
    _, p = _bands(spark, d)
    one = lambda c: bd.runs(p, ["id"], c).select("id", F.lit(c).alias("colour"), "start", "len")
    return one("bright").unionByName(one("dark"))


RATES = "count(*) AS n, round(avg(CASE WHEN bright_len >= 2 THEN 1 ELSE 0 END), 6) AS bright, round(avg(CASE WHEN dark_len >= 2 THEN 1 ELSE 0 END), 6) AS dark, round(avg(CASE WHEN bright_len < 2 AND dark_len < 2 THEN 1 ELSE 0 END), 6) AS neither, round(avg(CASE WHEN bright_len >= 2 AND bright_start >= 51.2 THEN 1 ELSE 0 END), 6) AS bright_low"


@query("agg10_prj6_band_rates", P + f"SELECT y, {RATES} FROM bands GROUP BY y UNION ALL SELECT -1, {RATES} FROM bands")
def band_rates(spark, d):
    b = _bands(spark, d)[0]
    both = b.unionByName(b.withColumn("y", F.lit(-1)))
    return bd.band_rates(both, ["y"], st.HEIGHT).select("y", "n", *(F.round(c, 6).alias(c) for c in ("bright", "dark", "neither", "bright_low")))


@query("agg10_start_percentiles", P + ", s AS (SELECT bright_start AS s FROM bands WHERE bright_len >= 2) SELECT CAST(trunc(quantile_cont(s, 0.05)) AS INTEGER) AS p5, CAST(trunc(quantile_cont(s, 0.5)) AS INTEGER) AS p50, CAST(trunc(quantile_cont(s, 0.95)) AS INTEGER) AS p95 FROM s")
def start_percentiles(spark, d):
    s = _bands(spark, d)[0].where("bright_len >= 2")
    return s.agg(*(F.percentile("bright_start", F.lit(q)).cast("int").alias(f"p{round(100 * q)}") for q in (0.05, 0.5, 0.95)))


CROP = ", l AS (SELECT unnest([0.15, 0.1875, 0.2, 0.22, 0.25, 0.3]) AS fraction, unnest([54, 52, 51, 50, 48, 45]) AS line), hit AS (SELECT id, line, max(CASE WHEN start + len >= line - 0.12 * 64 THEN 1 ELSE 0 END) AS near FROM runs, l WHERE len BETWEEN 2 AND 5 AND start + len <= line GROUP BY ALL)"


@query("agg29_q17_crop_check", P + CROP + " SELECT y, CAST(fraction AS DOUBLE) AS fraction, count(*) AS n, count(h.id) AS anywhere, CAST(coalesce(sum(near), 0) AS BIGINT) AS near FROM prof, l LEFT JOIN hit h ON h.id = prof.id AND h.line = l.line GROUP BY ALL")
def crop_check(spark, d):
    _, p = _bands(spark, d)
    runs = bd.runs(p, ["id"], "bright").unionByName(bd.runs(p, ["id"], "dark"))
    return bd.crop_check(runs, p.select("id", "y"), ["y"], st.HEIGHT)


@query("val9_crop_verdict", P + CROP + " SELECT CAST(fraction AS DOUBLE) AS fraction, round(100 * count(h.id) / count(*), 6) AS percent, CASE WHEN 100 * count(h.id) / count(*) <= 1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM prof, l LEFT JOIN hit h ON h.id = prof.id AND h.line = l.line GROUP BY ALL")
def crop_verdict(spark, d):
    _, p = _bands(spark, d)
    runs = bd.runs(p, ["id"], "bright").unionByName(bd.runs(p, ["id"], "dark"))
    c = bd.crop_check(runs, p.select("id"), [], st.HEIGHT).withColumn("x", 100 * F.col("anywhere") / F.col("n"))
    return c.select("fraction", F.round("x", 6).alias("percent"), va.within(F.col("x")).alias("verdict"))


@query("fn15_16_regions", "SELECT * FROM (VALUES (384, 'bottom_strip', 312, 384), (384, 'top_strip', 0, 72), (384, 'no_bottom', 0, 312), (384, 'no_top', 72, 384), (384, 'full', 0, 384), (768, 'bottom_strip', 624, 768)) t(h, region, y0, y1)")
def regions(spark, d):
    rows = [(384, r) for r in ("bottom_strip", "top_strip", "no_bottom", "no_top", "full")] + [(768, "bottom_strip")]
    t = spark.createDataFrame(rows, "h int, region string")
    return t.select("h", "region", bd.region_rows(F.col("h"), F.col("region")).alias("r")).select("h", "region", "r.y0", "r.y1")


@query("fn17_20_run_limits", "SELECT * FROM (VALUES (64, 12, 2, 5, 1), (384, 72, 10, 30, 2), (768, 144, 20, 60, 4), (10, 2, 1, 1, 1)) t(h, bar, least, most, tol)")
def run_limits(spark, d):
    h, t = F.col("h"), spark.createDataFrame([(64,), (384,), (768,), (10,)], "h int")
    return t.select("h", bd.bar_rows(h).alias("bar"), bd.min_run(h).alias("least"), bd.max_run(h).alias("most"), bd.tolerance(h).alias("tol"))


@query("fn19_touches_bottom", P + "SELECT id, (bright_len >= 2 AND bright_start + bright_len >= 63) AS touches FROM bands")
def touches(spark, d):
    b = _bands(spark, d)[0]
    return b.select("id", bd.touches_bottom(F.col("bright_start"), F.col("bright_len"), F.lit(st.HEIGHT)).alias("touches"))
