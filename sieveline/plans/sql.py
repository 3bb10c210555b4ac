"""Common table expressions of the checking SQL: the same stand-in tables, by other means."""

PRED = """
pred AS (
  SELECT b AS backbone, s AS seed, vec_id AS id, CAST(label AS INTEGER) AS y,
         list_transform(range(10), lambda c: 4.0 * (8.0 * CAST(embedding[30 * b + 10 * s + c + 1] AS DOUBLE) + CASE WHEN c = label THEN {bonus} ELSE 0.0 END)) AS z
  FROM embeddings, (SELECT unnest([0, 1]) AS b) bb, (SELECT unnest([0, 1, 2]) AS s) ss),
q AS (
  SELECT *, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS p, 1.0 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS conf FROM pred),
m AS (SELECT *, CASE WHEN p = y THEN 1 ELSE 0 END AS ok FROM q)"""


def pred(bonus: float = 3.0) -> str:
    return PRED.format(bonus=bonus)


def f1(cells: str, by: str, name: str = "f1") -> str:
    """From cells (by, y, p, n): per class sums and F1, then a summary (by, n, accuracy, macro_f1, macro_f1_present)."""
    return f"""
{name}_c AS (
  SELECT {by}, c, sum(tp) AS tp, sum(sup) AS support, sum(pr) AS predicted FROM (
    SELECT {by}, y AS c, n AS sup, 0 AS pr, CASE WHEN y = p THEN n ELSE 0 END AS tp FROM {cells}
    UNION ALL SELECT {by}, p, 0, n, 0 FROM {cells}) GROUP BY {by}, c),
{name} AS (
  SELECT {by}, sum(support) AS n, sum(tp) / sum(support) AS accuracy, sum(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END) / 10 AS macro_f1,
         sum(CASE WHEN support > 0 THEN 2 * tp / (support + predicted) ELSE 0 END) / count_if(support > 0) AS macro_f1_present
  FROM {name}_c GROUP BY {by})"""


PAIRS = """
mu AS (SELECT list(v ORDER BY i) AS mu FROM (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY i)),
ctr AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS y, list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) - mu[i]) AS x FROM embeddings, mu),
nv AS (SELECT id, y, list_transform(x, lambda e: e / (sqrt(list_dot_product(x, x)) + 1e-12)) AS x FROM ctr),
allpairs AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.x, b.x) AS v FROM nv a JOIN nv b ON a.id < b.id),
pairs AS (SELECT * FROM allpairs WHERE v >= 0.35)"""

STRATIFIED = """
strat AS (
  SELECT id, y, CASE WHEN r <= t THEN 'train' WHEN r <= t + (n - t + 1) // 2 THEN 'val' ELSE 'test' END AS split FROM (
    SELECT *, (7 * n + 5) // 10 AS t FROM (
      SELECT vec_id AS id, CAST(label AS INTEGER) AS y, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || vec_id), vec_id) AS r FROM embeddings)))"""


def components(tau: float, name: str = "cl") -> str:
    """Needs WITH RECURSIVE and pairs."""
    return f"""
{name}_u AS (SELECT a, b FROM pairs WHERE v >= {tau} UNION ALL SELECT b, a FROM pairs WHERE v >= {tau}),
{name}_r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT u.b, r.root FROM {name}_r r JOIN {name}_u u ON r.id = u.a),
{name} AS (SELECT id, min(root) AS cluster FROM {name}_r GROUP BY id)"""


def draws(units: str, n_boot: int, seed: int = 0, name: str = "dr") -> str:
    """units: a table with a column unit. name: (boot, unit, w)."""
    return f"""
{name}_u AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT unit FROM {units})),
{name}_n AS (SELECT max(n) AS n FROM {name}_u),
{name}_j AS (SELECT boot, unnest(range(n)) AS j, n FROM {name}_n, (SELECT unnest(range(1, {n_boot} + 1)) AS boot)),
{name}_d AS (SELECT boot, CAST('0x' || substr(md5('{seed}-' || boot || '-' || j), 1, 8) AS BIGINT) % n AS i, count(*) AS w FROM {name}_j GROUP BY ALL),
{name} AS (SELECT boot, unit, w FROM {name}_d JOIN {name}_u USING (i))"""


FILES = """
files AS (
  SELECT doc_id AS id, lang || '/' || source || '_doc' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '.jpg' AS name, lang AS cls, sha256(text) AS sha, md5(text) AS md5, strlen(text) AS bytes FROM documents)"""

PROFILES = """
prof AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS y, list_transform(embedding, lambda x: 128.0 + 800.0 * CAST(x AS DOUBLE)) AS h FROM embeddings),
rows_ AS (SELECT id, y, unnest(h) AS v, unnest(range(64)) AS pos FROM prof),
isl AS (SELECT id, y, 'bright' AS colour, pos, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS g FROM rows_ WHERE v > 225
  UNION ALL SELECT id, y, 'dark', pos, pos - row_number() OVER (PARTITION BY id ORDER BY pos) FROM rows_ WHERE v < 30),
runs AS (SELECT id, y, colour, min(pos) AS start, count(*) AS len FROM isl GROUP BY id, y, colour, g),
best AS (SELECT id, y, colour, start, len FROM (SELECT *, row_number() OVER (PARTITION BY id, colour ORDER BY len DESC, start) AS r FROM runs) WHERE r = 1),
bands AS (
  SELECT p.id, p.y, coalesce(b.start, 0) AS bright_start, coalesce(b.len, 0) AS bright_len, coalesce(d.start, 0) AS dark_start, coalesce(d.len, 0) AS dark_len
  FROM prof p LEFT JOIN best b ON b.id = p.id AND b.colour = 'bright' LEFT JOIN best d ON d.id = p.id AND d.colour = 'dark')"""

CODES = """
cf AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS y, list_transform(embedding[1:63], lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings),
bits AS (SELECT id, y, list_transform(c, lambda x: CASE WHEN x > list_sort(c)[32] THEN 1 ELSE 0 END) AS b FROM cf),
codes AS (SELECT id, y, b FROM bits),
hp AS (SELECT a.id AS a, b.id AS b, CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN a.b[i] <> b.b[i] THEN 1 ELSE 0 END)) AS INTEGER) AS dist FROM codes a JOIN codes b ON a.id < b.id)"""
