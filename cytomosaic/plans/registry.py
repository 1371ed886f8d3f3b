"""Catalogue of checked queries: a Spark plan over the given tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, *ctes: str, sql: str | None = None):
    """Record a plan; ``ctes`` are WITH-fragments placed before ``sql``."""
    def add(plan):
        if name in PLANS:
            raise ValueError(f"duplicate query {name}")
        PLANS[name] = plan
        if sql is not None:
            ORACLE[name] = (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + sql
        return plan
    return add


# ---- SQL fragments: the study tables of cytomosaic.sources.demo --------------------------------------------

CELLS = """cells AS (
 SELECT 'N'||c_nationkey AS slide_id, CAST(c_custkey AS VARCHAR) AS cell_id, c_mktsegment AS cell_type,
  c_acctbal AS cell_area, CASE WHEN c_custkey % 20 = 0 THEN 1 ELSE 0 END AS control_probe_counts,
  CASE WHEN c_custkey % 33 = 0 THEN 1 ELSE 0 END AS control_codeword_counts,
  r_name AS condition, 'N'||n_nationkey AS replicate_id
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

COUNTS = """counts AS (
 SELECT 'N'||c_nationkey AS slide_id, CAST(o_custkey AS VARCHAR) AS cell_id, 'G'||p_size AS gene,
  CAST(sum(l_quantity) AS BIGINT) AS cnt
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""

EXPR = """expr AS (
 SELECT slide_id, cell_id, gene, cnt, ln(1 + cnt * 100.0 / sum(cnt) OVER (PARTITION BY cell_id)) AS lognorm
 FROM counts)"""

GENES = "genes AS (SELECT DISTINCT gene FROM counts)"

DENSE = """dense AS (
 SELECT c.*, g.gene, coalesce(round(e.lognorm, 12), 0) AS v, coalesce(e.cnt, 0) AS cnt
 FROM cells c CROSS JOIN genes g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene)"""

STUDY = (CELLS, COUNTS, EXPR, GENES, DENSE)

METRICS = """metrics AS (
 SELECT c.*, CAST(coalesce(t.total_counts, 0) AS BIGINT) AS total_counts, coalesce(t.n_genes, 0) AS n_genes
 FROM cells c LEFT JOIN (SELECT cell_id, sum(cnt) AS total_counts, count(*) AS n_genes FROM counts GROUP BY 1) t
  USING (cell_id))"""

SIGNATURES = """signatures AS (SELECT * FROM (VALUES
 ('S1','G1',0),('S1','G2',1),('S1','G3',2),('S2','G3',0),('S2','G4',1),('S2','G5',2),('S3','G10',0),('S3','G11',1),
 ('S4','G20',0),('S4','G21',1),('S4','G22',2),('S5','G22',0),('S5','G30',1)) AS s(label, gene, position))"""

FEATURES = """features AS (
 SELECT 'N'||n_nationkey AS slide_id, 'G'||p_size AS gene,
  CASE WHEN p_size % 25 = 7 THEN 'Negative Control Probe' ELSE 'Gene Expression' END AS feature_type
 FROM nation CROSS JOIN (SELECT DISTINCT p_size FROM part)
 WHERE CASE WHEN p_size > 40 THEN (n_nationkey * 7 + p_size) % 3 <> 0 ELSE (n_nationkey * 31 + p_size) % 97 <> 0 END)"""

PANEL = """panel AS (
 SELECT DISTINCT 'G'||p_size AS gene, 'ENS'||p_size AS ensembl_id, CAST(p_size % 8 + 1 AS INTEGER) AS n_probesets,
  'annotation '||CAST(floor(p_size / 10) AS BIGINT) AS annotation FROM part WHERE p_size <= 40)"""

SLIDES = """slides AS (
 SELECT 'N'||n_nationkey AS slide_id, r_name AS condition, 'N'||n_nationkey AS replicate_id
 FROM nation JOIN region ON n_regionkey = r_regionkey)"""

POINTS = """points AS (
 SELECT 'P'||(vec_id % 4) AS slide_id, CAST(vec_id AS VARCHAR) AS cell_id,
  CASE WHEN vec_id % 4 < 2 THEN 'A' ELSE 'B' END AS condition, 'P'||(vec_id % 4) AS replicate_id,
  CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y, 'L'||label AS cell_type
 FROM embeddings)"""

POINT_EXPR = """pexpr AS (
 SELECT slide_id, cell_id, 'E'||dim AS gene, value AS lognorm FROM (
  SELECT 'P'||(vec_id % 4) AS slide_id, CAST(vec_id AS VARCHAR) AS cell_id,
   unnest(range(1, len(embedding) + 1)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)
 WHERE value > 0)"""


def knn_cte(k: int, name: str = "knn") -> str:
    """Brute-force k nearest points on the same slide, self excluded, ties by id."""
    return f"""{name} AS (
 SELECT slide_id, src, dst, dist, rk FROM (
  SELECT a.slide_id, a.cell_id AS src, b.cell_id AS dst, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist,
   row_number() OVER (PARTITION BY a.slide_id, a.cell_id
    ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.cell_id) AS rk
  FROM points a JOIN points b ON a.slide_id = b.slide_id AND a.cell_id <> b.cell_id) WHERE rk <= {k})"""


def symmetric_cte(knn: str = "knn", name: str = "graph") -> str:
    return f"""{name} AS (
 SELECT slide_id, src, dst, max(dist) AS dist FROM (
  SELECT slide_id, src, dst, dist FROM {knn} UNION ALL SELECT slide_id, dst, src, dist FROM {knn}) GROUP BY 1, 2, 3)"""


def p_normal(z: str, steps: int = 1000) -> str:
    """Two-sided normal tail by Simpson integration of the density."""
    h = f"(least(abs({z}), 9.0) / {steps}.0)"
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    body = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * exp(-0.5 * i * {h} * i * {h})))"
    return f"greatest(0.0, 1.0 - sqrt(2.0 / pi()) * {h} / 3.0 * {body})"


def p_student(t: str, df: str, steps: int = 2000) -> str:
    """Two-sided t tail: Simpson over the angle substitution t = sqrt(df) tan(a)."""
    top = f"atan(abs({t}) / sqrt({df}))"
    h = f"({top} / {steps}.0)"
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    body = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * pow(cos(i * {h}), {df} - 1)))"
    const = f"(exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()))"
    return f"greatest(0.0, 1.0 - 2.0 * {const} * {h} / 3.0 * {body})"


def bh(p: str, by: str = "") -> str:
    """SELECT-list pieces need two levels, so the caller supplies rk = row_number over p and m = family size."""
    part = f"PARTITION BY {by} " if by else ""
    return f"least(1.0, min({p} * m / rk) OVER ({part}ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


def enrichment_sql(n_permutations: int = 500, seed: int = 42) -> str:
    """CTEs after ``points`` and ``knn``: every cell's position in each permutation by the keyed bijection, then shares, z and p of label pairs."""
    def mixed(e):
        step = "list_transform({}, lambda x: {})"
        first = step.format(f"[({e}) & 2147483647]", "(xor(x, x >> 16) * 73244475) & 2147483647")
        return step.format(step.format(first, "(xor(x, x >> 15) * 295559667) & 2147483647"), "xor(x, x >> 16)") + "[1]"

    def network(source):
        body = f"(SELECT *, x >> half AS l0, x & ((1 << half) - 1) AS r0 FROM {source})"
        for i in range(4):
            body = f"(SELECT *, r{i} AS l{i + 1}, xor(l{i}, {mixed(f'r{i} + ' + mixed(f'k + {7919 * i}'))} & ((1 << half) - 1)) AS r{i + 1} FROM {body})"
        return f"SELECT slide_id, cell_id, perm, m, half, k, (l4 << half) | r4 AS x FROM {body}"

    return f"""ranks AS (SELECT slide_id, cell_id, row_number() OVER (PARTITION BY slide_id ORDER BY md5(cell_id), cell_id) - 1 AS x, count(*) OVER (PARTITION BY slide_id) AS m,
  CAST('0x' || substr(md5(slide_id), 1, 7) AS BIGINT) AS key FROM points),
 begin_ AS (SELECT slide_id, cell_id, perm, m, CAST((length(bin(m - 1)) + 1) // 2 AS BIGINT) AS half, {mixed(f'key + perm * 48271 + {seed * 69621}')} AS k, x
  FROM ranks, unnest(range({n_permutations})) AS u(perm)),
 walk AS ({network('begin_')} UNION ALL {network('(SELECT * FROM walk WHERE x >= m)')}),
 pos AS (SELECT slide_id, cell_type, row_number() OVER (PARTITION BY slide_id ORDER BY cell_type, cell_id) - 1 AS x FROM points),
 shuffled AS (SELECT perm, cell_id, cell_type FROM walk JOIN pos USING (slide_id, x) WHERE walk.x < m),
 null_n AS (SELECT a.perm, a.cell_type AS type_a, b.cell_type AS type_b, count(*) AS n FROM knn JOIN shuffled a ON a.cell_id = src
  JOIN shuffled b ON b.cell_id = dst AND a.perm = b.perm GROUP BY 1, 2, 3),
 null_s AS (SELECT *, n / sum(n) OVER (PARTITION BY perm, type_a) AS share FROM null_n),
 seen AS (SELECT a.cell_type AS type_a, b.cell_type AS type_b, count(*) AS n FROM knn JOIN points a ON a.cell_id = src JOIN points b ON b.cell_id = dst GROUP BY 1, 2),
 t AS (SELECT DISTINCT cell_type FROM points),
 obs AS (SELECT x.cell_type AS type_a, y.cell_type AS type_b, coalesce(n / sum(n) OVER (PARTITION BY x.cell_type), 0) AS observed
  FROM t x CROSS JOIN t y LEFT JOIN seen ON type_a = x.cell_type AND type_b = y.cell_type),
 stat AS (SELECT type_a, type_b, observed, coalesce(sum(share), 0) AS s, coalesce(sum(share * share), 0) AS q, count(*) FILTER (share >= observed) AS ge,
  count(*) FILTER (share > observed) AS gt FROM obs LEFT JOIN null_s USING (type_a, type_b) GROUP BY 1, 2, 3),
 scored AS (SELECT type_a, type_b, observed, s / {n_permutations} AS null_mean, (observed - s / {n_permutations}) /
  (sqrt(greatest(q / {n_permutations} - pow(s / {n_permutations}, 2), 0)) + 1e-12) AS z_score,
  least(1.0, least(CASE WHEN observed <= 0 THEN {n_permutations} ELSE ge END, {n_permutations} - gt) * 2.0 / {n_permutations + 1} + 2.0 / {n_permutations + 1}) AS p_value FROM stat),
 ordered AS (SELECT *, row_number() OVER (ORDER BY p_value) AS rk, count(*) OVER () AS m FROM scored),
 enriched AS (SELECT type_a, type_b, observed, null_mean, z_score, p_value, {bh('p_value')} AS p_adj FROM ordered)"""
