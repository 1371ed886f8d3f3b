"""The SQL of the registered text queries, for DuckDB."""

from __future__ import annotations

from .chat import SEGMENT
from .licences import BREAK, RULES, known_sentences

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


def licences() -> str:
    rules = [(i + 1, licence, "".join(f",{sid}," for sid in needed)) for i, (licence, needed) in enumerate(RULES)]
    normal = f"trim(regexp_replace(translate({{}}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    names = ", ".join(f"'{x}'" for x in known_sentences())
    return f"""
WITH RECURSIVE known(sentence, sid) AS (VALUES {_values(sorted(known_sentences().items()))}), rules(k, licence, needed) AS (VALUES {_values(rules)}),
 texts AS (SELECT DISTINCT doc_id, md5(text) AS mark, flatten(list_transform(string_split_regex(text, '{BREAK}'), lambda p:
   CASE WHEN contains(p, chr(10)) AND {normal.format('p')} NOT IN ({names}) THEN string_split(p, chr(10)) ELSE [p] END)) AS l FROM documents WHERE text IS NOT NULL),
 parts AS (SELECT doc_id, mark, i AS pos, l[i] AS part FROM texts, unnest(range(1, len(l) + 1)) AS u(i)),
 found AS (SELECT doc_id, mark, pos, sid FROM (
   SELECT *, {normal.format('part')} AS sentence FROM parts)
  JOIN known USING (sentence)),
 runs AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, mark ORDER BY pos) AS run FROM found),
 seqs AS (SELECT doc_id, mark, min(pos) AS first, ',' || string_agg(sid, ',,' ORDER BY pos) || ',' AS sids FROM runs GROUP BY doc_id, mark, run),
 step AS (
  SELECT 0 AS k, doc_id, mark, first, sids AS rest, '' AS licence, CAST(0 AS BIGINT) AS n FROM seqs
  UNION ALL
  SELECT r.k, s.doc_id, s.mark, s.first, replace(s.rest, r.needed, '|'), r.licence,
   CAST((length(s.rest) - length(replace(s.rest, r.needed, '|'))) // (length(r.needed) - 1) AS BIGINT)
  FROM step s JOIN rules r ON r.k = s.k + 1),
 hits AS (
  SELECT doc_id, licence, n FROM step WHERE n > 0
  UNION ALL
  SELECT doc_id, 'unmatched:' || unnest(regexp_extract_all(rest, '[^,|]+')), 1 FROM step WHERE k = {len(rules)})
SELECT doc_id, licence, CAST(sum(n) AS BIGINT) AS n FROM hits GROUP BY doc_id, licence"""


MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix-0|' || CAST(doc_id AS VARCHAR)) AS place FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
 l AS (SELECT *, 2 * source_size / weight AS full_at,
   (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
 f AS (SELECT level FROM l WHERE full_at > level ORDER BY full_at, source NULLS LAST LIMIT 1),
 t AS (SELECT source, source_size, weight, least(2.0::DOUBLE * source_size, coalesce((SELECT level FROM f) * weight, 2.0::DOUBLE * source_size)) AS target FROM s),
 q AS (SELECT d.*, weight, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS served
   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 r AS (SELECT q.*, turn, CAST(served + turn * source_size AS DOUBLE) / weight AS finish FROM q, (VALUES (0), (1)) AS x(turn)),
 g AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, turn, place, doc_id, size ROWS UNBOUNDED PRECEDING) AS spent FROM r)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN spent <= floor(1.5 * (SELECT sum(size) FROM d)) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM g GROUP BY doc_id, size, source_size, target"""


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


def backoff() -> str:
    by = ["c", "b, c", "a, b, c"]
    counts = ", ".join(f"count(*) OVER (PARTITION BY {p}) - count(*) OVER (PARTITION BY r, {p}) AS c{k}" for k, p in enumerate(by, 1))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 p AS (SELECT r, i, len(w) AS n_words, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
 x AS (SELECT r, i, count(*) OVER () - n_words AS rest, {counts} FROM p),
 y AS (SELECT *, lag(c1) OVER (PARTITION BY r ORDER BY i) AS h2, lag(c2) OVER (PARTITION BY r ORDER BY i) AS h3 FROM x),
 s AS (SELECT r, CASE WHEN i > 2 AND c3 > 0 THEN 3 WHEN i > 1 AND c2 > 0 THEN 2 ELSE 1 END AS used, CASE WHEN i > 2 AND c3 > 0 THEN ln(c3::DOUBLE / h3)
  WHEN i > 1 AND c2 > 0 THEN ln(c2::DOUBLE / h2) + (CASE WHEN i > 2 THEN ln(0.4::DOUBLE) ELSE 0 END)
  ELSE ln(CASE WHEN c1 > 0 THEN c1::DOUBLE ELSE 0.4::DOUBLE END / greatest(rest, 1)) + least(i - 1, 2) * ln(0.4::DOUBLE) END AS logp FROM y)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(count(*) FILTER (used < 3) AS BIGINT) AS n_backoff, CASE WHEN len(w) > 0 THEN round(sum(logp) / len(w), 6) END AS mean_log_score
FROM d LEFT JOIN s ON s.r = d.r GROUP BY d.r, doc_id, w"""


_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
HITS = f"""
WITH w AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
 iw AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
 win AS (SELECT DISTINCT item_id, list_slice(ws, i, i + 9) AS win FROM iw, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(i) WHERE len(ws) > 0),
 dw AS (SELECT doc_id, k, i, list_slice(ws, i, i + k - 1) AS win FROM w, (SELECT DISTINCT len(win) AS k FROM win), unnest(range(1, len(ws) - k + 2)) AS u(i)),
 h AS (SELECT doc_id, item_id, i, k FROM dw JOIN win USING (win)),
 n AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(k)) AS x(j) GROUP BY doc_id),
 it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""


CHATS = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, count(*) AS n, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS log FROM t GROUP BY conv_id),
 p AS (SELECT DISTINCT list_slice(log, 1, i) AS log FROM c, unnest(range(1, n)) AS u(i)),
 kept AS (SELECT min(conv_id) AS conv_id, n, log FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.log = c.log) GROUP BY n, log)
SELECT conv_id, n AS n_turns, segment, array_to_string(list_transform(list_slice(log, segment * {SEGMENT} + 1, segment * {SEGMENT} + {SEGMENT}),
  lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || chr(10)), '') AS rendered
FROM kept, unnest(range((n + {SEGMENT - 1}) // {SEGMENT})) AS u(segment)"""



NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) END AS held FROM w),
 n AS (SELECT held, len(held) AS n, min(doc_id) AS node FROM s WHERE len(held) > 0 GROUP BY held),
 q AS (SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  WHERE (100 + 80) * len(list_intersect(a.held, b.held)) >= 80 * (a.n + b.n)),
 p AS (SELECT a, b FROM q UNION ALL SELECT b, a FROM q),
 reach(node, other) AS (SELECT node, node FROM n UNION SELECT r.node, p.b FROM reach r JOIN p ON p.a = r.other),
 c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.held) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, s.doc_id = coalesce(component_id, s.doc_id) AS kept
FROM s LEFT JOIN n ON n.held = s.held LEFT JOIN c USING (node)"""


def codebooks() -> str:
    """Plain k-means, one pair of steps per round; entry 16 * part + index holds integer components as a list."""
    good = "len(embedding) > 0 AND len(embedding) % 8 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    square = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assign = "a{r} AS MATERIALIZED (SELECT vec_id, p, x, arg_min(k, struct_pack(d := d, k := k)) AS k, min(d) AS d FROM (SELECT vec_id, v.p, x, k, " + square + " AS d FROM v JOIN c{r} e ON v.p = e.p) GROUP BY ALL)"
    move = """c{n} AS MATERIALIZED (SELECT c{r}.p, c{r}.k, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
  SELECT p, k, list(f ORDER BY i) AS c FROM (SELECT p, k, i, CAST((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT) AS f
   FROM a{r}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY p, k, i) GROUP BY p, k) m ON m.p = c{r}.p AND m.k = c{r}.k)"""
    rounds = ",\n ".join(f"{assign.format(r=r)},\n {move.format(r=r, n=r + 1)}" for r in range(6))
    return f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE {good}),
 v AS MATERIALIZED (SELECT vec_id, p, list_slice(e, p * (len(e) // 8) + 1, (p + 1) * (len(e) // 8)) AS x FROM e, unnest(range(8)) AS u(p)),
 f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM e QUALIFY k < 16),
 c0 AS MATERIALIZED (SELECT p, k, x AS c FROM v JOIN f USING (vec_id)),
 {rounds},
 {assign.format(r=6)},
 o AS (SELECT vec_id, string_agg(lpad(lower(hex(k)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY vec_id),
 h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS sha FROM c6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM o JOIN e USING (vec_id), h"""


NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
 n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


SQL = {"op1_license_scan": licences(), "op4_fair_queueing": MIX, "op5_segment_topk": TOP_K, "op7_stupid_backoff": backoff(), "op8_suffix_automaton": HITS,
       "op9_snapshot_collapse": CHATS, "op11_superminhash": NEAR, "op12_drake_codebooks": codebooks(), "op13_hard_negatives": NEGATIVES}
