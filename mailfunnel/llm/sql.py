"""DuckDB SQL for the queries of this folder that SQL can express on whole tables."""

from __future__ import annotations

from . import mixing, urlfilter

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64.0)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.e, x.vec_id AS vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 20 = 0) q JOIN v x ON q.vec_id <> x.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


#: Operator 12.
PHRASES = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT c.*, j, array_to_string(s[:j], ' ') AS first_part, array_to_string(s[j + 1:], ' ') AS rest FROM c, (SELECT unnest([1, 2]) AS j) WHERE j < k),
m AS (SELECT cuts.*, x.a AS l, y.a AS r, (CAST(1000000 AS HUGEINT) * cuts.a * cuts.a) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first_part JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS i FROM m) WHERE i = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * b.a)
SELECT t.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000
"""


def mixing_sql(weights=mixing.WEIGHTS, share=1.5, most=2) -> str:
    pick = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    taken = " + ".join(f"CASE WHEN n > 0 AND source_size * {p} + before + n / 2.0 < target THEN 1 ELSE 0 END" for p in range(most))
    tilt = " ".join(f"WHEN {i} THEN CAST({t} AS DOUBLE)" for i, t in enumerate(mixing.TILTS))
    share_of = lambda p: f"(CAST(source_size * {p} + before AS DOUBLE) + CAST(n AS DOUBLE) / 2) / greatest(target, CAST(1 AS DOUBLE))"
    time = lambda u: f"least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CASE WHEN abs(tilt) < 1e-9 THEN {u} ELSE (1 + tilt - sqrt(greatest(CAST(0 AS DOUBLE), (1 + tilt) * (1 + tilt) - 4 * tilt * ({u})))) / (2 * tilt) END))"
    at = lambda p: f"CAST(floor({time(share_of(p))} * 1000000) AS BIGINT)"
    last = " ".join(f"WHEN {p + 1} THEN {at(p)}" for p in range(most))
    return f"""
WITH d AS (
  SELECT doc_id, source AS s, text, md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n FROM documents),
z AS (SELECT s, CAST(sum(n) AS BIGINT) AS source_size FROM d GROUP BY s),
r AS (SELECT *, row_number() OVER (ORDER BY s NULLS LAST) - 1 AS r FROM z),
w AS (SELECT *, CASE r % {len(weights)} {pick} END AS weight, CASE r % {len(mixing.TILTS)} {tilt} END AS tilt FROM r),
c AS (SELECT *, coalesce(sum({most} * source_size) OVER (ORDER BY source_size / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (ORDER BY source_size / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT *, CAST({share} * (SELECT sum(source_size) FROM z) - capped AS DOUBLE) / rest AS level FROM c),
f AS (SELECT first(level ORDER BY capped, level) AS found FROM l WHERE level * weight <= {most} * source_size),
t AS (SELECT s, source_size, tilt, least(CAST({most} * source_size AS DOUBLE), coalesce(found * weight, CAST({most} * source_size AS DOUBLE))) AS target FROM l, f),
p AS (SELECT d.doc_id, d.n, t.source_size, t.target, t.tilt,
             coalesce(sum(n) OVER (PARTITION BY d.s ORDER BY k, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.s IS NOT DISTINCT FROM t.s)
SELECT doc_id, n AS size, source_size, target, CAST(n * ({taken}) AS BIGINT) AS taken, CAST({taken} AS INTEGER) AS copies,
       CASE WHEN {taken} > 0 THEN {at(0)} END AS first_position, CASE {taken} {last} END AS last_position FROM p
"""


def url_sql(rules=urlfilter.RULES, rounds: int = 10, damping: int = 85) -> str:
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(a, h + p, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for a, h, p in ranked]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for _, r, c in fits)
    action = " ".join(f"WHEN {c} THEN '{a}'" for a, _, c in fits)
    lower = f"translate(%s, '{urlfilter.UPPER}', '{urlfilter.LOWER}')"
    steps = []
    for i in range(rounds):
        steps.append(f"""r{i + 1} AS (SELECT kind, host, CAST(sum(part) AS BIGINT) AS rank FROM (
  SELECT e.kind, e.dst AS host, (r.rank * {damping}) // (100 * e.degree) AS part FROM e JOIN r{i} r ON e.kind = r.kind AND e.src = r.host
  UNION ALL SELECT kind, host, (rank * {100 - damping}) // 100 FROM r0) GROUP BY kind, host HAVING sum(part) > 0)""")
    host = lambda rest: lower % f"regexp_extract({rest}, '^[^/?#]*')"
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, {host('rest')} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
m AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {action} END AS action FROM h),
g AS (SELECT host, count(*) FILTER (action = 'allow') AS a, count(*) FILTER (action = 'block') AS b FROM m WHERE host <> '' GROUP BY host),
r0 AS (SELECT 't' AS kind, host, CAST(a * ({urlfilter.MASS} // (SELECT greatest(1, sum(a)) FROM g)) AS BIGINT) AS rank FROM g WHERE a > 0
       UNION ALL SELECT 'd', host, CAST(b * ({urlfilter.MASS} // (SELECT greatest(1, sum(b)) FROM g)) AS BIGINT) FROM g WHERE b > 0),
p1 AS (SELECT host AS src, substr(host, instr(host, '.') + 1) AS dst FROM g WHERE instr(host, '.') > 0 AND instr(substr(host, instr(host, '.') + 1), '.') > 0),
p2 AS (SELECT * FROM p1 UNION SELECT dst, substr(dst, instr(dst, '.') + 1) FROM p1 WHERE instr(substr(dst, instr(dst, '.') + 1), '.') > 0),
links AS (SELECT src, {host("substr(x, instr(x, '://') + 3)")} AS dst FROM (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']?([a-z][a-z0-9+.-]*://[^"''\\s>]+)', 1)) AS x FROM h)),
edges AS (SELECT src, dst FROM p2 UNION SELECT dst, src FROM p2 UNION SELECT src, dst FROM links WHERE src <> '' AND dst <> '' AND src <> dst),
k AS (SELECT 't' AS kind, src, dst FROM edges UNION ALL SELECT 'd', dst, src FROM edges),
e AS (SELECT *, count(*) OVER (PARTITION BY kind, src) AS degree FROM k),
{",".join(steps)},
s AS (SELECT host, coalesce(sum(rank) FILTER (kind = 't'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'd'), 0) AS distrust FROM r{rounds} GROUP BY host)
SELECT page_id, m.host, path, rule, coalesce(action, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(coalesce(trust, 0) AS BIGINT) AS trust, CAST(coalesce(distrust, 0) AS BIGINT) AS distrust
FROM m LEFT JOIN s ON m.host = s.host
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_top_k": TOP_K, "op4_url_filter": url_sql(), "op9_source_mix": mixing_sql(), "op12_phrases": PHRASES}
