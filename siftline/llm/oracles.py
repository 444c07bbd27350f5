"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from .ball_tree import CLUSTERS, DIMENSIONS, ROUNDS, SCALE, SEED
from .host_quality import BASE, REJECT_RATE, WORD, WORD_CHAR
from .host_quality import RULES as QUALITY_RULES
from .secret_scan import RULES as SECRET_RULES
from .url_filter import RULES as URL_RULES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


MIXING = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM d GROUP BY source),
c AS (SELECT *, source_size * 3.0e0 AS cap, source_size * 3.0e0 / weight AS level FROM s),
l AS (SELECT *, ((SELECT CAST(sum(source_size) AS BIGINT) FROM s) - coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0))
  / sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM c),
t AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT max(share) FROM l WHERE share <= level), cap)) AS target FROM l),
k AS (SELECT d.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
  CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws('|', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(d.size AS VARCHAR))), doc_id, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, budget - b)) + greatest(0, least(size, budget - b - source_size)) + greatest(0, least(size, budget - b - 2 * source_size)) AS BIGINT) AS taken FROM k"""

_EOL = "chr(13) || chr(10)"


def _warc() -> str:
    record = f"""'WARC/1.0' || {_EOL} || 'WARC-Type: response' || {_EOL} || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || {_EOL} || 'WARC-Target-URI: '
      || regexp_replace(coalesce(url, ''), '[\\r\\n]', ' ', 'g') || {_EOL} || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || {_EOL} || {_EOL} || coalesce(html, '')"""
    return f"""
WITH r AS (SELECT page_id, {record} AS record FROM pages), h AS (SELECT page_id, sha256(record) AS digest, CAST(strlen(record) + 4 AS BIGINT) AS length FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, digest) - 1 AS copy FROM h), t AS (SELECT greatest(1, ceil(count(*) / 1024.0e0), ceil(sum(length) / 67108864.0e0)) AS segments FROM h),
g AS (SELECT *, CAST(concat('0x', substr(md5(concat_ws('|', coalesce(CAST(page_id AS VARCHAR), ''), digest, CAST(copy AS VARCHAR))), 1, 8)) AS BIGINT) % CAST((SELECT segments FROM t) AS BIGINT) AS segment FROM n)
SELECT page_id, CAST(segment AS BIGINT) AS segment, row_number() OVER w - 1 AS seq, CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", length, digest,
  CASE WHEN page_id % 389 = 7 THEN 'missing' WHEN page_id % 97 = 13 THEN 'damaged' ELSE 'ok' END AS status FROM g WINDOW w AS (PARTITION BY segment ORDER BY md5(coalesce(CAST(page_id AS VARCHAR), '')), page_id NULLS FIRST, digest, copy)"""


def _urls() -> str:
    fits = [(r, f"(host = {_quoted(r.host)} OR ends_with(host, {_quoted('.' + r.host)})) AND starts_with(path, {_quoted(r.path)})") for r in sorted(URL_RULES, key=lambda r: -len(r.host + r.path))]
    rule = " ".join(f"WHEN {test} THEN {_quoted(r.host + r.path)}" for r, test in fits)
    verdict = " ".join(f"WHEN {test} THEN {_quoted(r.verdict)}" for r, test in fits)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM h"""


def _secrets() -> str:
    parts = []
    for rank, rule in enumerate(SECRET_RULES):
        # no lookbehind here: the character before the edge is part of the hit, and cut off again
        own, p = _quoted(rule.pattern), _quoted(f"(?:^|[^{rule.edge[1:]}){rule.pattern}" if rule.edge else rule.pattern)
        long = f"length(regexp_extract(hit, {own}, {rule.group}))"
        lead = f"length(hit) - length(regexp_extract(hit, {own}))" if rule.edge else "0"
        parts.append(f"""SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, start + {lead} AS start, start + length(hit) AS stop FROM (
  SELECT rid, hit, CAST(coalesce(sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap) AS BIGINT) AS start FROM (
  SELECT rid, unnest(generate_series(1, len(gaps))) AS i, unnest(gaps) AS gap, unnest(hits) AS hit FROM (SELECT rid, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits FROM d WHERE regexp_matches(text, {p})))) WHERE hit IS NOT NULL AND {long} >= {rule.least}""")
    text = "kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in SECRET_RULES if r.base)
    names = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in SECRET_RULES if r.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), s AS ({' UNION ALL '.join(parts)}),
g AS (SELECT rid, {counts}, string_agg({text}, ',' ORDER BY start, rank) FILTER (WHERE base) AS b, string_agg({text}, ',' ORDER BY start, rank) AS a FROM s GROUP BY rid)
SELECT doc_id, {names}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN g USING (rid)"""


VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9e0),
c(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.x, p.y FROM c JOIN p ON p.x = c.y),
n AS (SELECT x, count(*) AS n_links FROM p GROUP BY 1), m AS (SELECT x, min(y) AS component_id FROM c GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m ON m.x = vec_id LEFT JOIN n ON n.x = vec_id"""



def _quality() -> str:
    failed = ", ".join(f"count(*) FILTER (WHERE {test}) AS f_{rule}" for rule, test in QUALITY_RULES.items())
    totals = ", ".join(f"sum(f_{r}) / sum(n) AS m_{r}, sum(CAST(f_{r} AS DOUBLE) * f_{r} / n) AS s_{r}" for r in QUALITY_RULES)
    over = ", ".join(f"m_{r} * (1 - m_{r}) * (n - n2 / n - (k - 1)) AS o_{r}, s_{r} - n * m_{r} * m_{r} - m_{r} * (1 - m_{r}) * (k - 1) AS d_{r}" for r in QUALITY_RULES)
    rate = lambda r: f"CASE WHEN o_{r} <= 0 OR d_{r} <= 0 THEN m_{r} WHEN d_{r} >= o_{r} THEN f_{r} / h.n ELSE (f_{r} + m_{r} * (o_{r} - d_{r}) / d_{r}) / (h.n + (o_{r} - d_{r}) / d_{r}) END"
    verdict = " ".join(f"WHEN {rate(r)} > {REJECT_RATE} THEN '{r}'" for r in QUALITY_RULES)
    base = " OR ".join(f"({QUALITY_RULES[r]})" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD_CHAR}')) AS lines FROM d),
w AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS three FROM d WHERE len(words) > 2),
t AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, three) AS times FROM w),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY rid),
m AS (SELECT d.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d JOIN l USING (rid) LEFT JOIN c ON c.rid = d.rid),
h AS (SELECT source, count(*) AS n, {failed} FROM m GROUP BY source),
a AS (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(CAST(n AS DOUBLE) * n) AS n2, {totals} FROM h), b AS (SELECT *, {over} FROM a),
v AS (SELECT source, CASE {verdict} END AS host_rule FROM h, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, {base} AS base_failed, host_rule, NOT ({base}) AND host_rule IS NULL AS kept FROM m JOIN v ON v.source IS NOT DISTINCT FROM m.source"""


def _clusters() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""p{r} AS (SELECT rid, vec_id, cell, c, list_sum(list_transform(list_zip(cell, mid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS apart FROM v, c{r}),
n{r} AS (SELECT rid, vec_id, any_value(cell) AS cell, arg_min(c, apart * 100 + c) AS c, CAST(min(apart) AS BIGINT) AS apart FROM p{r} GROUP BY rid, vec_id)""")
        if r < ROUNDS:
            steps.append(f"""s{r} AS (SELECT c, axis, sum(x) AS total, count(*) AS n FROM (SELECT c, unnest(range({DIMENSIONS})) AS axis, unnest(cell) AS x FROM n{r}) GROUP BY c, axis),
m{r} AS (SELECT c, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY axis) AS mid FROM s{r} GROUP BY c),
c{r + 1} AS (SELECT c{r}.c, coalesce(m{r}.mid, c{r}.mid) AS mid FROM c{r} LEFT JOIN m{r} USING (c))""")
    return f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS cell FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS (SELECT c - 1 AS c, mid FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), cell) AS c, cell AS mid FROM v) WHERE c <= {CLUSTERS}),
{', '.join(steps)}
SELECT vec_id, CAST(n.c AS INTEGER) AS cluster, apart AS distance, CAST(sum(apart) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia, CAST(sum(apart) OVER () AS BIGINT) AS inertia, sha256(array_to_string(mid, ',')) AS centroid_sha256
FROM n{ROUNDS} n JOIN c{ROUNDS} k ON k.c = n.c"""


ORACLES = {"op11_host_quality": _quality(), "op12_ball_tree_clusters": _clusters(), "op1_embedding_dedup": VECTORS, "op2_source_mixing": MIXING, "op6_warc_fixity": _warc(), "op7_url_filter": _urls(), "op9_secret_scan": _secrets()}
