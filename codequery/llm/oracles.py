"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from codequery.llm.mixing import PASSES, SHARE, WEIGHTS
from codequery.llm.quality import FENCE, LEAST_ROWS, RATES
from codequery.llm.vectors import EVERY, NEAREST

_WORD = r"[^\x20\x09-\x0D]+"


def _quality() -> str:
    ladder = "CASE WHEN v < 64 THEN v " + " ".join(f"WHEN v < {64 << k} THEN v // {1 << k} * {1 << k}" for k in range(1, 5)) + " ELSE 1024 END"
    spread = "CASE rate " + " ".join(f"WHEN '{name}' THEN {least}" for name, least in RATES) + " END"
    most = ", ".join(f"max(most) FILTER (WHERE rate = '{name}') AS most_{name}" for name, _ in RATES)
    pick = ", ".join(f"CASE WHEN f.total >= {LEAST_ROWS} THEN f.most_{name} WHEN l.total >= {LEAST_ROWS} THEN l.most_{name} ELSE w.most_{name} END AS most_{name}" for name, _ in RATES)
    high = " OR ".join(f"{name} > most_{name}" for name, _ in RATES)
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '\p{{Lu}}')) AS caps, len(ls) AS n_lines
  FROM w LEFT JOIN covered c USING (doc_id)),
r AS (
  SELECT *, coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0)::BIGINT AS symbol_rate, coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0)::BIGINT AS repeat_rate,
    coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0)::BIGINT AS line_rate, coalesce(caps * 1000 // nullif(word_chars, 0), 0)::BIGINT AS capital_rate,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM f),
long AS (UNPIVOT (SELECT lang, source, {', '.join(name for name, _ in RATES)} FROM r) ON {', '.join(name for name, _ in RATES)} INTO NAME rate VALUE v),
fine AS (SELECT lang, source, rate, {ladder} AS bin, count(*) AS n FROM long GROUP BY ALL),
every AS (
  SELECT 0 AS level, lang, source, rate, bin, n FROM fine
  UNION ALL SELECT 1, lang, NULL, rate, bin, sum(n) FROM fine GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, rate, bin, sum(n) FROM fine GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM every),
marks AS (SELECT level, lang, source, rate, min(bin) FILTER (WHERE 100 * cum >= 25 * total) AS q25, min(bin) FILTER (WHERE 100 * cum >= 75 * total) AS q75, max(total) AS total FROM run GROUP BY ALL),
mosts AS (SELECT level, lang, source, total, rate, q75 + {FENCE} * greatest(q75 - q25, {spread}) AS most FROM marks),
wide AS (SELECT level, lang, source, max(total) AS total, {most} FROM mosts GROUP BY ALL),
lim AS (
  SELECT f.lang, f.source, {pick} FROM (SELECT * FROM wide WHERE level = 0) f
  JOIN (SELECT * FROM wide WHERE level = 1) l ON f.lang IS NOT DISTINCT FROM l.lang CROSS JOIN (SELECT * FROM wide WHERE level = 2) w)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({high}) AS kept,
  {', '.join(name for name, _ in RATES)}, {', '.join(f'most_{name}::BIGINT AS most_{name}' for name, _ in RATES)}
FROM r JOIN lim ON r.lang IS NOT DISTINCT FROM lim.lang AND r.source IS NOT DISTINCT FROM lim.source"""


def _mixing() -> str:
    n = len(WEIGHTS)
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % " + f"{n} " + " ".join(f"WHEN {i} THEN {float(w)}::DOUBLE" for i, w in enumerate(WEIGHTS)) + " END"
    taken = " + ".join(f"greatest(0, least(size, cut - {k} * source_size - start))" for k in range(PASSES))
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {weight} AS weight, {PASSES} * source_size AS full_size FROM s),
e AS (SELECT *, full_size / weight AS ends FROM w),
v AS (
  SELECT *, ({SHARE} * sum(source_size) OVER () - coalesce(sum(full_size) OVER upto, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER upto, 0)) AS lv FROM e
  WINDOW upto AS (ORDER BY ends, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, weight, least(full_size::DOUBLE, weight * coalesce(max(lv) FILTER (WHERE lv <= ends) OVER (), max(ends) OVER ())) AS target FROM v),
q AS (
  SELECT doc_id, size, source_size, target, weight, round(target)::BIGINT AS cut,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ({taken})::BIGINT AS taken, ((start + size) / weight)::DOUBLE AS virtual_finish FROM q"""


def _nearest() -> str:
    fine = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return rf"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {fine}),
a AS (SELECT vec_id, min(v) AS v FROM e WHERE vec_id % {EVERY} = 0 GROUP BY vec_id),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, x: a + x) AS score
  FROM a q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= {NEAREST}"""


def _warc() -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digit = lambda k: f"substr('{alphabet}', ((v >> {15 - 5 * k}) & 31) + 1, 1)"
    return rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p),
d AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::INTEGER) AS v5 FROM m)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(v5, lambda v: {' || '.join(digit(k) for k in range(4))}), '') AS payload_digest,
  CASE WHEN top IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM d"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": _quality(), "op5_source_mixing": _mixing(), "op6_warc": _warc(), "op8_block_search": _nearest()}
