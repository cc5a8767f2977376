"""The queries that SQL can express, as DuckDB SQL."""

from __future__ import annotations

from .common import LOWER, UPPER
from .quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS

URL_FILTER = f"""WITH rules(h, p, rule, verdict) AS (VALUES ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'),
  ('net', '/de/', 'net/de/', 'allow'), ('example.net', '/de/8', 'example.net/de/8', 'block'), ('org', '/es/', 'org/es/', 'block')),
rests AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM rests),
longest AS (SELECT DISTINCT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host,
  '(^|[^a-z0-9])(spam[^a-z0-9]+farm|cheap[^a-z0-9]+pills|free[^a-z0-9]+casino|online[^a-z0-9]+casino|adult|porn|xxx|payday[^a-z0-9]+loans|link[^a-z0-9]+farm)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN longest USING (host, path)"""

_TAKEN = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""WITH items AS (SELECT item_id, {_TAKEN} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS words FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_TAKEN} AS w FROM documents),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows x ON x.n = p.n AND x.words = array_to_string(p.w[i:i + p.n - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS at_word FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

_STOP = ", ".join(f"'{x}'" for x in dict.fromkeys([*STOP_WORDS, *(x.capitalize() for x in STOP_WORDS)]))
_FAILS = " OR ".join(f"{r.count} {'<' if r.below else '>'} {r.share}::DOUBLE * {r.of}" for r in RULES)

QUALITY_RULES = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l FROM documents),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS times FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
repeats AS (SELECT doc_id, count(DISTINCT at_word) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS at_word FROM windows WHERE times > 1) GROUP BY doc_id),
counts AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
  len([x for x in w if x IN ({_STOP})])::BIGINT AS n_stop, len([x for x in l if ends_with(x, '...') OR ends_with(x, '…')])::BIGINT AS n_open_lines,
  len(regexp_extract_all(body, '\\p{{Lu}}[^\\x20\\x09-\\x0D\\p{{Ll}}]*!!'))::BIGINT AS n_shout FROM texts LEFT JOIN repeats USING (doc_id)),
based AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_FAILS}) AS kept FROM based"""

TOP_K = """WITH points AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT q.vec_id AS query_id, p.vec_id, list_inner_product(q.x, p.x)::BIGINT AS score FROM points q JOIN points p ON p.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

#: For tables whose messages hold no call and no result, as the given ones: each message is a line of its own.
CHAT_FORMAT = """WITH spoken AS (SELECT conv_id, turn, CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN role ELSE 'user' END AS role, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, turn, 0 AS level, role, concat('{"content":', to_json(text), ',"conv_id":' || conv_id, ',"role":"', role, '"', ',"turn":' || turn, '}') AS line,
  0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_valid FROM spoken"""

ORACLES = {"op5_chat_format": CHAT_FORMAT, "op11_top_k": TOP_K, "op1_url_filter": URL_FILTER, "op2_decontaminate": DECONTAMINATE, "op6_quality_rules": QUALITY_RULES}
