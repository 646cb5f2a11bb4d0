"""Text, token-budget, retrieval and corpus-check queries, on built-in functions only."""

from normalog.plans.library import relation

relation("turns", "SELECT conv_id, turn, role, text, {div|(length(text) + 1)|4} AS tokens FROM conversations")
relation("names", "SELECT n_nationkey AS id, n_name AS name, lower(n_name) AS low FROM nation")
relation("asked", "SELECT page_id AS q, CASE page_id % 4 WHEN 0 THEN concat('the nation_', page_id % 25) WHEN 1 THEN concat('nation_', page_id % 3, '0') WHEN 2 THEN concat('go to NATION_', page_id % 25, ' now') ELSE substr(concat('nation_', page_id % 25), 1, 6) END AS arg FROM pages")
relation("asked_norm", "SELECT q, regexp_replace(trim({sub|lower(arg)|'\\s+'|' '}), '^(the|a|an)\\s+', '') AS low FROM asked")
relation("doc_tokens", "SELECT doc_id, {tokens|lower(text)} AS t FROM documents")
relation("grams", "SELECT doc_id, {rows|{pairs|t}} AS g FROM doc_tokens")

QUERIES = {
    "approx_tokens": "SELECT conv_id, sum(tokens) AS sum_turns, {div|sum(length(text) + 1)|4} AS whole FROM turns GROUP BY conv_id",
    "window_shed": "SELECT conv_id, turn FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS kept FROM turns) x WHERE kept <= 600",
    "rolling_buffer": "SELECT conv_id, turn FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS kept, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM turns) x WHERE kept <= 300 OR n = 1",
    "eviction_point": "SELECT a.conv_id, a.turn, min(b.turn) AS left_at FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM turns) a JOIN (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM turns) b ON b.conv_id = a.conv_id AND b.turn >= a.turn AND b.c - (a.c - a.tokens) > 600 GROUP BY a.conv_id, a.turn",
    "prefix_budget": "SELECT conv_id, turn FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM turns) x WHERE used <= 2000 OR n = 1",
    "tail_clip": "SELECT conv_id, turn, {right|text|400} AS tail FROM turns",
    "transcript_prefix": "SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS chars FROM turns",
    "pad_dup_rate": "SELECT source, round(1 - count(DISTINCT text) / greatest(count(*), 1), 6) AS rate FROM documents GROUP BY source",
    "norm_text": "SELECT q, low FROM asked_norm",
    "slug": "SELECT page_id, CASE WHEN s = '' THEN 'x' ELSE s END AS slug FROM (SELECT page_id, substr({strip|'_'|{sub|lower(url)|'[^a-z0-9]+'|'_'}}, 1, 40) AS s FROM pages) x",
    "speaker_prefix": "SELECT conv_id, turn, regexp_extract(concat('Ann ', role, ': ', text), '^\\s*([A-Z][^:\\n]{1,60}?):\\s+', 1) AS speaker FROM turns",
    "session_header": "SELECT conv_id, turn, cast({get|concat('[Session ', conv_id * 10 + turn, '] x')|'^\\s*\\[Session (\\d+)'|1} AS bigint) AS session FROM turns",
    "cheatsheet_extract": "SELECT page_id, CASE WHEN position('<p>' IN html) = 0 THEN 'no_tag' WHEN position('</p>' IN html) < position('<p>' IN html) THEN 'malformed' ELSE 'ok' END AS status FROM pages",
    "register_words": "SELECT doc_id, regexp_extract(lower(text), '(^|[^a-z0-9_])(approved?|approval|prohibit(ed|ion)?|bann?ed|ban|supersed[a-z0-9_]*|reaffirm[a-z0-9_]*|reinstat[a-z0-9_]*|contraindicat[a-z0-9_]*|deprecat[a-z0-9_]*|forbid(den)?|may not|must not|off the list|on the list|no longer allowed|cleared for)([^a-z0-9_]|$)', 2) <> '' AS hit FROM documents",
    "name_collisions": "SELECT a.id AS a, b.id AS b FROM names a JOIN names b ON a.id <> b.id AND position(a.low IN b.low) > 0",
    "name_duplicates": "SELECT lower(trim(c_name)) AS low, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1",
    "resolve_entity": """SELECT a.q, CASE WHEN max(CASE WHEN n.low = a.low THEN 1 ELSE 0 END) = 1 THEN min(CASE WHEN n.low = a.low THEN n.id END)
  WHEN count(CASE WHEN position(n.low IN a.low) > 0 OR (position(a.low IN n.low) > 0 AND length(a.low) >= 0.6 * length(n.low)) THEN 1 END) = 1
  THEN max(CASE WHEN position(n.low IN a.low) > 0 OR (position(a.low IN n.low) > 0 AND length(a.low) >= 0.6 * length(n.low)) THEN n.id END) END AS id
FROM asked_norm a JOIN names n ON true GROUP BY a.q""",
    "cosine_topk": "SELECT q, vec_id, place, round(score, 5) AS score FROM (SELECT a.vec_id AS q, b.vec_id, s.score, row_number() OVER (PARTITION BY a.vec_id ORDER BY s.score DESC, b.vec_id) AS place FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 100 = 0 JOIN LATERAL (SELECT {dot|a.embedding|b.embedding} / sqrt({dot|a.embedding|a.embedding} * {dot|b.embedding|b.embedding}) AS score) s ON true) x WHERE place <= 12",
    "cosine_threshold": "SELECT q, count(*) AS n FROM (SELECT a.vec_id AS q, {dot|a.embedding|b.embedding} / sqrt({dot|a.embedding|a.embedding} * {dot|b.embedding|b.embedding}) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 100 = 0) x WHERE score >= 0.1 GROUP BY q",
    "hash_embed": "SELECT doc_id, bucket, w / coalesce(nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 0), 1) AS weight FROM (SELECT doc_id, bucket, sum(CASE WHEN bucket >= 256 THEN 1 ELSE -1 END) AS w FROM (SELECT doc_id, {md5tail|g} % 512 AS bucket FROM grams) x GROUP BY doc_id, bucket) y",
    "md5_dedupe": "SELECT md5(text) AS digest, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY md5(text)",
    "sha_digest16": "SELECT item_id, substr({sha|text}, 1, 16) AS digest FROM benchmark",
    "id_assignment": "SELECT r_regionkey, concat('e', lpad(cast(row_number() OVER (ORDER BY r_name) AS string), 2, '0')) AS id FROM region",
    "condition_label": "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'full' WHEN o_orderstatus = 'F' THEN concat('compact b', o_custkey % 4, ' k', o_custkey % 3) ELSE concat('mem w', o_custkey % 5) END AS label FROM orders",
    "fmt_value": "SELECT p_partkey, concat(lpad(cast({div|p_size|60} AS string), 2, '0'), ':', lpad(cast(p_size % 60 AS string), 2, '0')) AS clock FROM part",
    "rank_of": "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS rank FROM customer",
    "label_agreement": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic",
    "weighted_ratio": "SELECT o_orderpriority, round(sum(o_totalprice * (o_custkey % 3)) / sum(o_totalprice), 5) AS rate FROM orders GROUP BY o_orderpriority",
    "tumbling_events": "SELECT {minute|ts} AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "session_window_events": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '6' HOUR, true) AS gap FROM events) x) y GROUP BY user_id, s",
}
