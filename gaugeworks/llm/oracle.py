"""SQL for the queries that SQL can express, over the whole tables. Components are recursive reachability."""

from __future__ import annotations

COMPONENTS = """reach AS (SELECT id AS node, id AS seen FROM ids UNION SELECT node, b FROM reach JOIN links ON a = seen),
component AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)"""

CHAT = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
     sized AS (SELECT *, length(regexp_replace(role, '\\|### |</turn>|<\||:|\n', '\\\0', 'g')) + length(regexp_replace(text, '\\|### |</turn>|<\|', '\\\0', 'g')) + 14 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::bigint AS formatted_chars, 0::bigint AS attachment_tokens
FROM sized GROUP BY conv_id"""

EMBEDDINGS = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::double[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
units AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM vectors),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM units p JOIN units q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) AND list_dot_product(p.e, q.e) / (p.size * q.size) >= 0.95),
ids AS (SELECT vec_id AS id FROM embeddings), {COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN component ON node = vec_id"""

NEAR_COPIES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS item FROM sets), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM items x JOIN items y ON x.item = y.item AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(p.n) + any_value(q.n) - count(*))),
ids AS (SELECT doc_id AS id FROM documents), {COMPONENTS}
SELECT doc_id, n AS n_shingles, component_id FROM sizes JOIN component ON node = doc_id"""

INFILLING = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
sized AS (SELECT *, length(text) AS n, cast('0x' || h[1:8] AS BIGINT) AS h1, cast('0x' || h[9:16] AS BIGINT) AS h2, cast('0x' || h[17:24] AS BIGINT) AS h3, cast('0x' || h[25:32] AS BIGINT) AS h4 FROM hashed),
formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM sized),
parts AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM formed)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN a END::bigint AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::bigint AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts"""

ORACLE_SQL = {"op1_chat_format": CHAT, "op5_embed_dedup": EMBEDDINGS, "op9_jaccard_join": NEAR_COPIES, "op12_fill_in_middle": INFILLING}
