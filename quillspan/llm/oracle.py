"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

import importlib.util

from quillspan.llm.quality_rules import NAVIGATION, PHRASES

_WORDS = r"""w AS (SELECT d.rowid AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents_rows d)""".replace("d.rowid AS r", "r")
_ROWS = "documents_rows AS (SELECT row_number() OVER () AS r, * FROM documents)"

OP2 = rf"""
WITH {_ROWS}, {_WORDS},
g AS (SELECT r, i, ws[i:i+4] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM c WHERE n > 1) GROUP BY 1),
l AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents_rows),
m AS (SELECT r, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l),
j AS (SELECT r, line, len(ws) AS n, (len(ws) <= 20 AND regexp_matches(lower(line), '{"|".join(PHRASES).replace("'", "''")}')
  OR regexp_matches(line, '{NAVIGATION}') AND len(ws) <= 6 * (length(regexp_replace(line, '[^|»›·•]+', '', 'g')) + 1)
  OR len(list_filter(ws, lambda x: regexp_matches(x, '^(?:https?://|www\.).'))) >= greatest(2, len(ws) / 2.0)
  OR (len(ws) >= 8 AND NOT regexp_matches(line, '[.!?…。][)"''”’»*]*(?:$|[\x20\x09-\x0D])'))
  OR len(list_filter(ws, lambda x: regexp_matches(x, '(?:[#*$%&<>=~^]{{2,}}|!!+)$'))) >= 0.3 * len(ws)
  OR (regexp_matches(line, '\p{{Lu}}') AND NOT regexp_matches(line, '\p{{Ll}}') AND len(ws) >= 2)) AS bad FROM m WHERE len(ws) > 0),
q AS (SELECT r, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (bad) AS removed, coalesce(sum(n) FILTER (NOT bad), 0) AS clean FROM j GROUP BY 1),
o AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS lines_removed, coalesce(clean, 0)::BIGINT AS clean_words
  FROM w JOIN documents_rows d USING (r) LEFT JOIN rep USING (r) LEFT JOIN q USING (r))
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 10 * clean_words >= 7 * n_words AS kept FROM o"""

OP3 = rf"""
WITH RECURSIVE {_ROWS}, {_WORDS},
s AS (SELECT DISTINCT r, g FROM (SELECT r, unnest(CASE WHEN len(ws) < 5 THEN [ws] ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i:i+4]) END) AS g FROM w WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
e AS (SELECT a, b, c = x.n AND c = y.n AS equal FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
k AS (SELECT r AS a, r AS b FROM documents_rows UNION SELECT k.a, e.b FROM k JOIN e ON k.b = e.a),
m AS (SELECT k.a, min(d.doc_id) AS class_id FROM k JOIN documents_rows d ON d.r = k.b GROUP BY 1),
l AS (SELECT a, count(*) AS n, count(*) FILTER (equal) AS same FROM e GROUP BY 1)
SELECT doc_id, class_id, coalesce(l.n, 0)::BIGINT AS n_links, (coalesce(l.same, 0) + 1)::BIGINT AS n_copies FROM documents_rows d JOIN m ON m.a = d.r LEFT JOIN l ON l.a = d.r"""

_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {0}, 10))::BIGINT >> {1}) & 31)::INT, 1)"
_BASE32 = " || ".join(_LETTER.format(10 * i + 1, 35 - 5 * j) for i in range(4) for j in range(8))

OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to FROM p JOIN f USING (h)"""

OP8 = rf"""
WITH {_ROWS}, {_WORDS},
g AS (SELECT r, i, array_to_string(ws[i:i+34], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM c),
x AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT x.r, count(gone.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.p) FILTER (gone.p IS NULL), '') AS kept FROM x LEFT JOIN gone ON gone.r = x.r AND gone.p = x.p GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)"""

OP9 = r"""
WITH RECURSIVE v AS (SELECT replace(k, 'Ġ', ' ') AS run FROM (SELECT unnest(json_keys(model, '$.vocab')) AS k FROM read_json('TOKENIZER', columns = {model: 'JSON'}, maximum_object_size = 100000000)) WHERE regexp_full_match(k, 'Ġ?[A-Za-z]+')),
t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
t1 AS (SELECT *, '<|im_start|>' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\/') || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10) AS body,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM t0),
p AS (SELECT conv_id, n, unnest(regexp_extract_all(body, chr(39) || '\p{L}+| ?\p{L}+')) AS run FROM t1),
k AS (SELECT conv_id, n, sum(length(run) - 1) AS saved FROM p JOIN v USING (run) GROUP BY 1, 2),
t2 AS (SELECT t1.*, (strlen(body) - coalesce(saved, 0))::BIGINT AS size FROM t1 LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM t1.conv_id AND k.n = t1.n),
t3 AS (SELECT *, (sum(size) OVER w - size) // 131072 AS seg, first_value(role) OVER w = 'system' AS has, first_value(size) OVER w AS s0, length(first_value(body) OVER w) AS b0,
  lag(size, 1) OVER w AS s1, lag(size, 2) OVER w AS s2, lag(length(body), 1) OVER w AS b1, lag(length(body), 2) OVER w AS b2 FROM t2 WINDOW w AS (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t4 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, seg ORDER BY n) - 1 AS i, CASE WHEN has AND n > 1 AND s0 + size <= 2048 THEN s0 ELSE 0 END AS sys FROM t3),
t5 AS (SELECT *, i - CASE WHEN has AND n - i = 1 THEN 1 ELSE 0 END AS free, least(512, 2048 - sys - size) AS room FROM t4),
t6 AS (SELECT *, CASE WHEN free >= 2 AND s1 + s2 <= room THEN 2 WHEN free >= 1 AND s1 <= room THEN 1 ELSE 0 END AS h FROM t5),
t7 AS (SELECT *, sys + CASE h WHEN 2 THEN s1 + s2 WHEN 1 THEN s1 ELSE 0 END AS head, CASE WHEN sys > 0 THEN b0 ELSE 0 END + CASE h WHEN 2 THEN b1 + b2 WHEN 1 THEN b1 ELSE 0 END AS past FROM t6),
f AS (SELECT conv_id, n, seg, true AS opens, head + size AS used FROM t7 WHERE n = 1
  UNION ALL SELECT t7.conv_id, t7.n, t7.seg, t7.seg <> f.seg OR f.used + t7.size > 2048, CASE WHEN t7.seg <> f.seg OR f.used + t7.size > 2048 THEN t7.head ELSE f.used END + t7.size
  FROM f JOIN t7 ON t7.conv_id IS NOT DISTINCT FROM f.conv_id AND t7.n = f.n + 1)
SELECT t7.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY t7.n)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY t7.n) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(length(body) + CASE WHEN opens THEN past ELSE 0 END)::BIGINT AS formatted_chars, count(*) FILTER (opens) AS n_windows
FROM t7 JOIN f ON f.conv_id IS NOT DISTINCT FROM t7.conv_id AND f.n = t7.n GROUP BY 1"""

OP11 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.vec_id, s.r) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

OP12 = rf"""
WITH {_ROWS}, b AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS blank),
l AS (SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents_rows),
k AS (SELECT r, doc_id, i, line, translate(trim(line, blank), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l, b),
f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT r) >= 5),
g AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.holder AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY r"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, length(t)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def _with_vocabulary(sql: str) -> str:
    import public_tokenizers

    return sql.replace("TOKENIZER", public_tokenizers.path("byte_bpe_50k.json"))


ORACLE = {"op2_quality_rules": OP2, "op3_chosen_path": OP3, "op5_warc": OP5, "op8_superkmer": OP8, "op11_annuli": OP11, "op12_line_runs": OP12, "op13_middle": OP13}
if importlib.util.find_spec("public_tokenizers"):  # the SQL reads the vocabulary from its file
    ORACLE["op9_chat_windows"] = _with_vocabulary(OP9)
