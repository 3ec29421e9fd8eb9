"""DuckDB SQL for the numbered queries that SQL can express."""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, md5(COALESCE(text, '')))), 1, 15))::BIGINT AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, (2.0::DOUBLE * source_size) AS cap, (2.0::DOUBLE * source_size) / w AS ratio,
         1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE AS everything
  FROM s
), l AS (
  SELECT *, (everything - COALESCE(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), t AS (
  SELECT source, source_size, LEAST(cap, COALESCE((SELECT max(level) FROM l WHERE level < ratio) * w, cap)) AS target FROM l
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + GREATEST(0, LEAST(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken
FROM c
"""

OP5 = r"""
WITH w AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, array_to_string(ws[i : i + 9], ' ') AS win, LEAST(len(ws), 10) AS n
  FROM (SELECT item_id, ws, unnest(range(1, GREATEST(len(ws) - 8, 2))) AS i FROM w WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT n FROM win
), d AS (
  SELECT row_number() OVER () AS r, doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents
), p AS (
  SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)
), h AS (SELECT p.r, p.i, p.n, win.item_id FROM p JOIN win USING (win, n)
), hw AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS word FROM h) GROUP BY r
), hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
       sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""

OP6 = r"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
  FROM (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (SELECT k.*, r.first_doc IS NOT NULL AND k.doc_id <> r.first_doc AS dropped FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP4 = r"""
WITH p AS (
  SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS h, min(page_id) OVER (PARTITION BY sha1(COALESCE(html, ''))) AS first_page
  FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS digest
  FROM p
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_page THEN first_page END AS refers_to
FROM b
"""


OP12 = r"""
WITH d AS (SELECT doc_id, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS n FROM d)
SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""


def _licenses() -> str:
    from tracewise.llm import licenses

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(k)})" for s, k in licenses.KNOWN.items())
    rules = ", ".join(f"({n}, {quoted(name)}, [{', '.join(map(quoted, parts))}])" for n, (name, parts) in enumerate(licenses.ALL_RULES))
    return rf"""
WITH RECURSIVE known(s, sid) AS (VALUES {known}), rules(rule, license, parts) AS (VALUES {rules}),
t AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_replace(translate(regexp_replace(regexp_replace(COALESCE(text, ''), '\n([^a-z]|\z)', chr(1) || '\1', 'g'), '[.!?][\x20\x09-\x0D]', chr(1), 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\x01]+', ' ', 'g') AS plain
  FROM documents
), s AS (SELECT r, doc_id, list_filter(list_transform(string_split(plain, chr(1)), lambda x: trim(x)), lambda x: x <> '') AS sents FROM t
), e AS (
  SELECT s.r, s.i, known.sid FROM (SELECT r, unnest(sents) AS sent, generate_subscripts(sents, 1) AS i FROM s) s JOIN known ON s.sent = known.s
), m AS (
  SELECT e.r, e.i AS first, min(rule) AS rule FROM e JOIN rules ON e.sid = rules.parts[1]
  WHERE (SELECT count(*) FROM e AS o WHERE o.r = e.r AND o.i >= e.i AND o.i < e.i + len(rules.parts) AND o.sid = rules.parts[o.i - e.i + 1]) = len(rules.parts)
  GROUP BY e.r, e.i
), n AS (SELECT m.r, m.first, m.first + len(rules.parts) AS after, rules.license FROM m JOIN rules USING (rule)
), walk AS (
  SELECT r, first, after, license FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY first) AS k FROM n) WHERE k = 1
  UNION ALL
  SELECT r, first, after, license FROM (
    SELECT n.*, row_number() OVER (PARTITION BY n.r ORDER BY n.first) AS k FROM walk JOIN n ON n.r = walk.r AND n.first >= walk.after
  ) WHERE k = 1
)
SELECT s.doc_id, len(s.sents)::BIGINT AS n_sentences,
       (SELECT count(*) FROM e WHERE e.r = s.r)::BIGINT AS n_known,
       (SELECT count(*) FROM walk WHERE walk.r = s.r)::BIGINT AS n_matches,
       COALESCE((SELECT string_agg(license, ',' ORDER BY license) FROM (SELECT DISTINCT license FROM walk WHERE walk.r = s.r)), '') AS licenses
FROM s
"""


SQL = {"op4_warc": OP4, "op5_decontamination": OP5, "op6_line_dedup": OP6, "op7_license_scan": _licenses(), "op8_mixing": OP8, "op12_exact_dedup": OP12}
