"""DuckDB equivalents of the operators' queries, where SQL can express them."""

import re

DECONTAMINATE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (
          SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
size_of AS (SELECT DISTINCT m FROM win),
dw AS (SELECT r, k, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (
         SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, size_of WHERE len(w) >= m)),
hit AS (SELECT r, k, m, item_id FROM dw JOIN win USING (m, s)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS p FROM (SELECT DISTINCT r, k, m FROM hit)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN named USING (r)
"""

NEAR_COPIES = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(w[k:k + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
links AS (SELECT x, y FROM (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2) p
          JOIN n nx ON nx.r = p.x JOIN n ny ON ny.r = p.y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
reach(r, o) AS (SELECT r, r FROM d UNION SELECT reach.r, links.y FROM reach JOIN links ON links.x = reach.o)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(e.doc_id) AS component_id
FROM d LEFT JOIN n ON n.r = d.r JOIN reach ON reach.r = d.r JOIN d e ON e.r = reach.o GROUP BY d.r, d.doc_id
"""

SECRETS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source, lang FROM documents),
kinds(k, kind, least) AS (VALUES (0, 'assign', 8), (1, 'access', 16), (2, 'hex', 32), (3, 'bare', 20)),
parts AS (SELECT r, k, kind, least, m, v, g, generate_subscripts(m, 1) AS i FROM (
   SELECT r, k, kind, least, CASE k WHEN 0 THEN regexp_extract_all(t, RE0) WHEN 1 THEN regexp_extract_all(t, RE1) WHEN 2 THEN regexp_extract_all(t, RE2) ELSE regexp_extract_all(t, RE3) END AS m,
     CASE k WHEN 0 THEN regexp_extract_all(t, RE0, 2) WHEN 1 THEN regexp_extract_all(t, RE1) WHEN 2 THEN regexp_extract_all(t, RE2) ELSE regexp_extract_all(t, RE3) END AS v,
     CASE k WHEN 0 THEN string_split_regex(t, RE0) WHEN 1 THEN string_split_regex(t, RE1) WHEN 2 THEN string_split_regex(t, RE2) ELSE string_split_regex(t, RE3) END AS g
   FROM d, kinds)),
placed AS (SELECT r, k, kind, least, m[i] AS m, v[i] AS v,
         sum(length(g[i])) OVER w + coalesce(sum(length(m[i])) OVER (PARTITION BY r, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
       FROM parts WINDOW w AS (PARTITION BY r, k ORDER BY i)),
found AS (SELECT r, k, kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e, v FROM placed WHERE length(v) >= least),
cand AS (SELECT * FROM found WHERE k < 3 UNION ALL
         SELECT * FROM found f WHERE k = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')
           AND NOT EXISTS (SELECT 1 FROM found b WHERE b.r = f.r AND b.k < 3 AND b.s < f.e AND f.s < b.e)),
freq AS (SELECT v, count(DISTINCT coalesce('+' || source, '-')) AS owners FROM cand JOIN d USING (r) GROUP BY v),
told AS (SELECT r, k, s, kind || ':' || s || ':' || e AS x,
           CASE WHEN owners >= 3 THEN 'example' WHEN len(list_distinct(string_split(v, ''))) < 8 THEN 'filler' ELSE 'specific' END AS verdict FROM cand JOIN freq USING (v)),
agg AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
          string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY s, k) FILTER (k < 3 OR verdict = 'specific') AS spans,
          count(*) FILTER (verdict = 'specific') AS n_specific, count(*) FILTER (verdict = 'example' AND k < 3) AS n_example FROM told GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_specific, 0) AS n_specific, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN agg USING (r)
"""
for _k, _re in enumerate((
    """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "AKIA[A-Z0-9]+", "[0-9a-f]{32,}", "[A-Za-z0-9+/_=-]{20,}",
)):
    SECRETS = SECRETS.replace(f"RE{_k}", f"'{_re}'")

MERKLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, F(doc_id) || F(source) || F(lang) AS head, n_chars, F(text) AS tail,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii((doc_id::VARCHAR)[k])::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS crc FROM documents),
leaf AS (SELECT r, doc_id, coalesce('+' || lang, '') AS b, sha256(head || F(n_chars) || tail) AS h,
    sha256(head || F(n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END) || tail) AS h2 FROM d),
placed AS (SELECT r, doc_id, b, h, h2, row_number() OVER (PARTITION BY b ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY b) AS n FROM leaf),
low(b, l, p, n, h) AS (SELECT b, 0::BIGINT, p, n, h FROM placed UNION ALL
  SELECT b, l + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM low WHERE n > 1 GROUP BY b, l, p // 2, n),
tops AS (SELECT b, h, row_number() OVER (ORDER BY b) - 1 AS p, count(*) OVER () AS n FROM low WHERE n = 1),
high(l, p, n, h) AS (SELECT 0::BIGINT, p, n, h FROM tops UNION ALL
  SELECT l + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM high WHERE n > 1 GROUP BY l, p // 2, n),
sides AS (SELECT a.r, 0 AS part, s.l, s.h FROM placed a JOIN low s ON s.b = a.b AND s.p = xor(a.p >> s.l, 1) UNION ALL
  SELECT a.r, 1, s.l, s.h FROM placed a JOIN tops t ON t.b = a.b JOIN high s ON s.p = xor(t.p >> s.l, 1)),
told AS (SELECT r, sha256(string_agg(h, '' ORDER BY part, l)) AS x FROM sides GROUP BY r),
fold(r, b, l, p, n, h) AS (SELECT r, b, 0::BIGINT, p, n, h2 FROM placed UNION ALL
  SELECT f.r, f.b, f.l + 1, f.p // 2, (f.n + 1) // 2, sha256(CASE WHEN f.p % 2 = 1 THEN s.h ELSE '' END || f.h || CASE WHEN f.p % 2 = 0 THEN coalesce(s.h, '') ELSE '' END)
  FROM fold f LEFT JOIN low s ON s.b = f.b AND s.l = f.l AND s.p = xor(f.p, 1) WHERE f.n > 1),
rise(r, l, p, n, h) AS (SELECT f.r, 0::BIGINT, t.p, t.n, f.h FROM fold f JOIN tops t ON t.b = f.b WHERE f.n = 1 UNION ALL
  SELECT f.r, f.l + 1, f.p // 2, (f.n + 1) // 2, sha256(CASE WHEN f.p % 2 = 1 THEN s.h ELSE '' END || f.h || CASE WHEN f.p % 2 = 0 THEN coalesce(s.h, '') ELSE '' END)
  FROM rise f LEFT JOIN high s ON s.l = f.l AND s.p = xor(f.p, 1) WHERE f.n > 1),
root AS (SELECT h FROM high WHERE n = 1)
SELECT a.doc_id, a.h AS leaf, t.h AS subroot, root.h AS root, coalesce(told.x, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root.h AS verified
FROM placed a JOIN tops t ON t.b = a.b JOIN rise f ON f.r = a.r AND f.n = 1 LEFT JOIN told ON told.r = a.r CROSS JOIN root
"""
MERKLE = re.sub(r"\bF\(([^()]*(?: CASE [^()]*)?)\)", r"coalesce(strlen((\1)::VARCHAR)::VARCHAR || ':' || (\1)::VARCHAR, '-')", MERKLE)

HARD_NEGATIVES = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY rank <= 3
"""
