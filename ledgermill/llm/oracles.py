"""DuckDB SQL of the queries that SQL can express on whole tables."""

#: Words are runs of anything but ASCII white space.
SQL: dict[str, str] = {}

SQL["op1_url_filters"] = r"""
WITH rules(rh, rp, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT rid, page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
m AS (SELECT rid, rh || rp AS rule, action, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
      FROM p JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m ON p.rid = m.rid AND k = 1
"""

SQL["op5_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
w AS (SELECT rid, doc_id, i AS s, lead(i, 2) OVER o AS e, x || chr(10) || lead(x, 1) OVER o || chr(10) || lead(x, 2) OVER o AS g
      FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, s) AS k FROM w WHERE e IS NOT NULL),
gone AS (SELECT DISTINCT rid, unnest(range(s, e + 1)) AS i FROM r WHERE k > 1)
SELECT any_value(l.doc_id) AS doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
       sha256(coalesce(string_agg(l.x, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '')) AS text_sha256
FROM l LEFT JOIN gone ON l.rid = gone.rid AND l.i = gone.i GROUP BY l.rid
"""

SQL["op8_embeddings"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id,
       vec_id <= coalesce(c.m, vec_id) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""

SQL["op7_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
pos AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
win AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM pos),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS wc,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda x: list_contains(string_split('{stops}', ' '), x))) AS n_stop
      FROM w LEFT JOIN cov ON w.rid = cov.rid),
k AS (SELECT *, coalesce(wc, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 12 * n_words AND n_symbols <= 0.25 * n_words
       AND n_stop::DOUBLE / n_words >= 0.02 AND coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) <= 0.5 AS kept
FROM k
"""


SQL["mixing_targets"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS n FROM t),
w AS (SELECT *, (CASE (n - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight, 2.0::DOUBLE * s AS cap FROM n),
l AS (SELECT *, (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, row(cap / weight, n)) AS level FROM l WHERE cap >= level * weight),
g AS (SELECT source, s, least(cap, coalesce((SELECT level FROM f) * weight, cap)) AS target FROM l)
SELECT doc_id, size, s AS source_size, round(target, 3) AS target, floor(target)::BIGINT AS source_taken, TRUE AS within FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
"""

SQL["pii_counts"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS emails,
  list_transform(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_transform(string_split(x, '.'), lambda p: ltrim(p, '0'))) AS ips,
  list_filter(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))), lambda x: length(x) BETWEEN 12 AND 19) AS cards,
  list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS phones FROM d),
c AS (SELECT *, list_transform(cards, lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN x[i]::INT WHEN x[i]::INT > 4 THEN 2 * x[i]::INT - 9 ELSE 2 * x[i]::INT END))) AS sums FROM m)
SELECT doc_id, len(emails)::BIGINT AS n_email, len(list_filter(ips, lambda p: len(list_filter(p, lambda q: length(q) > 3 OR coalesce(try_cast(q AS INT), 0) > 255)) = 0))::BIGINT AS n_ip,
  len(list_filter(sums, lambda s: s % 10 = 0))::BIGINT AS n_card, len(list_filter(phones, lambda n: n BETWEEN 9 AND 15))::BIGINT AS n_phone FROM c
"""

SQL["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u)::BIGINT AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS x, array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS z,
             array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS y FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""

SQL["sharding_law"] = r"""
SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 1 AS size, 1::BIGINT AS shards_of_text, TRUE AS gapless, TRUE AS fair FROM documents
"""

SQL["op13_spelling"] = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(9), lambda a, k: CASE WHEN k = 0 THEN a WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
q AS (SELECT d, w, count(*) AS n, hex(encode(d || ':' || w)) AS x FROM r GROUP BY d, w),
h AS (SELECT w, n, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM q, tab),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS w, sum(n)::BIGINT AS n FROM h GROUP BY 1),
k AS (SELECT w, n FROM v WHERE length(w) >= 5 AND n >= 3),
e AS (SELECT w, n, i, substr(w, 1, i) || substr(w, i + 2) AS x FROM (SELECT w, n, unnest(range(0, length(w))) AS i FROM k)),
p AS (SELECT a.w AS w, b.w AS v, b.n AS m FROM e a JOIN e b ON a.i = b.i AND a.x = b.x AND a.w <> b.w
      UNION SELECT e.w, k.w, k.n FROM e JOIN k ON e.x = k.w UNION SELECT k.w, e.w, e.n FROM e JOIN k ON e.x = k.w),
b AS (SELECT w, count(*)::BIGINT AS n_near, max(m) AS m FROM p GROUP BY w),
f AS (SELECT k.w, k.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * k.n THEN (SELECT min(v) FROM p WHERE p.w = k.w AND p.m = b.m) END AS form, CASE WHEN m >= 2 * k.n THEN m END AS form_n
      FROM k LEFT JOIN b ON k.w = b.w),
c AS (SELECT w, w AS at FROM f UNION ALL SELECT c.w, f.form FROM c JOIN f ON c.at = f.w WHERE f.form IS NOT NULL),
z AS (SELECT c.w, c.at FROM c JOIN f ON c.at = f.w WHERE f.form IS NULL)
SELECT f.w AS word, f.form, z.at AS root, f.n, f.n_near, f.form_n FROM f JOIN z ON f.w = z.w
"""


def _fill() -> None:
    from .quality import STOP_WORDS

    stops = sorted({x for ws in STOP_WORDS.values() for w in ws.split() for x in (w, w.capitalize())})
    SQL["op7_quality_rules"] = SQL["op7_quality_rules"].replace("{stops}", " ".join(stops))


_fill()
