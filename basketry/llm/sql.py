"""DuckDB SQL of the registered queries that SQL can express over whole tables."""

SQL: dict[str, str] = {}

#: words of white-space separated text, in order
_SPACE = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL["op7_substring_dedup"] = f"""
WITH words AS (
    SELECT doc_id, {_SPACE} AS w FROM documents),
runs AS (
    SELECT doc_id, unnest(range(1, len(w) - 18)) AS p0, w FROM words WHERE len(w) >= 20),
hashed AS (
    SELECT doc_id, p0, array_to_string(w[p0:p0 + 19], ' ') AS run FROM runs),
ranked AS (
    SELECT doc_id, p0, row_number() OVER (PARTITION BY run ORDER BY doc_id, p0) AS nth FROM hashed),
gone AS (
    SELECT DISTINCT doc_id, p0 + k AS p
    FROM (SELECT doc_id, p0, unnest(range(0, 20)) AS k FROM ranked WHERE nth > 1)),
one AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
kept AS (
    SELECT o.doc_id, string_agg(o.word, ' ' ORDER BY o.p) AS kept
    FROM one o ANTI JOIN gone g ON o.doc_id = g.doc_id AND o.p = g.p GROUP BY o.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = w.doc_id
LEFT JOIN kept k ON k.doc_id = w.doc_id
"""

SQL["op10_suffix_dedup"] = """
WITH texts AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
    SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS p0, h FROM texts WHERE length(h) >= 200),
ranked AS (
    SELECT doc_id, p0, row_number() OVER (PARTITION BY substr(h, 2 * p0 + 1, 200) ORDER BY doc_id, p0) AS nth
    FROM strings),
starts AS (
    SELECT doc_id, p0, lag(p0) OVER (PARTITION BY doc_id ORDER BY p0) AS before FROM ranked WHERE nth > 1),
spans AS (
    SELECT doc_id, min(p0) AS lo, max(p0) + 100 AS hi
    FROM (SELECT doc_id, p0, sum(CASE WHEN before IS NULL OR p0 > before + 100 THEN 1 ELSE 0 END)
                             OVER (PARTITION BY doc_id ORDER BY p0) AS span FROM starts)
    GROUP BY doc_id, span),
kept AS (
    SELECT t.doc_id, substr(any_value(t.h), 1, 2 * min(s.lo)) || string_agg(
               substr(t.h, 2 * s.hi + 1, 2 * (coalesce(s.next_lo, length(t.h)) - s.hi)), '' ORDER BY s.lo) AS h,
           sum(s.hi - s.lo) AS n, count(*) AS spans
    FROM texts t JOIN (SELECT *, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS next_lo FROM spans) s
         ON s.doc_id = t.doc_id
    GROUP BY t.doc_id)
SELECT t.doc_id, (length(t.h) // 2)::BIGINT AS n_bytes, coalesce(k.n, 0)::BIGINT AS n_removed,
       coalesce(k.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op3_jaccard_join"] = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[p0:p0 + 2], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p0 FROM words WHERE len(w) > 0)),
sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
    SELECT x, y FROM shared JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y
    WHERE 100 * c >= 90 * (sx.n + sy.n - c)),
both_ways AS (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT reach.doc_id, b.y FROM reach JOIN both_ways b ON b.x = reach.r)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""

SQL["op4_decontamination"] = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(__LOWER__, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(__LOWER__, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p0:p0 + 9], ' ') AS s
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p0 FROM items WHERE len(w) > 0)),
sizes AS (
    SELECT DISTINCT n FROM windows),
runs AS (
    SELECT doc_id, n, p0, array_to_string(w[p0:p0 + n - 1], ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p0 FROM docs JOIN sizes ON len(w) >= n)),
hits AS (
    SELECT r.doc_id, r.p0, r.n, k.item FROM runs r JOIN windows k ON k.s = r.s AND k.n = r.n),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(p0, p0 + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit,
       coalesce(f.n_items, 0)::BIGINT AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
""".replace("__LOWER__", _LOWER)

SQL["op2_url_filter"] = r"""
WITH judged AS (
    SELECT page_id,
           coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
    FROM pages),
outcomes AS (
    SELECT j.page_id, max(CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END) AS bad
    FROM judged j JOIN labels l
      ON l.doc_id = TRY_CAST(nullif(regexp_extract(j.path, '(\d{1,18})[^0-9/]*/?$', 1), '') AS BIGINT)
    WHERE l.quality IS NOT NULL OR l.toxic IS NOT NULL
    GROUP BY j.page_id),
named AS (
    SELECT host, count(o.bad)::DOUBLE AS n, coalesce(sum(o.bad), 0)::DOUBLE AS bad,
           regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name
    FROM judged j LEFT JOIN outcomes o ON o.page_id = j.page_id GROUP BY host),
hosts AS (
    SELECT host, n, bad,
           CASE WHEN regexp_matches(name, '^[0-9]+(\.[0-9]+){3}$') THEN name
                ELSE array_to_string(string_split(name, '.')[-2:], '.') END AS domain,
           CASE WHEN regexp_matches(name, '^[0-9]+(\.[0-9]+){3}$') THEN name
                ELSE string_split(name, '.')[-1] END AS suffix
    FROM named),
m0 AS (
    SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS m FROM hosts),
suffixes AS (
    SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m0.m) AS m FROM hosts, m0 GROUP BY suffix),
k1 AS (
    SELECT 1 / coalesce(least(greatest((sum((bad - n * m) * (bad - n * m)) - sum(n * m * (1 - m)))
           / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 1e-4), 0.99), 0.99) - 1 AS k FROM suffixes WHERE n > 0),
suffix_rate AS (
    SELECT suffix, (k * m + bad) / (k + n) AS m FROM suffixes, k1),
domains AS (
    SELECT h.domain, h.suffix, sum(n) AS n, sum(bad) AS bad, any_value(r.m) AS m
    FROM hosts h JOIN suffix_rate r ON r.suffix = h.suffix GROUP BY h.domain, h.suffix),
k2 AS (
    SELECT 1 / coalesce(least(greatest((sum((bad - n * m) * (bad - n * m)) - sum(n * m * (1 - m)))
           / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 1e-4), 0.99), 0.99) - 1 AS k FROM domains WHERE n > 0),
domain_rate AS (
    SELECT domain, suffix, (k * m + bad) / (k + n) AS m FROM domains, k2),
placed AS (
    SELECT h.host, h.n, h.bad, r.m FROM hosts h JOIN domain_rate r ON r.domain = h.domain AND r.suffix = h.suffix),
k3 AS (
    SELECT 1 / coalesce(least(greatest((sum((bad - n * m) * (bad - n * m)) - sum(n * m * (1 - m)))
           / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 1e-4), 0.99), 0.99) - 1 AS k FROM placed WHERE n > 0),
beta AS (
    SELECT host, k * m + bad AS a, k * (1 - m) + n - bad AS b FROM placed, k3),
bound AS (
    SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bad_bound FROM beta),
rules(rule, verdict, host, path) AS (
    VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
           ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'),
           ('net/fr/', 'block', 'net', '/fr/')),
ruled AS (
    SELECT j.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
    FROM judged j JOIN rules r
      ON (j.host = r.host OR ends_with(j.host, '.' || r.host)) AND starts_with(j.path, r.path)
    GROUP BY j.page_id)
SELECT j.page_id, j.host, j.path, r.rule,
       coalesce(r.verdict, CASE WHEN b.bad_bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(b.bad_bound, 6) AS bad_bound
FROM judged j JOIN bound b ON b.host = j.host LEFT JOIN ruled r ON r.page_id = j.page_id
"""

SQL["op9_embedding_dedup"] = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(vec_id, r) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT reach.vec_id, l.y FROM reach JOIN links l ON l.x = reach.r)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) n ON n.x = e.vec_id
JOIN (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id) c ON c.vec_id = e.vec_id
"""
