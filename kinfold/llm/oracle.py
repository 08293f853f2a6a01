"""SQL for DuckDB with the same results, written from the definitions."""

from __future__ import annotations

_SPACE_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

DECONTAMINATION = rf"""
WITH
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM g),
p AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
      FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT DISTINCT p.doc_id, p.i, p.size, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.size = g.size),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit
          FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS k FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
 CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

URL_REPUTATION = rf"""
WITH
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_ASCII}) AS host,
       regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
h AS (SELECT host, count(l.doc_id) AS n,
       coalesce(sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) FILTER (WHERE l.doc_id IS NOT NULL), 0) AS bad,
       regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS name
      FROM p LEFT JOIN labels l ON l.doc_id = p.page_id GROUP BY host),
s0 AS (SELECT *, string_split(name, '.') AS parts FROM h),
s1 AS (SELECT host, n, bad, name, array_to_string(parts[greatest(len(parts) - 1, 1):], '.') AS two,
        array_to_string(parts[greatest(len(parts) - 2, 1):], '.') AS three, parts[len(parts)] AS one FROM s0),
s2 AS (SELECT host, n, bad,
  CASE WHEN regexp_matches(name, '^[\d.]+$') THEN name WHEN two IN (SELECT unnest(shared)) THEN three ELSE two END AS domain,
  CASE WHEN regexp_matches(name, '^[\d.]+$') THEN '' WHEN two IN (SELECT unnest(shared)) THEN two ELSE one END AS suffix
  FROM s1, (SELECT ['ac.uk','co.jp','co.nz','co.uk','com.au','com.br','com.cn','gov.uk','org.au','org.uk'] AS shared)),
o AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0.0 END AS overall FROM s2),
sf AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(overall) AS prior, any_value(overall) AS overall FROM s2, o GROUP BY suffix),
ks AS (SELECT (sum(n * (bad / n - prior) ** 2) - sum(overall * (1 - overall))) / sum(n) AS x, any_value(overall) AS o FROM sf WHERE n > 0),
ks2 AS (SELECT CASE WHEN x IS NULL OR x <= 0 THEN 200.0 ELSE least(greatest(o * (1 - o) / x - 1, 2.0), 200.0) END AS k FROM ks),
sm AS (SELECT suffix, (bad + prior * k) / (n + k) AS mean FROM sf, ks2),
dm AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM s2 GROUP BY domain, suffix),
dp AS (SELECT dm.*, sm.mean AS prior, overall FROM dm JOIN sm USING (suffix), o),
kd AS (SELECT (sum(n * (bad / n - prior) ** 2) - sum(overall * (1 - overall))) / sum(n) AS x, any_value(overall) AS o FROM dp WHERE n > 0),
kd2 AS (SELECT CASE WHEN x IS NULL OR x <= 0 THEN 200.0 ELSE least(greatest(o * (1 - o) / x - 1, 2.0), 200.0) END AS k FROM kd),
dmean AS (SELECT domain, (bad + prior * k) / (n + k) AS mean FROM dp, kd2),
hp AS (SELECT host, n, bad, mean AS prior, overall FROM s2 JOIN dmean USING (domain), o),
kh AS (SELECT (sum(n * (bad / n - prior) ** 2) - sum(overall * (1 - overall))) / sum(n) AS x, any_value(overall) AS o FROM hp WHERE n > 0),
kh2 AS (SELECT CASE WHEN x IS NULL OR x <= 0 THEN 200.0 ELSE least(greatest(o * (1 - o) / x - 1, 2.0), 200.0) END AS k FROM kh),
hm AS (SELECT host, (bad + prior * k) / (n + k) AS mean, n + k AS weight FROM hp, kh2),
low AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) AS low FROM hm),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
  ('allow', 'org', '/fr/')) AS t(verdict, rule_host, rule_path)),
fit AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
        FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY page_id)
SELECT p.page_id, p.host, p.path, fit.rule,
 coalesce(fit.verdict, CASE WHEN low.low > 0.3 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (page_id) LEFT JOIN low USING (host)
"""


NEAR_COPIES = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN generate_series(1, len(w) - 4)]) END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS node, a AS reached FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT node, min(reached) AS root FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(root, s.doc_id) AS component_id,
 coalesce(root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.node = s.doc_id
"""


SUFFIX_DEDUP = """
WITH
w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
      FROM (SELECT doc_id, h, unnest(generate_series(0, n - 50)) AS i FROM w WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS least FROM p GROUP BY s),
hit AS (SELECT doc_id, i FROM p JOIN m USING (s) WHERE least < doc_id),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + k AS place FROM (SELECT doc_id, i, unnest(generate_series(0, 49)) AS k FROM hit)),
spans AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < place - 1) AS n_spans
          FROM (SELECT doc_id, place, lag(place) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM gone) GROUP BY doc_id),
kept AS (SELECT b.doc_id, string_agg(x, '' ORDER BY b.place) AS h
         FROM (SELECT doc_id, place, substr(h, 2 * place + 1, 2) AS x
               FROM (SELECT doc_id, h, unnest(generate_series(0, n - 1)) AS place FROM w)) AS b
         ANTI JOIN gone ON gone.doc_id = b.doc_id AND gone.place = b.place GROUP BY b.doc_id)
SELECT w.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
 CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM w LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

DEBRUIJN_DEDUP = r"""
WITH
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS s
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM w WHERE len(w) >= 35)),
hit AS (SELECT doc_id, i FROM p WHERE s IN (SELECT s FROM p GROUP BY s HAVING count(*) > 1)),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + k AS place FROM (SELECT doc_id, i, unnest(generate_series(0, 34)) AS k FROM hit)),
removed AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
kept AS (SELECT b.doc_id, string_agg(x, ' ' ORDER BY b.place) AS t
         FROM (SELECT doc_id, place, w[place] AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS place FROM w)) AS b
         ANTI JOIN gone ON gone.doc_id = b.doc_id AND gone.place = b.place GROUP BY b.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
 sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


REVISITS = r"""
WITH
v AS (SELECT page_id, url, md5(html) AS tag, page_id % 365 AS day, k FROM pages, (SELECT unnest([0, 1, 2, 3]) AS k)),
c0 AS (SELECT page_id * 4 + k AS record_id,
  CASE WHEN k > 0 AND (page_id + k) % 2 = 0 THEN regexp_replace(url, '#.*$', '') || '#part' ELSE url END AS url,
  page_id * 10 + CASE WHEN k = 0 THEN 0 WHEN (page_id + k) % 13 = 0 THEN -5 ELSE k * 1000 END AS time,
  CASE WHEN k = 0 THEN 200 ELSE 304 END AS status,
  CASE WHEN k = 0 THEN '"' || tag || '"' WHEN (page_id + k) % 5 = 0 THEN '"old"' WHEN (page_id + k) % 7 = 0 THEN NULL
   ELSE 'W/"' || tag || '"' END AS etag,
  CASE WHEN k > 0 AND (page_id + k) % 7 = 0 THEN NULL ELSE 'day ' || day END AS modified FROM v),
c1 AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM c0),
c AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', '')
   || regexp_replace(regexp_extract(rest, '^[^/?]*(/[^?]*)?', 1), '/$', '')
   || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
         lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|session)='))) AS q FROM c1)),
f AS (SELECT r.record_id, max({'t': s.time, 'id': s.record_id}).id AS source_id
      FROM c AS r JOIN c AS s ON s.canonical = r.canonical AND s.time < r.time AND s.status = 200
      WHERE r.status = 304 GROUP BY r.record_id),
j AS (SELECT r.record_id, r.canonical, r.time, r.etag, r.modified, s.record_id AS source_id, s.etag AS s_etag, s.modified AS s_modified, s.time AS s_time
      FROM c AS r LEFT JOIN f USING (record_id) LEFT JOIN c AS s ON s.record_id = f.source_id WHERE r.status = 304),
o AS (SELECT *, CASE WHEN source_id IS NULL THEN 'orphan'
   WHEN coalesce(regexp_replace(etag, '^W/', '') <> s_etag, false) OR coalesce(modified <> s_modified, false) THEN 'changed'
   WHEN coalesce(regexp_replace(etag, '^W/', '') = s_etag, false) OR coalesce(modified = s_modified, false) THEN 'resolved'
   ELSE 'unchecked' END AS outcome FROM j)
SELECT record_id, canonical, source_id, outcome,
 CASE WHEN outcome IN ('resolved', 'unchecked') THEN 'content-type: text/html' || chr(10) || 'date: t' || time || chr(10)
  || 'etag: ' || coalesce(etag, s_etag) || chr(10) || 'last-modified: ' || coalesce(modified, s_modified) END AS headers
FROM o
"""


def _secret_sql(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, {number} AS k, '{kind}' AS kind,
  regexp_split_to_array(t, '{pattern}') AS gaps, [length(x) FOR x IN regexp_extract_all(t, '{pattern}', 0)] AS sizes,
  [length(x) >= {least} FOR x IN regexp_extract_all(t, '{pattern}', {group})] AS good
 FROM d WHERE regexp_matches(t, '{pattern}')"""


# Patterns as in the definition; quotes are doubled for SQL, and letters of either case are spelled out for RE2.
_ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_SECRETS = [
    (0, "assign", _ASSIGN, 2, 6),
    (1, "access", r"AKIA[A-Z0-9]+", 0, 20),
    (2, "hex", r"[0-9a-f]+", 0, 24),
    (3, "pem", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", 0, 1),
    (4, "jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
]
BLOB_LEDGER = f"""
WITH
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_secret_sql(*rule) for rule in _SECRETS)}),
e AS (SELECT doc_id, k, kind, sizes, good, [length(x) FOR x IN gaps] AS gaps, unnest(generate_series(1, len(sizes))) AS i FROM m),
f AS (SELECT doc_id, k, kind, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS BIGINT) AS b, sizes[i] AS n
      FROM e WHERE good[i]),
t AS (SELECT doc_id, k, b, kind || ':' || b || ':' || (b + n) AS s FROM f),
a AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
       string_agg(s, ',' ORDER BY b, k) FILTER (WHERE k < 3) AS base, string_agg(s, ',' ORDER BY b, k) AS spans FROM t GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
 CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""

DOCUMENT_FP_TREE = rf"""
WITH
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dn AS (SELECT doc_id, len(w) AS n, w FROM d WHERE len(w) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM dn),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_ASCII}),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM dn)
       WHERE term IN (SELECT term FROM b) GROUP BY doc_id, n, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
        * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM b JOIN tf USING (term) JOIN df USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


def all_sql() -> dict[str, str]:
    return {
        "op2_decontamination": DECONTAMINATION,
        "op3_url_reputation": URL_REPUTATION,
        "op4_circulant_minhash": NEAR_COPIES,
        "op5_revisits": REVISITS,
        "op6_suffix_dedup": SUFFIX_DEDUP,
        "op10_debruijn_dedup": DEBRUIJN_DEDUP,
        "op11_blob_ledger": BLOB_LEDGER,
        "op13_document_fp_tree": DOCUMENT_FP_TREE,
    }
