"""The same queries as plain SQL for DuckDB, written from the definitions and not from the Spark code.

Clusters are found here by comparing all pairs and following the links, similarity by full one-hot vectors.
"""

from __future__ import annotations

from checks.queries import TERM

# The indicators and the cards, in order.
_KPI_NAMES = [
    "Nombre total de fichiers dupliqués",
    "Nombre de groupes de duplication distincts",
    "Doublons exacts",
    "Quasi-doublons",
    "Espace total gaspillé (MB)",
    "Nombre de dépôts impactés",
    "Nombre d'unités métier impactées",
]
_CARD_LABELS = ["Fichiers dupliqués", "Groupes distincts", "Espace gaspillé", "Dépôts impactés", "Unités métier"]

_AS_OF = "TIMESTAMP '2025-01-01 00:00:00'"
_MOMENT = "strftime((TIMESTAMP '2023-01-01 00:00:00' + to_hours(CAST({} AS INTEGER))), '%Y-%m-%d %H:%M:%S')"
_CREATED = _MOMENT.format("(doc_id*37)%8760")
_MODIFIED = _MOMENT.format("(doc_id*37)%8760 + CASE WHEN doc_id%47=11 THEN -24 ELSE (doc_id%90)*24 END")
_BLANK = r"[\s\p{Z}\x1c-\x1f\x{85}]+"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_BLANK}|{_BLANK}$', '', 'g')"


def _label(size: str) -> str:
    return f"regexp_replace(CAST(CAST(round_even({size}/1048576.0, 2) AS DECIMAL(24,2)) AS VARCHAR), '0$', '') || ' MB'"


def _days(moment: str) -> str:
    return f"CAST(floor((epoch_us({_AS_OF}) - epoch_us({moment}))/86400000000.0) AS BIGINT)"


_SIZE_CLASS = "CASE WHEN size_bytes < 1000000 THEN 'Petit' WHEN size_bytes < 100000000 THEN 'Moyen' ELSE 'Grand' END"
_DEPTH = "CAST(len(list_filter(string_split({}, '/'), lambda x: x <> '')) AS BIGINT)"
_SEGMENT = "coalesce(list_filter(string_split(path, '/'), lambda x: x <> '')[{}], 'Inconnu')"

_FIXTURE = f"""
d AS (
 SELECT doc_id, source, lang, text,
  CASE WHEN doc_id%97=5 THEN '___' ELSE concat('Rapport-', CAST(doc_id AS VARCHAR), ' v1') END AS base,
  CASE doc_id%12 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' WHEN 3 THEN '.TXT' WHEN 4 THEN '.txt'
   WHEN 5 THEN '.md' WHEN 6 THEN '.csv' WHEN 7 THEN '.tar.gz' WHEN 8 THEN '' WHEN 9 THEN '.pdf' WHEN 10 THEN '.docx'
   ELSE '.txt' END AS sfx,
  CASE doc_id%3 WHEN 0 THEN '' WHEN 1 THEN 'a/' ELSE 'a/b/' END AS sub
 FROM documents),
p AS (SELECT *, CASE WHEN doc_id%50=1 THEN concat('/', base, sfx)
   WHEN doc_id%41=2 THEN concat('/', source, '/', lang, '/node_modules/', base, sfx)
   ELSE concat('/', source, '/', lang, '/u', CAST(doc_id%7 AS VARCHAR), '/', sub, base, sfx) END AS p0 FROM d),
r AS (SELECT doc_id, concat(base, sfx) AS file_name,
  CASE WHEN doc_id%10=3 THEN replace(p0, '/', chr(92)) ELSE p0 END AS path,
  CAST(strlen(text) AS BIGINT)*8192 AS size_bytes,
  CASE doc_id%12 WHEN 7 THEN '.gz' ELSE sfx END AS extension,
  CASE WHEN doc_id%61=7 THEN NULL ELSE md5(text) END AS content_md5,
  CASE WHEN doc_id%53=9 THEN '2023-02-30 00:00:00' ELSE {_CREATED} END AS created_at_raw,
  {_MODIFIED} AS modified_at_raw
 FROM p),
everything AS (SELECT doc_id*2 AS seq, * FROM r UNION ALL SELECT doc_id*2+1, * FROM r WHERE doc_id%29=4),
raw AS (SELECT * FROM everything WHERE NOT regexp_matches(
  regexp_replace(replace(path, chr(92), '/'), '[^/]*$', ''),
  'AppData|Program Files|Windows|\\.git|__pycache__|node_modules|\\.venv'))
"""

_CLEAN = rf"""
filled AS (SELECT * FROM raw WHERE file_name IS NOT NULL AND path IS NOT NULL AND size_bytes IS NOT NULL
  AND content_md5 IS NOT NULL AND created_at_raw IS NOT NULL AND modified_at_raw IS NOT NULL
  AND {_strip('extension')} <> ''),
dated AS (SELECT seq, {_strip('lower(file_name)')} AS file_name, {_strip('lower(extension)')} AS extension,
  replace(path, chr(92), '/') AS path, size_bytes, content_md5,
  TRY_CAST(created_at_raw AS TIMESTAMP) AS created_at, TRY_CAST(modified_at_raw AS TIMESTAMP) AS modified_at
 FROM filled),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) AS place FROM dated
  WHERE created_at <= modified_at) WHERE place = 1),
named AS (SELECT *, regexp_replace(regexp_replace(file_name, '\.[^.]*$', '', 's'), '[^a-zA-Z0-9]', '', 'g') AS name_key,
  regexp_replace(path, '/?[^/]*$', '') AS parent_dir FROM once),
cleaned AS (SELECT name_key, path, parent_dir, {_DEPTH.format('parent_dir')} AS dir_depth, size_bytes,
  {_label('size_bytes')} AS size_label, {_SIZE_CLASS} AS size_class, extension, content_md5, created_at, modified_at,
  {_days('created_at')} AS age_days, {_days('modified_at')} AS idle_days
 FROM named WHERE name_key <> '')
"""

_EXACT = """
counted AS (SELECT *, count(*) OVER (PARTITION BY content_md5, size_bytes) AS n_copies,
  row_number() OVER (PARTITION BY content_md5, size_bytes ORDER BY created_at, path) AS place FROM cleaned),
groups AS (SELECT content_md5, size_bytes, n_copies,
  row_number() OVER (ORDER BY content_md5, size_bytes) - 1 AS exact_group_id
 FROM (SELECT content_md5, size_bytes, count(*) AS n_copies FROM cleaned GROUP BY ALL HAVING count(*) > 1)),
exact AS (SELECT c.* EXCLUDE (n_copies, place), c.n_copies, c.n_copies > 1 AS is_exact_dup, place AS copy_rank,
  coalesce(exact_group_id, -1) AS exact_group_id,
  CASE WHEN c.n_copies = 1 THEN 'Unique' WHEN place = 1 THEN 'Original'
   ELSE 'Doublon #' || CAST(place - 1 AS VARCHAR) END AS dup_status
 FROM counted c LEFT JOIN groups USING (content_md5, size_bytes))
"""

_SCORES = """
candidates AS (SELECT * FROM exact WHERE dup_status IN ('Unique', 'Original')),
moments AS (SELECT count(*) AS n, avg(size_bytes) AS m1, stddev_pop(size_bytes) AS s1, avg(dir_depth) AS m2,
  stddev_pop(dir_depth) AS s2, avg(age_days) AS m3, stddev_pop(age_days) AS s3, avg(idle_days) AS m4,
  stddev_pop(idle_days) AS s4 FROM candidates),
ext AS (SELECT extension AS v, count(*)::BIGINT AS n, count(*) / (SELECT n FROM moments) AS p FROM candidates GROUP BY 1),
cls AS (SELECT size_class AS v, count(*)::BIGINT AS n, count(*) / (SELECT n FROM moments) AS p FROM candidates GROUP BY 1),
scored AS (SELECT path, extension, size_class, (size_bytes - m1)/s1 AS z1, (dir_depth - m2)/s2 AS z2,
  (age_days - m3)/s3 AS z3, (idle_days - m4)/s4 AS z4 FROM candidates, moments),
ext_vectors AS (SELECT e.v, list((CASE WHEN f.v = e.v THEN 1 - f.p ELSE -f.p END)/sqrt(f.p*(1-f.p)) ORDER BY f.v) AS x
  FROM ext e, ext f GROUP BY 1),
cls_vectors AS (SELECT e.v, list((CASE WHEN f.v = e.v THEN 1 - f.p ELSE -f.p END)/sqrt(f.p*(1-f.p)) ORDER BY f.v) AS x
  FROM cls e, cls f GROUP BY 1),
vectors AS (SELECT path, s.extension, s.size_class, z1, z2, z3, z4,
  list_concat(list_concat([z1, z2, z3, z4], e.x), c.x) AS x
  FROM scored s JOIN ext_vectors e ON e.v = s.extension JOIN cls_vectors c ON c.v = s.size_class)
"""


def _clusters(eps: float, min_samples: int) -> str:
    return f"""
neighbours AS MATERIALIZED (SELECT a.path AS a, b.path AS b FROM vectors a, vectors b
  WHERE list_distance(a.x, b.x) <= {eps}),
core AS MATERIALIZED (SELECT a AS path FROM neighbours GROUP BY 1 HAVING count(*) >= {min_samples}),
links AS MATERIALIZED (SELECT a, b FROM neighbours WHERE a <> b AND a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT path, path AS root FROM core UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.path),
rooted AS MATERIALIZED (SELECT path, min(root) AS root FROM reach GROUP BY 1),
core_labels AS (SELECT path, dense_rank() OVER (ORDER BY root) - 1 AS cluster_id FROM rooted),
member AS MATERIALIZED (SELECT path, cluster_id FROM core_labels
  UNION ALL SELECT n.a, min(l.cluster_id) FROM neighbours n JOIN core_labels l ON l.path = n.b
  WHERE n.a NOT IN (FROM core) GROUP BY 1),
sizes AS (SELECT cluster_id, count(*) AS cluster_size FROM member GROUP BY 1),
mean_scores AS (SELECT a.path, round_even(avg(list_cosine_similarity(va.x, vb.x)), 4) AS similarity
  FROM member a JOIN member b ON a.cluster_id = b.cluster_id AND a.path <> b.path
  JOIN vectors va ON va.path = a.path JOIN vectors vb ON vb.path = b.path GROUP BY 1),
near AS (SELECT c.*, coalesce(m.cluster_id, -1) AS cluster_id,
  CASE WHEN m.cluster_id IS NULL THEN 'Isolé' ELSE 'Cluster #' || CAST(m.cluster_id AS VARCHAR) END AS cluster_status,
  coalesce(cluster_size, 1) AS cluster_size, similarity
 FROM candidates c LEFT JOIN member m USING (path) LEFT JOIN sizes USING (cluster_id) LEFT JOIN mean_scores USING (path))
"""


_COMBINED = f"""
combined AS (SELECT *, {_SEGMENT.format(1)} AS depot, {_SEGMENT.format(2)} AS unit, {_SEGMENT.format(3)} AS owner FROM (
  SELECT name_key, path, parent_dir, size_bytes, extension, 'Exact' AS dup_type,
   'EXACT_' || CAST(exact_group_id AS VARCHAR) AS group_key FROM exact WHERE is_exact_dup
  UNION ALL SELECT name_key, path, parent_dir, size_bytes, extension, 'Quasi',
   'QUASI_' || CAST(cluster_id AS VARCHAR) FROM near WHERE cluster_id <> -1)),
all_spots AS (SELECT row_number() OVER (ORDER BY total_bytes DESC, depot, unit) AS rank, * FROM (
  SELECT depot, unit, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM combined GROUP BY ALL)),
spots AS (SELECT * FROM all_spots ORDER BY rank LIMIT 20),
hotspots AS (SELECT *, {_label('total_bytes')} AS total_label FROM spots),
indicators AS (SELECT
  CAST(count(*) AS DOUBLE) AS k1, CAST(count(DISTINCT group_key) AS DOUBLE) AS k2,
  CAST(count(*) FILTER (dup_type = 'Exact') AS DOUBLE) AS k3,
  CAST(count(*) FILTER (dup_type = 'Quasi') AS DOUBLE) AS k4,
  coalesce(round_even(sum(size_bytes)/1048576.0, 2), 0.0) AS k5,
  CAST(count(DISTINCT depot) AS DOUBLE) AS k6, CAST(count(DISTINCT unit) AS DOUBLE) AS k7 FROM combined)
"""

_TO_CLEAN = [_FIXTURE, _CLEAN]
_TO_EXACT = [*_TO_CLEAN, _EXACT]
_TO_SCORES = [*_TO_EXACT, _SCORES]
_TO_NEAR = [*_TO_SCORES, _clusters(1.5, 2)]
_TO_COMBINED = [*_TO_NEAR, _COMBINED]

_MEASURES = f"""count(*) AS n_files, count(DISTINCT group_key) AS n_groups, CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
 count(*) FILTER (dup_type = 'Exact') AS n_exact, count(*) FILTER (dup_type = 'Quasi') AS n_near,
 {_label('sum(size_bytes)')} AS total_label"""
_SCORE = "CASE WHEN similarity IS NULL THEN '—' ELSE printf('%.3f', similarity) END"
_SHARED = "path, size_label"
_IN_FACETS = f"{_SEGMENT.format(1)} = 'src1' AND {_SEGMENT.format(2)} = 'en'"
_PICKED = f"regexp_matches(lower(name_key), '{TERM.lower()}') OR regexp_matches(lower(path), '{TERM.lower()}')"


def _spaced(number: str) -> str:
    return f"replace(format('{{:,}}', CAST({number} AS BIGINT)), ',', ' ')"


def _breakdown(dimension: str) -> str:
    return f"SELECT {dimension}, {_MEASURES} FROM combined GROUP BY 1"


def _quoted(name: str) -> str:
    return '"' + name + '"'


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _long_kpis() -> str:
    rows = [f"SELECT {_text(name)} AS metric, k{i} AS value FROM indicators" for i, name in enumerate(_KPI_NAMES, 1)]
    return " UNION ALL ".join(rows)


def _cards() -> str:
    cards = zip(_CARD_LABELS, ("k1", "k2", "k5", "k6", "k7"), strict=True)
    rows = [
        f"SELECT CAST({i} AS BIGINT) AS card, {_text(label)} AS label, "
        + (_spaced(f"round_even({k}, 0)") if i < 4 else f"format('{{:,}}', CAST({k} AS BIGINT))")
        + " AS shown FROM indicators"
        for i, (label, k) in enumerate(cards, 1)
    ]
    return " UNION ALL ".join(rows)


_SIDE = 1.5 / 2 * (1 - 1e-9)
_CELLED = f"""celled AS (SELECT *, {', '.join(f'CAST(floor(z{k}/{_SIDE!r}) AS BIGINT) AS c{k}' for k in (1, 2, 3, 4))} FROM vectors)"""
_LINKED_COLUMNS = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in ("extension", "size_class", "c1", "c2", "c3", "c4"))

_FILES = "SELECT parse_filename(filename) AS file_name, size AS size_bytes, '.parquet' AS extension, md5(content) AS content_md5 FROM read_blob('/root/testdata/sf0.01/*')"

_UPLOADS = """
sent AS (SELECT doc_id AS seq, source || '/' || CASE WHEN doc_id%19 < 2 THEN 'node_modules' ELSE lang END || '/f' || CAST(doc_id // 2 AS VARCHAR) || '.txt' AS path,
  doc_id%7 <> 3 AS has_data, doc_id%11=4 OR doc_id%13=5 OR doc_id%17 <> 6 AS whole FROM documents)"""
_PAYLOAD = """
uploads AS (SELECT doc_id AS seq, source || '/' || CASE WHEN doc_id%19 < 2 THEN 'node_modules' ELSE lang END || '/f' || CAST(doc_id // 2 AS VARCHAR) || '.txt' AS path,
  CASE WHEN doc_id%11=4 THEN 'ABC' ELSE text END AS content
 FROM documents WHERE doc_id%7 <> 3 AND (doc_id%11=4 OR doc_id%13=5 OR doc_id%17 <> 6)),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS place FROM uploads)
  WHERE place = 1 AND NOT contains(path, 'node_modules/'))"""


def _report(name: str, columns: str, rows: str, filters: str) -> str:
    return f"SELECT {columns}, name_key AS file_name, {_SHARED}, {_text(filters)} AS filters FROM {name} WHERE {rows}"


_EXACT_REPORT = "dup_status AS status, strftime(created_at, '%Y-%m-%d') AS created"
_NEAR_REPORT = f"cluster_status AS cluster, {_SCORE} AS score"
_FR_FILTERS, _EN_FILTERS = "Dépôt: src1 · Unité: en", "Repository: src1 · Unit: en"

_EXACT_LINES = (
    "SELECT dup_status AS status, name_key AS file, path, size_label AS size,"
    " strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created, exact_group_id, copy_rank"
)
_NEAR_LINES = (
    f"SELECT cluster_status AS cluster, name_key AS file, path, size_label AS size, {_SCORE} AS score, cluster_id"
)

# key -> (tables it builds on, query)
_QUERIES: dict[str, tuple[list[str], str]] = {
    "scan_inventory": ([], _FILES),
    "scan_source": ([], _FILES),
    "scan_exclusions": ([_FIXTURE], "SELECT seq, path FROM raw"),
    "scan_metadata": (
        [_FIXTURE],
        f"SELECT concat(base, sfx) AS file_name, p0 AS path, CAST(strlen(text) AS BIGINT)*8192 AS size_bytes,"
        f" CASE WHEN sfx = '.tar.gz' THEN '.gz' ELSE sfx END AS extension, md5(text) AS content_md5,"
        f" CASE WHEN doc_id%53=9 THEN '2023-02-30 00:00:00' ELSE {_CREATED} END AS created_at_raw,"
        f" {_MODIFIED} AS modified_at_raw FROM p",
    ),
    "content_md5": ([], "SELECT doc_id, md5(text) AS content_md5 FROM documents"),
    "payload_inventory": (
        [_PAYLOAD],
        "SELECT seq, string_split(path, '/')[-1] AS file_name, path, CAST(strlen(content) AS BIGINT) AS size_bytes,"
        " '.txt' AS extension, md5(content) AS content_md5, '2025-01-01 00:00:00' AS created_at_raw,"
        " '2025-01-01 00:00:00' AS modified_at_raw FROM latest",
    ),
    "payload_accepted": (
        [_PAYLOAD],
        "SELECT seq, string_split(path, '/')[-1] AS file_name, path, CAST(strlen(content) AS BIGINT) AS size_bytes,"
        " '.txt' AS extension, md5(content) AS content_md5, '2025-01-01 00:00:00' AS created_at_raw,"
        " '2025-01-01 00:00:00' AS modified_at_raw FROM latest",
    ),
    "payload_rejects": (
        [_UPLOADS],
        "SELECT * FROM (SELECT seq, path, CASE WHEN contains(path, 'node_modules/') THEN 'excluded directory'"
        " WHEN NOT has_data THEN 'no data' WHEN NOT whole THEN 'not decodable'"
        " WHEN seq < max(CASE WHEN has_data AND whole THEN seq END) OVER (PARTITION BY path)"
        " THEN 'replaced by a later upload' END AS reason FROM sent) WHERE reason IS NOT NULL",
    ),
    "stage_roundtrip": (_TO_CLEAN, "SELECT * FROM cleaned"),
    "kpi_long": (_TO_COMBINED, _long_kpis()),
    "report_exact": (_TO_EXACT, _report("exact", _EXACT_REPORT, "is_exact_dup", _FR_FILTERS)),
    "report_near": (_TO_NEAR, _report("near", _NEAR_REPORT, "cluster_id <> -1", _EN_FILTERS)),
    "report_exact_filtered": (
        _TO_EXACT,
        _report("exact", _EXACT_REPORT, f"is_exact_dup AND {_IN_FACETS}", _FR_FILTERS),
    ),
    "report_near_filtered": (
        _TO_NEAR,
        _report("near", _NEAR_REPORT, f"cluster_id <> -1 AND {_IN_FACETS}", _FR_FILTERS),
    ),
    "clean_required": (_TO_CLEAN, "SELECT seq, path, extension, content_md5 FROM filled"),
    "clean_names": (
        [_FIXTURE],
        f"SELECT seq, {_strip('lower(file_name)')} AS file_name, {_strip('lower(extension)')} AS extension FROM raw",
    ),
    "clean_paths": ([_FIXTURE], "SELECT seq, replace(path, chr(92), '/') AS path FROM raw"),
    "clean_dates": (
        [_FIXTURE],
        "SELECT seq, TRY_CAST(created_at_raw AS TIMESTAMP) AS created_at,"
        " TRY_CAST(modified_at_raw AS TIMESTAMP) AS modified_at FROM raw"
        " WHERE TRY_CAST(created_at_raw AS TIMESTAMP) <= TRY_CAST(modified_at_raw AS TIMESTAMP)",
    ),
    "clean_distinct_path": (
        [_FIXTURE],
        "SELECT min(seq) AS seq, replace(path, chr(92), '/') AS path FROM raw GROUP BY 2",
    ),
    "clean_name_key": (
        [_FIXTURE],
        r"SELECT * FROM (SELECT seq, regexp_replace(regexp_replace(lower(file_name), '\.[^.]*$', ''), '[^a-z0-9]', '', 'g')"
        " AS name_key FROM raw) WHERE name_key <> ''",
    ),
    "derive_dir": (
        [_FIXTURE],
        f"SELECT *, {_DEPTH.format('parent_dir')} AS dir_depth FROM (SELECT seq, replace(path, chr(92), '/') AS path,"
        " regexp_replace(replace(path, chr(92), '/'), '/?[^/]*$', '') AS parent_dir FROM raw)",
    ),
    "derive_size_class": ([_FIXTURE], f"SELECT seq, size_bytes, {_SIZE_CLASS} AS size_class FROM raw"),
    "derive_age": (
        [_FIXTURE],
        f"SELECT seq, {_days('c')} AS age_days, {_days('m')} AS idle_days FROM (SELECT seq,"
        " TRY_CAST(created_at_raw AS TIMESTAMP) AS c, TRY_CAST(modified_at_raw AS TIMESTAMP) AS m FROM raw) WHERE c <= m",
    ),
    "derive_size_label": ([_FIXTURE], f"SELECT seq, size_bytes, {_label('size_bytes')} AS size_label FROM raw"),
    "clean_inventory": (_TO_CLEAN, "SELECT * FROM cleaned"),
    "exact_group_counts": (
        _TO_CLEAN,
        "SELECT content_md5, size_bytes, count(*) AS n_copies FROM cleaned GROUP BY ALL",
    ),
    "exact_flags": (_TO_EXACT, "SELECT path, n_copies, is_exact_dup FROM exact"),
    "exact_rank": (_TO_EXACT, "SELECT path, copy_rank FROM exact WHERE is_exact_dup"),
    "exact_group_ids": (_TO_EXACT, "SELECT * FROM groups"),
    "exact_status": (_TO_EXACT, "SELECT path, copy_rank, exact_group_id, dup_status FROM exact"),
    "exact_duplicates": (_TO_EXACT, "SELECT * FROM exact"),
    "near_candidates": (_TO_SCORES, "SELECT path, dup_status FROM candidates"),
    "near_category_stats": (
        _TO_SCORES,
        "SELECT feature, v AS value, n, round(p, 9) AS p, round(1/(p*(1-p)), 9) AS penalty, round(norm, 9) AS norm FROM ("
        " SELECT 'extension' AS feature, v, n, p, list_dot_product(x, x) AS norm FROM ext JOIN ext_vectors USING (v)"
        " UNION ALL SELECT 'size_class', v, n, p, list_dot_product(x, x) FROM cls JOIN cls_vectors USING (v))",
    ),
    "near_features": (
        _TO_SCORES,
        "SELECT path, extension, size_class, CAST(size_bytes AS DOUBLE) AS size_bytes, CAST(dir_depth AS DOUBLE)"
        " AS dir_depth, CAST(age_days AS DOUBLE) AS age_days, CAST(idle_days AS DOUBLE) AS idle_days FROM candidates",
    ),
    "near_zscores": (
        _TO_SCORES,
        "SELECT path, round(z1, 6) AS z1, round(z2, 6) AS z2, round(z3, 6) AS z3, round(z4, 6) AS z4 FROM scored",
    ),
    "near_cell_links": (
        [*_TO_SCORES, _CELLED],
        f"SELECT DISTINCT {_LINKED_COLUMNS} FROM celled a JOIN celled b USING (extension, size_class)"
        " WHERE (a.c1, a.c2, a.c3, a.c4) < (b.c1, b.c2, b.c3, b.c4)"
        f" AND list_distance(a.x, b.x) <= 1.5",
    ),
    "near_clusters": (_TO_NEAR, "SELECT path, cluster_id, cluster_status FROM near"),
    "near_cluster_sizes": (_TO_NEAR, "SELECT cluster_id, cluster_size FROM sizes"),
    "near_similarity": (_TO_NEAR, "SELECT path, similarity FROM near"),
    "near_duplicates": (_TO_NEAR, "SELECT * FROM near"),
    "near_min5": (
        [*_TO_SCORES, _clusters(1.5, 5)],
        "SELECT path, cluster_id, cluster_size, similarity FROM near",
    ),
    "near_wide_eps": (
        [*_TO_SCORES, _clusters(3.5, 2)],
        "SELECT path, cluster_id, cluster_size, similarity FROM near",
    ),
    "combined_duplicates": (_TO_COMBINED, "SELECT * FROM combined"),
    "path_dimensions": (
        _TO_CLEAN,
        f"SELECT path, {_SEGMENT.format(1)} AS depot, {_SEGMENT.format(2)} AS unit, {_SEGMENT.format(3)} AS owner"
        " FROM cleaned",
    ),
    "hotspots_top20": (_TO_COMBINED, "SELECT * FROM hotspots"),
    "hotspots_all": (_TO_COMBINED, f"SELECT *, {_label('total_bytes')} AS total_label FROM all_spots"),
    "kpis": (
        _TO_COMBINED,
        "SELECT " + ", ".join(f"k{i} AS {_quoted(name)}" for i, name in enumerate(_KPI_NAMES, 1)) + " FROM indicators",
    ),
    **{f"breakdown_{name}": (_TO_COMBINED, _breakdown(name)) for name in ("depot", "unit", "extension", "owner")},
    "breakdown_all": (
        _TO_COMBINED,
        " UNION ALL ".join(
            f"SELECT '{name}' AS dimension, {name} AS value, {_MEASURES} FROM combined GROUP BY {name}"
            for name in ("depot", "unit", "extension", "owner")
        ),
    ),
    "stage_counts": (
        _TO_COMBINED,
        "SELECT 'indexed_files' AS counter, count(*) AS n FROM raw UNION ALL SELECT 'valid_files', count(*) FROM cleaned"
        " UNION ALL SELECT 'exact_duplicate_files', count(*) FILTER (is_exact_dup) FROM exact"
        " UNION ALL SELECT 'clustered_files', count(*) FROM member UNION ALL SELECT 'clusters', count(*) FROM sizes"
        " UNION ALL SELECT 'combined_files', count(*) FROM combined",
    ),
    "facet_filter": (
        _TO_COMBINED,
        "SELECT * FROM combined WHERE depot = 'src1' AND unit = 'en' AND dup_type = 'Quasi'",
    ),
    "facet_options": (
        _TO_COMBINED,
        "SELECT DISTINCT 'depot' AS facet, depot AS value FROM combined UNION ALL SELECT DISTINCT 'unit', unit FROM combined",
    ),
    "space_by_unit_top10": (
        _TO_COMBINED,
        "SELECT unit, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, sum(size_bytes)/1048576.0 AS mb FROM combined"
        " GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    "space_share_by_depot": (
        _TO_COMBINED,
        "SELECT depot, CAST(sum(size_bytes) AS BIGINT) AS total_bytes,"
        " CAST(sum(size_bytes) AS DOUBLE)/(SELECT sum(size_bytes) FROM combined) AS share FROM combined GROUP BY 1",
    ),
    "files_by_extension_top8": (
        _TO_COMBINED,
        "SELECT extension, count(*) AS n_files FROM combined GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
    ),
    "rows_by_type": (
        _TO_COMBINED,
        "SELECT dup_type, count(*) AS n_files, count(*)/(SELECT count(*) FROM combined) AS share,"
        " CASE dup_type WHEN 'Exact' THEN 'Exact' ELSE 'Near' END AS label FROM combined GROUP BY 1",
    ),
    "hotspot_listing": (
        _TO_COMBINED,
        f"SELECT rank, depot, unit, {_spaced('n_files')} AS n_files_label, total_label FROM hotspots",
    ),
    "exact_listing": (
        _TO_EXACT,
        f"{_EXACT_LINES} FROM exact WHERE is_exact_dup AND contains(path, 'src1')",
    ),
    "exact_listing_page": (
        _TO_EXACT,
        f"{_EXACT_LINES} FROM exact WHERE is_exact_dup AND contains(path, 'src1') AND (exact_group_id, copy_rank) > (2, 1)"
        " ORDER BY exact_group_id, copy_rank LIMIT 10",
    ),
    "near_listing": (
        _TO_NEAR,
        f"{_NEAR_LINES} FROM near WHERE cluster_id <> -1 AND contains(path, 'src')",
    ),
    "near_listing_page": (
        _TO_NEAR,
        f"{_NEAR_LINES} FROM (SELECT * FROM near WHERE cluster_id <> -1 AND contains(path, 'src')"
        " AND (cluster_id, path) > (0, '/src1') ORDER BY cluster_id, path LIMIT 100)",
    ),
    "exact_numbered_page": (
        _TO_EXACT,
        f"{_EXACT_LINES}, position FROM (SELECT *, row_number() OVER (ORDER BY exact_group_id, copy_rank) - 1 AS position"
        " FROM exact WHERE is_exact_dup) WHERE position BETWEEN 75 AND 99",
    ),
    "near_selected_page": (
        _TO_NEAR,
        f"{_NEAR_LINES}, position FROM (SELECT *, row_number() OVER (ORDER BY cluster_id, path) - 1 AS position"
        " FROM near WHERE cluster_id <> -1) WHERE position >= 30 AND contains(path, 'src1') ORDER BY position LIMIT 40",
    ),
    "listing_counts": (
        _TO_NEAR,
        f"SELECT listing, n, {_spaced('n')} AS shown FROM ("
        f" SELECT 'exact' AS listing, count(*) AS n FROM exact WHERE is_exact_dup AND contains(path, 'src1') AND ({_PICKED})"
        f" UNION ALL SELECT 'near', count(*) FROM near WHERE cluster_id <> -1 AND contains(path, 'src1') AND ({_PICKED}))",
    ),
    "search_exact": (_TO_EXACT, f"SELECT path, name_key FROM exact WHERE is_exact_dup AND ({_PICKED})"),
    "search_near": (
        _TO_NEAR,
        "SELECT path, name_key FROM near WHERE cluster_id <> -1 AND (contains(name_key, '7v1') OR contains(lower(path), '7v1'))",
    ),
    "kpi_cards": (_TO_COMBINED, _cards()),
}


# Other ways to results that are defined above.
_QUERIES |= {
    "exact_next_scan": _QUERIES["exact_duplicates"],
    "search_exact_indexed": _QUERIES["search_exact"],
    "search_near_indexed": _QUERIES["search_near"],
    "cell_breakdowns": _QUERIES["breakdown_all"],
    "cell_kpis": _QUERIES["kpis"],
    "observed_counts": _QUERIES["stage_counts"],
    "cell_breakdown_selected": (
        _TO_COMBINED,
        f"SELECT extension, {_MEASURES} FROM combined WHERE depot = 'src1' AND unit = 'en' GROUP BY extension",
    ),
    "approximate_groups": (
        _TO_COMBINED,
        f"SELECT unit, n_groups, TRUE AS within_bound FROM (SELECT unit, {_MEASURES} FROM combined GROUP BY unit)",
    ),
    "run_history": (
        _TO_COMBINED,
        f"SELECT h.*, {_label('total_bytes')} AS total_label, run_id FROM all_spots AS h, (SELECT unnest(['monday', 'tuesday']) AS run_id)",
    ),
    "near_single": (
        _TO_EXACT,
        "SELECT path, CAST(-1 AS BIGINT) AS cluster_id, 'Isolé' AS cluster_status, CAST(1 AS BIGINT) AS cluster_size,"
        " CAST(NULL AS DOUBLE) AS similarity FROM exact WHERE dup_status IN ('Unique', 'Original') ORDER BY size_bytes DESC, path LIMIT 1",
    ),
}


def all_sql() -> dict[str, str]:
    out = {}
    for key, (tables, query) in _QUERIES.items():
        out[key] = f"WITH RECURSIVE {','.join(tables)}\n{query}" if tables else query
    return out
