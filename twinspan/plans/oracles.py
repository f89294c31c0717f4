"""DuckDB SQL with the results of the core queries, written from the definitions, not from the operators."""

from __future__ import annotations

_HEX = "lpad(ltrim(regexp_replace(lower(trim({0}, ' ' || chr(9))), '^0x', ''), '0'), 16, '0')"
_SETS = f"""sets AS (SELECT entry_id, list_distinct(list_transform(list_filter(fp_set, lambda x: trim(coalesce(x, ''), ' ' || chr(9)) <> ''),
    lambda x: {_HEX.format("x")})) AS s FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY rev DESC) AS r FROM entries) WHERE r = 1),
    held AS (SELECT entry_id AS id, unnest(s) AS d FROM sets)"""
_WEIGHTS = """df AS (SELECT d, count(*) AS df, CAST(round(ln(1 + 1000.0 / count(*)) * 1e6) AS BIGINT) AS w FROM held GROUP BY d),
    weighted AS (SELECT id, d, df, w FROM held JOIN df USING (d)), total AS (SELECT id, CAST(sum(w) AS BIGINT) AS t, count(*) AS n FROM weighted GROUP BY id)"""
_PAIRS = """shared AS (SELECT x.id AS a, y.id AS b, CAST(sum(x.w) AS BIGINT) AS s FROM weighted x JOIN weighted y ON x.d = y.d AND x.id < y.id GROUP BY x.id, y.id),
    pairs AS (SELECT a, b, s AS shared_w, CAST(p.t + q.t - s AS BIGINT) AS union_w FROM shared JOIN total p ON p.id = a JOIN total q ON q.id = b)"""
_UNITS = f"""unit AS (SELECT entry_id, u.repo, unit_kind AS kind, unit_identity AS identity, unit_namespace AS namespace, file_path AS path, start_line, end_line, file_language AS language,
    CASE WHEN regexp_full_match(lower(trim(root_digest, ' ' || chr(9))), '(0x)?0*[0-9a-f]{{1,16}}') THEN {_HEX.format("root_digest")} END AS root_digest, node_count,
    coalesce(CASE WHEN v > 0 AND v <= 1 THEN CAST(v * 1000000 AS BIGINT) END, 800000) AS threshold, coalesce(min_lines, 4) AS min_lines, coalesce(min_nodes, 20) AS min_nodes
    FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY rev DESC) AS r FROM entries) u
    LEFT JOIN (SELECT *, TRY_CAST(trim(threshold) AS DECIMAL(18, 6)) AS v FROM repos) s USING (repo) WHERE r = 1)"""
_PLACES = f"""place AS (SELECT DISTINCT ON (loc_id) loc_id, entry_id, repo, file_path AS path, start_line, end_line, node_count AS size, is_whole AS whole,
    {_HEX.format("signature")} AS signature, ordinal_no AS ordinal, repo || '|' || loc_key AS key FROM locations)"""
_SCORE = """CASE WHEN score IS NULL OR trim(score) = '' THEN shared_w::DOUBLE / union_w WHEN contains(score, '/') THEN TRY_CAST(split_part(trim(score), '/', 1) AS DOUBLE) / TRY_CAST(split_part(trim(score), '/', 2) AS DOUBLE)
    WHEN suffix(trim(score), '%') THEN TRY_CAST(rtrim(trim(score), '%') AS DOUBLE) / 100 ELSE TRY_CAST(score AS DOUBLE) END"""
_EXISTING = f"""live AS (SELECT match_id, a, b, match_kind, coalesce({_SCORE}, 0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY rev DESC) AS r FROM matches)
    WHERE r = 1 AND NOT coalesce(withdrawn, false) AND a IS NOT NULL AND b IS NOT NULL AND a <> b)"""
_COMPONENTS = """edge AS (SELECT a AS u, b AS v FROM live UNION SELECT b, a FROM live),
    reach(id, seen) AS (SELECT u, u FROM edge UNION SELECT u, v FROM edge UNION SELECT reach.id, edge.v FROM reach JOIN edge ON edge.u = reach.seen),
    comp AS (SELECT id AS loc_id, min(seen) AS component FROM reach GROUP BY id)"""
_CLUSTERED = f"""placed AS (SELECT component, place.*, kind, namespace, identity, language, signature || '#' || ordinal AS structural FROM comp JOIN place USING (loc_id) LEFT JOIN unit USING (entry_id)),
    changed AS (SELECT DISTINCT file_path AS path, line_no AS f, line_no + 9 AS t FROM parse_errors WHERE file_path IS NOT NULL AND line_no IS NOT NULL),
    file AS (SELECT file_path AS path, len(string_split(content, chr(10))) AS n, epoch(date_trunc('second', committed_at))::DOUBLE AS ts FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rev DESC) AS r FROM source_files) WHERE r = 1 AND content IS NOT NULL),
    told AS (SELECT p.*, EXISTS (SELECT 1 FROM changed c WHERE c.path = p.path AND c.f <= p.end_line AND c.t >= p.start_line) AS touched,
    coalesce((SELECT max(ts) FROM file WHERE file.path = p.path AND n >= p.start_line AND p.end_line >= p.start_line), 0) AS newest FROM placed p),
    aged AS (SELECT *, CASE WHEN touched THEN 'inf'::DOUBLE ELSE newest END AS age FROM told)"""
_FINDINGS = f"WITH RECURSIVE {_EXISTING}, {_COMPONENTS}, {_PLACES}, {_UNITS}, {_CLUSTERED}"
_BASE = """bykey AS (SELECT DISTINCT repo || '|' || loc_key AS key, cluster_id AS cluster FROM base_clusters), bykey1 AS (SELECT key, min(cluster) AS cluster FROM bykey GROUP BY key),
    byshape AS (SELECT DISTINCT signature || '#' || ordinal AS structural, cluster FROM bykey JOIN place USING (key) WHERE signature IS NOT NULL),
    keyed AS (SELECT a.*, k.cluster, count(*) OVER (PARTITION BY component, k.cluster) AS peers FROM aged a LEFT JOIN bykey1 k USING (key)),
    one AS (SELECT component, bool_or(touched AND (cluster IS NULL OR peers < 2)) AS new, bool_or(touched) AS any_touched, count(*) AS n FROM keyed GROUP BY component),
    member AS (SELECT component, loc_id, cluster FROM keyed WHERE cluster IS NOT NULL UNION SELECT component, loc_id, s.cluster FROM aged JOIN byshape s USING (structural)),
    best AS (SELECT component, max(k) AS k FROM (SELECT component, cluster, count(*) AS k FROM member GROUP BY ALL) GROUP BY component),
    labelled AS (SELECT component, CASE WHEN any_touched THEN CASE WHEN new THEN 'introduced' ELSE 'already_there' END WHEN coalesce(k, 0) = n THEN 'already_there' ELSE 'shifted' END AS label FROM one LEFT JOIN best USING (component))"""
_ENDS = """ends AS (SELECT component, arg_min(loc_id, (age, path, start_line, end_line, loc_id)) AS o, arg_max(loc_id, (age, path, start_line, end_line, loc_id)) AS c FROM aged GROUP BY component),
    two AS (SELECT a, b, max(score) AS s FROM (SELECT a, b, score FROM live UNION ALL SELECT b, a, score FROM live) GROUP BY a, b)"""
_RANKED = f"""{_FINDINGS}, {_BASE}, {_ENDS}, paid AS (SELECT component, round(sum(size * coalesce(s, 0)), 1) AS payoff FROM aged JOIN ends USING (component) LEFT JOIN two ON a = loc_id AND b = CASE WHEN loc_id = c THEN o ELSE c END WHERE loc_id <> o GROUP BY component),
    sort AS (SELECT component, count(*) AS members, CASE WHEN bool_and(whole) AND count(DISTINCT kind) = 1 THEN min(kind) ELSE 'fragment' END AS kind, count(DISTINCT namespace) + max(CASE WHEN namespace IS NULL THEN 1 ELSE 0 END) AS namespaces,
    bool_and(touched) AS all_touched, bool_and(whole) AS all_whole, bool_and(starts_with(path, 'app/models/') OR starts_with(path, 'app/controllers/')) AS all_mvc FROM aged GROUP BY component),
    top AS (SELECT component, max(s) AS score, arg_min({{'i': identity, 'p': whole AND starts_with(regexp_extract(path, '[^/]*$'), '_')}}, (-s, path, start_line, end_line, loc_id)) AS e FROM aged JOIN ends USING (component) JOIN two ON a = loc_id AND b = c WHERE loc_id <> c GROUP BY component),
    ranked AS (SELECT list_position(['introduced', 'shifted', 'already_there', 'found'], label)::INT AS rank, label, component, sort.kind, members, round(score, 6) AS score, coalesce(payoff, 0) AS payoff, path, start_line, end_line, identity, language, size AS nodes, touched AS copy_touched,
    CASE WHEN all_touched THEN 'new in all places: share one of them before this is merged' WHEN language = 'erb' AND coalesce(e.p, false) THEN 'use the partial ' || e.i WHEN language = 'erb' THEN 'make it a partial or a component' WHEN all_whole THEN 'call or extend ' || e.i
    WHEN namespaces = 1 THEN 'make it a method' WHEN all_mvc THEN members || ' copies over ' || namespaces || ' classes: make a concern' ELSE members || ' copies over ' || namespaces || ' classes: make a concern or a service object' END AS hint
    FROM sort JOIN ends USING (component) JOIN labelled USING (component) LEFT JOIN paid USING (component) LEFT JOIN top USING (component) JOIN aged a ON a.loc_id = ends.c)"""
_BLANK = r"[\s\x0B\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A scan line by line: the open fence, the heading, the last line of prose and whether it was the line before.
_FENCED = rf"""WITH RECURSIVE ln AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS k, unnest(list_transform(ls, lambda x: rtrim(x, chr(13)))) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND text <> '')),
    seen AS (SELECT doc_id, k, t, regexp_replace(t, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS bare, regexp_extract(t, '^ {{0,3}}(`{{3,}}|~{{3,}})', 1) AS f, trim(regexp_extract(t, '^ {{0,3}}(?:`{{3,}}|~{{3,}})(.*)$', 1), ' ' || chr(9)) AS rest,
    regexp_matches(t, '^ {{0,3}}(=+|-+)[ 	]*$') AS under, regexp_matches(t, '^ {{0,3}}#{{1,6}}([ 	].*)?$') AS atx FROM ln),
    run AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, '' AS fence, '' AS heading, '' AS last, false AS prose, false AS opened, false AS inside, '' AS bare, '' AS info, '' AS over FROM ln
    UNION ALL SELECT r.doc_id, s.k, CASE WHEN r.fence = '' AND s.f <> '' AND NOT (s.f[1] = '`' AND contains(s.rest, '`')) THEN s.f WHEN r.fence <> '' AND s.f[1] = r.fence[1] AND len(s.f) >= len(r.fence) AND s.rest = '' THEN '' ELSE r.fence END,
    CASE WHEN r.fence <> '' OR (s.f <> '' AND NOT (s.f[1] = '`' AND contains(s.rest, '`'))) THEN r.heading WHEN r.prose AND s.under THEN r.last
    WHEN s.atx THEN regexp_replace(regexp_replace(regexp_extract(s.t, '^ {{0,3}}#{{1,6}}[ 	]+(.*)$', 1), '(^|[ 	]+)#+[ 	]*$', ''), '^{_BLANK}+|{_BLANK}+$', '', 'g') ELSE r.heading END,
    CASE WHEN r.fence = '' AND s.bare <> '' THEN s.bare ELSE r.last END,
    r.fence = '' AND s.bare <> '' AND NOT (s.f <> '' AND NOT (s.f[1] = '`' AND contains(s.rest, '`'))) AND NOT (r.prose AND s.under) AND NOT s.atx,
    r.fence = '' AND s.f <> '' AND NOT (s.f[1] = '`' AND contains(s.rest, '`')), r.fence <> '' AND NOT (s.f[1] = r.fence[1] AND len(s.f) >= len(r.fence) AND s.rest = ''), s.bare, regexp_extract(s.rest, '^[^\s\x{{A0}}]*'), r.heading
    FROM run r JOIN seen s ON s.doc_id = r.doc_id AND s.k = r.k + 1),
    part AS (SELECT *, count(*) FILTER (opened) OVER (PARTITION BY doc_id ORDER BY k) AS no, regexp_replace(bare, '(^|{_BLANK}+)#({_BLANK}.*)?$', '') AS noted FROM run),
    block AS (SELECT doc_id, no, max(CASE WHEN opened THEN k END) AS line, max(CASE WHEN opened THEN info END) AS info, max(CASE WHEN opened THEN over END) AS heading, count(*) FILTER (inside AND noted <> '') AS lines FROM part WHERE no > 0 AND (opened OR inside) GROUP BY doc_id, no)"""
_LOST = f"""WITH {_EXISTING}, {_PLACES}, old AS (SELECT a, b, coalesce({_SCORE}, 0) AS score FROM matches WHERE rev = 1 AND NOT coalesce(withdrawn, false) AND a IS NOT NULL AND b IS NOT NULL AND a <> b),
    shape AS (SELECT loc_id, key, CASE WHEN signature IS NULL THEN CAST(ordinal AS VARCHAR) WHEN ordinal IS NULL THEN signature ELSE signature || '#' || ordinal END AS structural FROM place),
    base AS (SELECT DISTINCT least(p.key, q.key) AS ka, greatest(p.key, q.key) AS kb, least(coalesce(p.structural, ''), coalesce(q.structural, '')) AS sa, greatest(coalesce(p.structural, ''), coalesce(q.structural, '')) AS sb, score FROM old JOIN shape p ON p.loc_id = a JOIN shape q ON q.loc_id = b),
    head AS (SELECT DISTINCT least(p.key, q.key) AS ka, greatest(p.key, q.key) AS kb, least(coalesce(p.structural, ''), coalesce(q.structural, '')) AS sa, greatest(coalesce(p.structural, ''), coalesce(q.structural, '')) AS sb, score FROM live JOIN shape p ON p.loc_id = a JOIN shape q ON q.loc_id = b),
    less AS (SELECT sa, sb, count(*) - coalesce((SELECT count(*) FROM head h WHERE h.sa = base.sa AND h.sb = base.sb), 0) AS lost FROM base GROUP BY sa, sb),
    gone AS (SELECT *, row_number() OVER (PARTITION BY sa, sb ORDER BY ka, kb, score) AS k FROM base JOIN less USING (sa, sb) WHERE NOT EXISTS (SELECT 1 FROM head h WHERE h.ka = base.ka AND h.kb = base.kb))
    SELECT ka, kb, round(score, 6) AS score FROM gone WHERE k <= lost"""
_LINES = r"""raw AS (SELECT doc_id, list_transform(string_split_regex(text, '\r?\n'), lambda l: list_filter(string_split_regex(l, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS r FROM documents WHERE text IS NOT NULL),
    line AS (SELECT doc_id, list_filter(r, lambda l: len(l) > 0) AS ws, list_filter(range(1, len(r) + 1), lambda k: len(r[k]) > 0) AS ln FROM raw)"""
_GRAMS = f"""WITH {_LINES}, seq AS (SELECT doc_id AS id, list_transform(ws, lambda l: array_to_string(l, ' ')) AS l, ln FROM line WHERE len(ws) > 0),
    pos AS (SELECT id, ln, unnest(range(0, greatest(len(l) - 2, 0))) AS i, l FROM seq), gram AS (SELECT id, ln[i + 1] - ln[i + 3] AS n, i, l[i + 1] || chr(1) || l[i + 2] || chr(1) || l[i + 3] AS g FROM pos),
    cnt AS (SELECT g, count(*) AS c, min((n, id, i)) AS hub FROM gram GROUP BY g HAVING count(*) >= 2),
    seed AS (SELECT x.id AS a, x.i AS i, y.id AS b, y.i AS j FROM gram x JOIN gram y ON x.g = y.g AND (x.id, x.i) < (y.id, y.i) JOIN cnt ON cnt.g = x.g
    WHERE c <= 50 OR (x.n, x.id, x.i) = hub OR (y.n, y.id, y.i) = hub)"""
_REFS = f"""WITH {_UNITS}, ref AS (SELECT identity AS text FROM unit WHERE kind = 'method' UNION SELECT split_part(namespace, '::', 1) FROM unit WHERE namespace IS NOT NULL
    UNION SELECT split_part(namespace, '::', 1) || '::*' FROM unit WHERE contains(namespace, '::')
    UNION SELECT array_to_string(string_split(identity, '/')[1:2], '/') || '/*' FROM unit WHERE kind = 'template'),
    hit AS (SELECT DISTINCT text, entry_id FROM ref JOIN unit ON identity = text WHERE NOT contains(text, '/') AND (contains(text, '#') OR contains(text, '.'))
    UNION SELECT text, entry_id FROM ref JOIN unit ON namespace = text OR starts_with(namespace, text || '::') WHERE kind <> 'template' AND NOT contains(text, '/') AND NOT contains(text, '*') AND NOT contains(text, '#') AND NOT contains(text, '.')
    UNION SELECT text, entry_id FROM ref JOIN unit ON starts_with(namespace, rtrim(text, '*')) WHERE kind <> 'template' AND suffix(text, '::*')
    UNION SELECT text, entry_id FROM ref JOIN unit ON starts_with(identity, rtrim(text, '*')) AND NOT contains(substr(identity, len(text)), '/') WHERE kind = 'template' AND suffix(text, '/*')),
    picked AS (SELECT entry_id, arg_max(text, (CASE WHEN NOT contains(text, '/') AND (contains(text, '#') OR contains(text, '.')) THEN [1, 0, 0, 0, len(text)]
    WHEN contains(text, '/') THEN [0, len(list_filter(string_split(text, '/'), lambda x: NOT contains(x, '*'))), len(string_split(text, '/')), 0, len(text)]
    ELSE [0, len(list_filter(string_split(text, '::'), lambda x: NOT contains(x, '*'))), len(string_split(text, '::')), 0, len(text)] END)) AS text FROM hit GROUP BY entry_id)"""
_LANGUAGE = r"CASE WHEN regexp_matches({0}, '\.rb$') THEN 'ruby' WHEN regexp_matches({0}, '\.(html(\+[\w-]+)?|turbo_stream)\.erb$') THEN 'erb' END"
_ALLOWED = r"""(NOT regexp_matches({0}, '(^|/)\.') AND split_part({0}, '/', 1) NOT IN ('vendor', 'node_modules', 'tmp', 'log', 'coverage', 'public', 'storage', 'bin')
    AND NOT regexp_matches({0}, '^((engines|packs|components|gems)/[^/]+/)?(db|config)/') AND NOT starts_with({0}, 'app/assets/builds/'))"""
_TEST = r"(regexp_matches({0}, '(^|/)(spec|test)/') OR regexp_matches({0}, '_(spec|test)\.rb$'))"
_SIMILAR = f"WITH {_SETS}, {_WEIGHTS}, {_PAIRS}"
_STAR = f"""WITH RECURSIVE {_UNITS}, u AS (SELECT root_digest, entry_id, path, start_line, end_line, node_count, end_line - start_line + 1 AS lines, min_lines AS ml, min_nodes AS mn FROM unit WHERE root_digest IS NOT NULL),
    allowed AS (SELECT x.root_digest, x.entry_id AS a, y.entry_id AS b FROM u x JOIN u y ON x.root_digest = y.root_digest AND x.entry_id <> y.entry_id WHERE least(x.lines, y.lines) >= least(x.ml, y.ml)
    AND least(x.node_count, y.node_count) >= least(x.mn, y.mn) AND NOT (x.path = y.path AND x.start_line <= y.end_line AND y.start_line <= x.end_line))"""
_SPOTS = r"""spot AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS t, unnest(range(1, len(string_split_regex(text, '\r?\n')) + 1)) AS ln FROM documents WHERE text IS NOT NULL),
    place AS (SELECT doc_id, ln, doc_id * 1048576 + ln AS id, array_to_string(list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''), ' ') AS t FROM spot WHERE trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')"""


ORACLES: dict[str, str] = {
    "src_filter": f"SELECT DISTINCT file_path AS path, {_LANGUAGE.format('file_path')} AS language FROM source_files WHERE {_LANGUAGE.format('file_path')} IS NOT NULL AND {_ALLOWED.format('file_path')} AND NOT {_TEST.format('file_path')}",
    "src_flags": f"""SELECT DISTINCT file_path AS path, {_LANGUAGE.format('file_path')} AS language, {_ALLOWED.format('file_path')} AS allowed, {_TEST.format('file_path')} AS test,
        lower(regexp_replace(regexp_replace(string_split(file_path, '/')[-1], '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM entries WHERE file_path IS NOT NULL""",
    "generated_files": r"""SELECT file_id, coalesce(len(list_filter(string_split(left(content, 65536), chr(10))[1:5], lambda x: regexp_matches(x, '^\s*(<%#|#|//)\s*(this file is auto-?generated|this file is automatically generated|auto-?generated by|generated by\b.*\bdo not edit|do not edit|code generated\b.*\bdo not edit)', 'i'))) > 0, false) AS generated
        FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rev DESC) AS r FROM source_files) WHERE r = 1""",
    "digest_weights": f"WITH {_SETS}, {_WEIGHTS} SELECT d AS digest, df, w FROM df",
    "entry_totals": f"WITH {_SETS}, {_WEIGHTS} SELECT id AS entry_id, t AS total, n AS digests FROM total",
    "prefix_digests": f"""WITH {_SETS}, {_WEIGHTS} SELECT id AS entry_id, d AS digest, t AS total FROM (SELECT *, coalesce(sum(w) OVER (PARTITION BY id ORDER BY df, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM weighted JOIN total USING (id)) WHERE before * 5 <= t""",
    "unit_sim_pairs": f"{_SIMILAR} SELECT * FROM pairs WHERE shared_w * 5 >= union_w * 4",
    "unit_sim_pairs_65": f"{_SIMILAR} SELECT * FROM pairs WHERE shared_w * 20 >= union_w * 13",
    "mixed_threshold_pairs": f"""{_SIMILAR}, {_UNITS} SELECT a, b, shared_w, union_w FROM pairs JOIN unit p ON p.entry_id = a JOIN unit q ON q.entry_id = b
        WHERE shared_w * 1000000 >= union_w * least(p.threshold, q.threshold) AND least(p.end_line - p.start_line, q.end_line - q.start_line) + 1 >= least(p.min_lines, q.min_lines) AND least(p.node_count, q.node_count) >= least(p.min_nodes, q.min_nodes)
        AND NOT (p.path = q.path AND p.start_line <= q.end_line AND q.start_line <= p.end_line)""",
    "basket_sim_pairs": f"WITH held AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS d FROM lineitem WHERE l_partkey IS NOT NULL), {_WEIGHTS}, {_PAIRS} SELECT * FROM pairs WHERE shared_w * 5 >= union_w * 4",
    "document_sim_pairs": f"""WITH {_LINES}, held AS (SELECT DISTINCT doc_id AS id, d FROM (SELECT doc_id, 'w' || unnest(flatten(ws)) AS d FROM line UNION ALL SELECT doc_id, 'l' || array_to_string(unnest(ws), ' ') FROM line
        UNION ALL SELECT doc_id, 't' || array_to_string(list_transform(ws, lambda l: array_to_string(l, ' ')), chr(10)) FROM line)), {_WEIGHTS}, {_PAIRS} SELECT * FROM pairs WHERE shared_w * 5 >= union_w * 4""",
    "explain_pair": f"""WITH {_SETS}, {_WEIGHTS}, two AS (SELECT d, max(w) AS w, count(*) AS n FROM weighted WHERE id IN (1, 2) GROUP BY d)
        SELECT 1::BIGINT AS a, 2::BIGINT AS b, coalesce(sum(w) FILTER (n = 2), 0)::BIGINT AS shared_w, coalesce(sum(w), 0)::BIGINT AS union_w, count(*) FILTER (n = 2) AS shared_digests, count(*) AS union_digests FROM two""",
    "identical_groups": f"WITH {_UNITS} SELECT root_digest, count(*) AS members, min(entry_id) AS first_id FROM unit WHERE root_digest IS NOT NULL GROUP BY root_digest HAVING count(*) >= 2",
    "identical_star": f"{_STAR}, reach(d, id, seen) AS (SELECT root_digest, a, a FROM allowed UNION SELECT root_digest, a, b FROM allowed UNION SELECT d, id, b FROM reach JOIN allowed ON seen = a) SELECT d AS root_digest, id AS entry_id, min(seen) AS group_id FROM reach GROUP BY d, id",
    "bucket_representatives": f"WITH {_UNITS} SELECT entry_id, min(entry_id) OVER (PARTITION BY coalesce(root_digest, '#' || entry_id), threshold, min_lines, min_nodes, end_line - start_line) AS rep_id FROM unit",
    "stand_in_pairs": f"""{_STAR}, {_SETS}, {_WEIGHTS.replace("weighted AS (SELECT id, d, df, w FROM held JOIN df USING (d))", "rep AS (SELECT entry_id, min(entry_id) OVER (PARTITION BY coalesce(root_digest, '#' || entry_id), threshold, min_lines, min_nodes, end_line - start_line) AS rep_id FROM unit), weighted AS (SELECT id, d, df, w FROM held JOIN df USING (d) WHERE id IN (SELECT rep_id FROM rep))")}, {_PAIRS},
        near AS (SELECT * FROM pairs WHERE shared_w * 5 >= union_w * 4), alone AS (SELECT * FROM rep WHERE entry_id <> rep_id AND entry_id NOT IN (SELECT a FROM allowed))
        SELECT * FROM near UNION SELECT least(entry_id, b), greatest(entry_id, b), shared_w, union_w FROM near JOIN alone ON a = rep_id UNION SELECT least(entry_id, a), greatest(entry_id, a), shared_w, union_w FROM near JOIN alone ON b = rep_id""",
    "fragment_groups": f"WITH {_SPOTS} SELECT min(id) AS first_id, count(*) AS n FROM place GROUP BY t HAVING count(*) >= 2",
    "fragment_pairs": f"""WITH {_SPOTS}, f AS (SELECT *, count(*) OVER (PARTITION BY t) AS n, min(id) OVER (PARTITION BY t) AS h FROM place)
        SELECT x.id AS a, y.id AS b FROM f x JOIN f y ON x.t = y.t AND x.id < y.id WHERE x.n <= 100 OR x.id = x.h""",
    "fragment_links": f"""WITH {_SPOTS}, g AS (SELECT t, min(id) AS least, min(CASE WHEN doc_id % 2 = 0 THEN id END) AS even, count(*) FILTER (doc_id % 2 = 0) AS evens, count(*) AS n FROM place GROUP BY t)
        SELECT id AS loc_id, g.least AS group_id FROM place JOIN g USING (t) WHERE n >= 2 AND evens >= 1""",
    "fragment_ordinals": f"WITH {_PLACES} SELECT loc_id, row_number() OVER (PARTITION BY entry_id, signature ORDER BY start_line, end_line, loc_id)::INT AS ordinal FROM place WHERE NOT whole AND signature IS NOT NULL",
    "run_seeds": f"{_GRAMS} SELECT DISTINCT a, i::INT AS i, b, j::INT AS j FROM seed",
    "run_islands": f"""{_GRAMS} SELECT a, b, diagonal::INT AS diagonal, min(i)::INT AS first, (max(i) + 2)::INT AS last FROM (SELECT *, i - row_number() OVER (PARTITION BY a, b, diagonal ORDER BY i) AS island
        FROM (SELECT DISTINCT a, b, i - j AS diagonal, i FROM seed)) GROUP BY a, b, diagonal, island""",
    "run_extended": f"""{_GRAMS}, one AS (SELECT id, unnest(range(0, len(l))) AS i, unnest(l) AS t FROM seq),
        point AS (SELECT DISTINCT p.a, p.b, x.i - y.i AS d, x.i FROM (SELECT DISTINCT a, b FROM seed) p JOIN one x ON x.id = a JOIN one y ON y.id = b AND x.t = y.t WHERE a <> b OR x.i < y.i),
        isle AS (SELECT a, b, d, min(i) AS f, max(i) AS t FROM (SELECT *, i - row_number() OVER (PARTITION BY a, b, d ORDER BY i) AS g FROM point) GROUP BY a, b, d, g),
        grown AS (SELECT c.a, c.b, c.d, c.f, c.t, CASE WHEN n.f IS NULL THEN coalesce(p.f, c.f) ELSE c.f END AS f2, coalesce(n.t, c.t) AS t2 FROM isle c LEFT JOIN isle n ON (n.a, n.b, n.d) = (c.a, c.b, c.d) AND n.f = c.t + 2
        LEFT JOIN isle p ON (p.a, p.b, p.d) = (c.a, c.b, c.d) AND p.t = c.f - 2 WHERE c.t - c.f >= 2)
        SELECT a, b, d::INT AS diagonal, f::INT AS core_first, t::INT AS core_last, f2::INT AS first, t2::INT AS last FROM grown WHERE a <> b OR abs(d) > t2 - f2""",
    "match_pruned": f"""WITH {_EXISTING}, {_PLACES}, m AS (SELECT match_id, a, b, CASE WHEN p.entry_id > q.entry_id THEN q ELSE p END AS x, CASE WHEN p.entry_id > q.entry_id THEN p ELSE q END AS y,
        (NOT (p.whole AND q.whole), -greatest(p.size, q.size), least(p.key, q.key), greatest(p.key, q.key), match_id) AS k FROM live JOIN place p ON p.loc_id = a JOIN place q ON q.loc_id = b)
        SELECT match_id, a, b FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.x.entry_id = m.x.entry_id AND o.y.entry_id = m.y.entry_id AND o.k < m.k AND (
        m.x.start_line >= o.x.start_line AND m.x.end_line <= o.x.end_line AND m.y.start_line >= o.y.start_line AND m.y.end_line <= o.y.end_line OR
        m.x.entry_id = m.y.entry_id AND m.x.start_line >= o.y.start_line AND m.x.end_line <= o.y.end_line AND m.y.start_line >= o.x.start_line AND m.y.end_line <= o.x.end_line))""",
    "match_clusters": f"WITH RECURSIVE {_EXISTING}, {_COMPONENTS} SELECT * FROM comp",
    "finding_locations": f"{_FINDINGS} SELECT component, loc_id, touched, CASE WHEN touched THEN -1 ELSE age END AS age FROM aged",
    "finding_ends": f"{_FINDINGS} SELECT component, arg_min(loc_id, (age, path, start_line, end_line, loc_id)) AS original, arg_max(loc_id, (age, path, start_line, end_line, loc_id)) AS copy FROM aged GROUP BY component",
    "finding_payoffs": f"""{_FINDINGS}, ends AS (SELECT component, arg_min(loc_id, (age, path, start_line, end_line, loc_id)) AS o, arg_max(loc_id, (age, path, start_line, end_line, loc_id)) AS c FROM aged GROUP BY component),
        two AS (SELECT a, b, max(score) AS s FROM (SELECT a, b, score FROM live UNION ALL SELECT b, a, score FROM live) GROUP BY a, b)
        SELECT component, round(sum(size * coalesce(s, 0)), 1) AS payoff FROM aged JOIN ends USING (component) LEFT JOIN two ON a = loc_id AND b = CASE WHEN loc_id = c THEN o ELSE c END WHERE loc_id <> o GROUP BY component""",
    "finding_kinds": f"""{_FINDINGS} SELECT component, count(*) AS members, CASE WHEN bool_and(whole) AND count(DISTINCT kind) = 1 THEN min(kind) ELSE 'fragment' END AS kind,
        count(DISTINCT namespace) + max(CASE WHEN namespace IS NULL THEN 1 ELSE 0 END) AS namespaces, bool_and(touched) AS all_touched, bool_or(touched) AS any_touched, bool_and(whole) AS all_whole,
        bool_and(starts_with(path, 'app/models/') OR starts_with(path, 'app/controllers/')) AS all_mvc FROM aged GROUP BY component""",
    "base_labels": f"{_FINDINGS}, {_BASE} SELECT * FROM labelled",
    "label_counts": f"{_FINDINGS}, {_BASE} SELECT label, count(*) AS n FROM labelled GROUP BY label",
    "contracted_pairs": _LOST,
    "top20_contracted": f"SELECT * FROM ({_LOST}) ORDER BY ka, kb, score LIMIT 20",
    "settings_per_unit": f"WITH {_UNITS} SELECT entry_id, threshold, min_lines, min_nodes FROM unit",
    "settings_floors": """SELECT least(coalesce(min(CASE WHEN v > 0 AND v <= 1 THEN CAST(v * 1000000 AS BIGINT) END), 800000), 800000) AS threshold, least(coalesce(min(min_lines), 4), 4)::BIGINT AS min_lines,
        least(coalesce(min(min_nodes), 20), 20)::BIGINT AS min_nodes FROM (SELECT *, TRY_CAST(trim(threshold) AS DECIMAL(18, 6)) AS v FROM repos)""",
    "ref_hits": f"{_REFS} SELECT * FROM hit",
    "most_specific_ref": f"{_REFS} SELECT entry_id, text FROM picked",
    "kept_matches": f"""{_REFS}, {_EXISTING}, {_PLACES} SELECT match_id FROM live JOIN place p ON p.loc_id = a JOIN place q ON q.loc_id = b JOIN picked x ON x.entry_id = p.entry_id JOIN picked y ON y.entry_id = q.entry_id
        WHERE p.entry_id <> q.entry_id AND x.text <> y.text""",
    "findings_ranked": f"{_RANKED} SELECT * FROM ranked",
    "report_json": f"""{_RANKED} SELECT component, to_json({{'class': label, 'score': score, 'kind': kind, 'copy': {{'path': path, 'start_line': start_line, 'end_line': end_line, 'identity': identity, 'nodes': nodes, 'touched': copy_touched}}, 'hint': hint, 'payoff': payoff}})::VARCHAR AS json FROM ranked""",
    "markdown_blocks": f"{_FENCED} SELECT doc_id, (no - 1)::INT AS block_no, info, line::INT AS line, heading, lines::INT AS lines FROM block",
    "unknown_refs": rf"""{_FENCED}, {_UNITS}, ref AS (SELECT DISTINCT noted AS text FROM part JOIN block USING (doc_id, no) WHERE block.info = 'parallel' AND inside AND noted <> ''),
    space AS (SELECT DISTINCT namespace FROM unit WHERE namespace IS NOT NULL AND kind <> 'template')
    SELECT text FROM ref WHERE NOT CASE WHEN contains(text, '/') THEN EXISTS (SELECT 1 FROM unit WHERE kind = 'template' AND regexp_full_match(identity, replace(regexp_escape(text), '\*', '[^/]*')))
    WHEN regexp_matches(text, '[#.]') THEN EXISTS (SELECT 1 FROM unit WHERE identity = text)
    ELSE EXISTS (SELECT 1 FROM space WHERE regexp_matches(namespace, '^' || replace(regexp_escape(text), '\*', '[^:]*') || '(::.*)?$')) END""",
    "source_units": f"""WITH {_UNITS}, file AS (SELECT file_id, repo || '/' || file_path AS path FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rev DESC) AS r FROM source_files) WHERE r = 1 AND content IS NOT NULL)
    SELECT file.path, unit_kind AS kind, start_line, end_line FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY rev DESC) AS r FROM entries) e JOIN file USING (file_id) WHERE r = 1""",
    "source_names": """SELECT entry_id, unit_identity AS identity FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY rev DESC) AS r FROM entries) e
    JOIN (SELECT file_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rev DESC) AS q FROM source_files) WHERE q = 1 AND content IS NOT NULL) USING (file_id) WHERE r = 1 AND unit_identity IS NOT NULL AND unit_kind <> 'template'""",
    "json_nodes": r"""WITH j AS (SELECT file_id, trim(content, ' ' || chr(9) || chr(10) || chr(13)) AS c, regexp_replace(content, '"(?:[^"\\]|\\.)*"', 's', 'g') AS bare FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rev DESC) AS r FROM source_files)
    WHERE r = 1 AND content IS NOT NULL AND suffix(file_path, '.json') AND json_valid(content))
    SELECT file_id, len(regexp_extract_all(bare, '[^\s{}\[\],:]+')) + len(regexp_extract_all(bare, '[{\[]'))::BIGINT AS nodes, len(regexp_extract_all(bare, '[{\[]'))::BIGINT AS sequences, len(string_split(c, chr(10)))::INT AS lines FROM j""",
}
