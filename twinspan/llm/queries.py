"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from twinspan.llm import components, distinctive, languages, nearcopies, packing, parsing, setjoin, tokens

#: Distinct digests of an array of spellings, as DuckDB text.
_SET = """list_distinct(list_transform(list_filter(fp_set, lambda x: trim(coalesce(x, ''), ' ' || chr(9)) <> ''),
    lambda x: lpad(ltrim(regexp_replace(lower(trim(x, ' ' || chr(9))), '^0x', ''), '0'), 16, '0')))"""

_ENTRIES = f"""counted AS (SELECT entry_id, {_SET} AS s FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY rev DESC) AS r
    FROM entries) WHERE r = 1 AND fp_set IS NOT NULL)"""

_LIVE = """live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY rev DESC) AS r FROM matches)
    WHERE r = 1 AND NOT coalesce(withdrawn, false) AND a IS NOT NULL AND b IS NOT NULL AND a <> b)"""
_REACH = """edge AS (SELECT a AS u, b AS v FROM link UNION SELECT b, a FROM link), reach(id, seen) AS (SELECT u, u FROM edge UNION SELECT u, v FROM edge UNION SELECT reach.id, edge.v FROM reach JOIN edge ON edge.u = reach.seen)"""

QUERIES = {
    "p1_found": distinctive.p1_found,
    "p1_scores": distinctive.p1_scores,
    "p2_found": parsing.p2_found,
    "p2_errors": parsing.p2_errors,
    "p2_rates": parsing.p2_rates,
    "p3_found": components.p3_found,
    "p4_found": setjoin.p4_found,
    "p4_links": setjoin.p4_links,
    "p5_found": nearcopies.p5_found,
    "p6_ids": tokens.p6_ids,
    "p7_containers": packing.p7_containers,
    "p7_fill": packing.p7_fill,
    "p8_found": languages.p8_found,
    "p8_documents": languages.p8_documents,
    "p8_segments": languages.p8_segments,
}

ORACLES = {
    "p1_found": f"""WITH {_ENTRIES}, held AS (SELECT entry_id, len(s) AS n, unnest(s) AS digest FROM counted),
    df AS (SELECT digest, count(*) AS df FROM held GROUP BY digest)
    SELECT entry_id, digest FROM (SELECT entry_id, digest, row_number() OVER (PARTITION BY entry_id ORDER BY df, digest) AS k
    FROM held JOIN df USING (digest) WHERE n >= 5 AND df >= 2) WHERE k = 1""",
    "p1_scores": f"""WITH {_ENTRIES}, held AS (SELECT entry_id, len(s) AS n, unnest(s) AS digest FROM counted),
    df AS (SELECT digest, count(*)::DOUBLE AS df FROM held GROUP BY digest), total AS (SELECT sum(df) AS t FROM df)
    SELECT entry_id, digest, df::BIGINT AS df, n::INT AS set_size, round(((ln((1 + df) / (n + t - 1 - df)) - ln((2 * df - 1) / (2 * t - n - 2 * df + 1)))
    / sqrt(1 / (1 + df) + 1 / (2 * df - 1))), 6) AS z FROM held JOIN df USING (digest), total""",
    "p3_found": f"""WITH RECURSIVE {_LIVE}, member AS (SELECT DISTINCT cluster_id, loc_id FROM base_clusters JOIN locations USING (repo, loc_key)),
    link AS (SELECT a, b FROM live UNION SELECT x.loc_id, y.loc_id FROM member x JOIN member y ON x.cluster_id = y.cluster_id AND x.loc_id < y.loc_id), {_REACH}
    SELECT id AS loc_id, min(seen) AS group_id FROM reach GROUP BY id""",
    "p4_found": f"""WITH {_ENTRIES}, record AS (SELECT entry_id AS id, entry_id AS own, s FROM counted UNION ALL SELECT DISTINCT ON (loc_id) loc_id, entry_id, {_SET} FROM locations WHERE fp_set IS NOT NULL),
    token AS (SELECT id, own, len(s) AS n, unnest(s) AS d FROM record WHERE len(s) >= 5)
    SELECT x.id AS id_a, y.id AS id_b FROM token x JOIN token y ON x.d = y.d AND x.id < y.id WHERE x.own <> y.own GROUP BY x.id, y.id, x.n, y.n HAVING count(*) * 5 >= (x.n + y.n - count(*)) * 4""",
    "p4_links": f"""WITH {_ENTRIES}, record AS (SELECT entry_id AS id, entry_id AS own, s FROM counted UNION ALL SELECT DISTINCT ON (loc_id) loc_id, entry_id, {_SET} FROM locations WHERE fp_set IS NOT NULL),
    large AS (SELECT id, own, len(s) AS n, min(id) OVER (PARTITION BY list_sort(s)) AS class_id, s FROM record WHERE len(s) >= 5), token AS (SELECT id, own, n, unnest(s) AS d FROM large),
    pair AS (SELECT x.id AS a, y.id AS b FROM token x JOIN token y ON x.d = y.d AND x.id <> y.id WHERE x.own <> y.own GROUP BY x.id, y.id, x.n, y.n HAVING count(*) * 5 >= (x.n + y.n - count(*)) * 4)
    SELECT id, class_id, count(b)::BIGINT AS links FROM large LEFT JOIN pair ON a = id GROUP BY id, class_id""",
    "p5_found": f"""WITH RECURSIVE {_ENTRIES}, {_LIVE}, token AS (SELECT entry_id AS id, len(s) AS n, unnest(s) AS d FROM counted WHERE len(s) >= 5),
    unset AS (SELECT entry_id, fp_set IS NULL AS bare FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY rev DESC) AS r FROM entries) WHERE r = 1),
    whole AS (SELECT DISTINCT loc_id, entry_id, bare FROM locations JOIN unset USING (entry_id) WHERE is_whole),
    strong AS (SELECT a, b FROM live WHERE match_kind = 'unit' AND CASE WHEN score IS NULL OR trim(score) = '' THEN shared_w * 10 >= union_w * 7 AND union_w > 0
        WHEN contains(score, '/') THEN split_part(score, '/', 1)::DECIMAL(19, 0) * 10 >= split_part(score, '/', 2)::DECIMAL(19, 0) * 7
        WHEN suffix(score, '%') THEN rtrim(score, '%')::DECIMAL(24, 15) >= 70 ELSE score::DECIMAL(24, 15) >= 0.7 END),
    link AS (SELECT x.id AS a, y.id AS b FROM token x JOIN token y ON x.d = y.d AND x.id < y.id GROUP BY x.id, y.id, x.n, y.n HAVING count(*) * 10 >= (x.n + y.n - count(*)) * 7
        UNION SELECT p.entry_id, q.entry_id FROM strong JOIN whole p ON p.loc_id = a JOIN whole q ON q.loc_id = b WHERE (p.bare OR q.bare) AND p.entry_id <> q.entry_id), {_REACH}
    SELECT id AS entry_id, min(seen) AS group_id FROM reach GROUP BY id""",
}
