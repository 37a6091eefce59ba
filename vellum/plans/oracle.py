"""The registered queries in SQL."""

LINES = r"""
    lines AS (
        SELECT doc_id, n AS line_no, parts[n] AS line
        FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""

WORDS = (
    LINES
    + r""",
    tokens AS (SELECT doc_id, line_no, k, parts[k] AS w FROM (SELECT doc_id, line_no, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, line_no, string_split(line, ' ') AS parts FROM lines))),
    placed AS (
        SELECT doc_id, line_no, k, w, 6 * coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM tokens),
    words AS (
        SELECT doc_id, CAST((line_no - 1) // 50 + 1 AS INTEGER) AS page, line_no, k, w AS text, CAST(x AS BIGINT) AS x0, CAST(12 * ((line_no - 1) % 50) AS BIGINT) AS y0,
               CAST(x + 6 * length(w) AS BIGINT) AS x1, CAST(12 * ((line_no - 1) % 50) + 10 AS BIGINT) AS y1
        FROM placed WHERE w <> '')"""
)

HEADER = r"regexp_matches(line, '^[^\s]+( [^\s]+){0,2}\.$')"

NESTED = """
    items AS (SELECT l.*, p_name, p_brand FROM lineitem l JOIN part ON l_partkey = p_partkey)"""

ACCURACY = """
    pairs AS (
        SELECT l_orderkey, l_linenumber, (l_partkey + l_linenumber) % 3 = 0 AS o3, (l_partkey + l_linenumber) % 5 = 0 AS o5, (l_partkey + l_linenumber) % 7 = 0 AS o7,
               (l_partkey + l_linenumber) % 11 = 0 AS o11, (l_partkey + l_linenumber) % 13 <> 0 AS found, l_quantity AS q, l_returnflag AS m, l_linestatus AS f
        FROM lineitem),
    rows AS (
        SELECT *, CASE WHEN o5 THEN NULL ELSE f END AS gf, CASE WHEN o7 THEN NULL ELSE q END AS pq, CASE WHEN o11 THEN f ELSE m END AS pm,
               CASE WHEN o5 THEN NULL WHEN o11 THEN m ELSE f END AS pf
        FROM pairs)"""

SQL: dict[str, str] = {
    "doc_lines": rf"WITH {LINES}, c AS (SELECT doc_id, line_no, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM lines) SELECT doc_id, line_no, text, length(text) AS chars FROM c",
    "sections": f"""
        WITH {LINES}, marked AS (
            SELECT *, sum(CASE WHEN {HEADER} THEN 1 ELSE 0 END) OVER w AS section_no, last_value(CASE WHEN {HEADER} THEN line END IGNORE NULLS) OVER w AS header
            FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, header, count(*) AS n_lines, min(line_no) AS line_start, max(line_no) AS line_end, CAST(sum(length(line)) AS BIGINT) AS chars
        FROM marked GROUP BY doc_id, section_no, header""",
    "section_forward_fill": """
        SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS carried
        FROM events""",
    "continuation_islands": """
        WITH e AS (SELECT *, epoch_us(ts) AS t FROM events),
        m AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600000000 THEN 0 ELSE 1 END AS starts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
        i AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
        SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_event, max(t) AS last_at FROM i GROUP BY user_id, island""",
    "content_dedupe": "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents d JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1",
    "median_column_position": "SELECT l_suppkey, quantile_cont(l_extendedprice, 0.5) AS median_price, count(*) AS n FROM lineitem GROUP BY 1",
    "unlabelled_anti": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "latest_correction": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1",
    "correction_overlay": """
        WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE turn > 0) WHERE n = 1)
        SELECT b.conv_id, CASE WHEN c.conv_id IS NULL THEN b.role ELSE c.role END AS role, CASE WHEN c.conv_id IS NULL THEN b.text ELSE c.text END AS text, c.conv_id IS NOT NULL AS corrected
        FROM conversations b LEFT JOIN c ON b.conv_id = c.conv_id WHERE b.turn = 0""",
    "correction_audit": "SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, text AS after FROM conversations",
    "correction_orphans": "SELECT DISTINCT doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND lang = 'en')",
    "nested_assembly": f"""
        WITH {NESTED} SELECT o_orderkey, CAST(count(l_orderkey) AS INTEGER) AS n_components, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS quantity,
               coalesce(string_agg(p_brand, ';' ORDER BY l_linenumber, l_partkey, p_brand), '') AS brands
        FROM orders LEFT JOIN items ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
    "export_rows": rf"""
        WITH {NESTED} SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CAST(o_orderkey AS VARCHAR) AS set_id, CAST(o_orderkey AS VARCHAR) AS set_number,
               CASE WHEN o_orderpriority LIKE '1%' THEN 'and #C' || o_custkey || ' - ' || o_orderstatus ELSE o_orderpriority END AS set_description, 'active' AS status,
               CAST(coalesce(l_linenumber, 1) AS VARCHAR) AS pages, CAST(l_linenumber AS VARCHAR) AS component_id, CASE WHEN l_linenumber <> 6 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS qty,
               CAST(NULL AS VARCHAR) AS unit, p_name AS description, p_brand AS catalog_number, l_returnflag AS mfr, CAST(NULL AS VARCHAR) AS finish,
               CASE WHEN l_linenumber IS NULL THEN 'Note: see list; see list' END AS notes, CASE WHEN l_linenumber IS NOT NULL THEN '' END AS raw_text,
               '{{"qty":' || round(1 - l_tax - l_discount, 4) || '}}' AS confidence,
               '[{{"page":' || l_linenumber || ',"bbox":[0.0,0.0,1.0,1.0],"page_width":10.0,"page_height":10.0,"line_start":1,"line_end":1}}]' AS locations,
               CASE WHEN l_linenumber = 7 THEN 'seventh' WHEN l_linenumber IS NULL THEN NULL ELSE '' END AS warnings, CAST(NULL AS VARCHAR) AS catalog_resolution, 'false' AS corrected
        FROM orders LEFT JOIN items ON o_orderkey = l_orderkey""",
    "csv_guard": rf"""
        WITH {LINES} SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^\s*[=+\-@]') THEN '''' || line ELSE line END AS guarded, '''=' || line AS forced FROM lines""",
    "code_resolution": """
        WITH p AS (SELECT *, 'B' || regexp_extract(p_brand, '([0-9]+)', 1) AS code FROM part),
        d AS (SELECT code, max(p_partkey) AS p_partkey FROM p GROUP BY code)
        SELECT l_orderkey, l_linenumber, l_partkey, p.code, d.p_partkey AS defined_by, x.p_name AS resolved
        FROM lineitem JOIN p ON l_partkey = p.p_partkey JOIN d ON p.code = d.code JOIN part x ON x.p_partkey = d.p_partkey""",
    "page_overlap_match": """
        WITH g AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'),
        p AS (SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_quantity > 40),
        o AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS overlap FROM g JOIN p USING (l_suppkey, l_linenumber) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY overlap DESC, l_returnflag, l_linestatus) AS n FROM o)
        SELECT l_suppkey, l_returnflag, l_linestatus, CAST(overlap AS INTEGER) AS overlap FROM r WHERE n = 1""",
    "suffix_path_match": """
        WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages),
        g AS (SELECT DISTINCT gold FROM (SELECT regexp_extract(path, '([^/]+/[^/]+)$', 1) AS gold FROM p) WHERE gold <> ''),
        n AS (SELECT page_id, lower(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '^/|/$', '', 'g')) AS l FROM p)
        SELECT page_id, gold FROM n JOIN g ON l = lower(gold) OR ends_with(l, '/' || lower(gold)) OR ends_with(lower(gold), '/' || l)""",
    "band_assignment": f"""
        WITH {WORDS}, r AS (
            SELECT doc_id, x1, CASE WHEN x0 + 3.5 >= 300 + doc_id % 7 * 6 THEN 'finish' WHEN x0 + 3.5 >= 180 + doc_id % 7 * 6 THEN 'catalog_number' WHEN x0 + 3.5 >= 60 + doc_id % 7 * 6 THEN 'description' ELSE 'qty' END AS role FROM words)
        SELECT doc_id, role, count(*) AS n, max(x1) AS right FROM r GROUP BY doc_id, role""",
    "bbox_union": f"WITH {WORDS} SELECT doc_id, page, line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_words FROM words GROUP BY doc_id, page, line_no",
    "page_locations": f"WITH {WORDS} SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(line_no) AS line_start, max(line_no) AS line_end FROM words GROUP BY doc_id, page",
    "box_grounding": f"""
        WITH {WORDS}, a AS (SELECT doc_id, page, line_no, min(x0) - 1 AS x0, min(y0) - 1 AS y0, max(x1) + 1 AS x1, max(y1) + 1 AS y1 FROM words GROUP BY doc_id, page, line_no)
        SELECT a.doc_id, a.line_no, count(*) AS n_words FROM words w JOIN a ON w.doc_id = a.doc_id AND w.page = a.page AND w.x0 < a.x1 AND a.x0 < w.x1 AND w.y0 < a.y1 AND a.y0 < w.y1
        GROUP BY a.doc_id, a.line_no""",
    "box_coverage": f"""
        WITH {WORDS} SELECT doc_id, line_no, k, round(CAST(greatest(0, least(x1, 200) - x0) * greatest(0, least(y1, 400) - y0) AS DOUBLE) / ((x1 - x0) * (y1 - y0)), 6) AS coverage
        FROM words WHERE x0 < 200 AND y0 < 400""",
    "header_evidence": f"""
        WITH {LINES}, e AS (SELECT *, coalesce(max(CASE WHEN length(line) > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 17 FOLLOWING), 0) = 1 AS has_evidence FROM lines)
        SELECT doc_id, line_no, has_evidence FROM e WHERE {HEADER}""",
    "legend_cumulative": """
        WITH t AS (SELECT conv_id, turn, lower(string_split(text, ' ')[1]) AS entry FROM conversations)
        SELECT a.conv_id, a.turn, CAST(count(DISTINCT b.entry) AS INTEGER) AS n_entries FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn <= a.turn GROUP BY a.conv_id, a.turn""",
    "needs_inspection": f"""
        WITH {NESTED} SELECT o_orderkey, CAST(count(*) AS INTEGER) AS n_components FROM orders JOIN items ON o_orderkey = l_orderkey
        GROUP BY o_orderkey HAVING bool_or(l_linenumber >= 6 OR round(1 - l_tax - l_discount, 4) < 0.8)""",
    "search_sets": f"""
        WITH {NESTED} SELECT o_orderkey, o_orderstatus FROM orders LEFT JOIN items ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'
        GROUP BY o_orderkey, o_orderstatus, o_orderpriority HAVING contains(lower(o_orderpriority), 'red') OR bool_or(contains(lower(p_name), 'red'))""",
    "corpus_summary": "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, max(o_totalprice) AS largest FROM orders GROUP BY 1",
    "metrics_null_safe": f"""
        WITH {ACCURACY}, f AS (
            SELECT 'qty' AS field, found AND q IS NOT DISTINCT FROM pq AS ok FROM rows UNION ALL
            SELECT 'mfr', found AND m IS NOT DISTINCT FROM pm FROM rows UNION ALL
            SELECT 'finish', found AND gf IS NOT DISTINCT FROM pf FROM rows WHERE NOT o3)
        SELECT field, count(*) FILTER (WHERE ok) AS correct, count(*) AS total, CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) AS accuracy FROM f GROUP BY field""",
    "maker_finish_swaps": f"WITH {ACCURACY} SELECT m AS mfr, gf AS finish, count(*) AS n FROM rows WHERE found AND m <> gf AND m = pf AND gf = pm GROUP BY m, gf",
    "set_difference_both_ways": """
        SELECT o_orderkey AS key, 'missing' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL
        SELECT key, 'extra' FROM (SELECT DISTINCT l_orderkey AS key FROM lineitem) WHERE key NOT IN (SELECT o_orderkey FROM orders)""",
    "token_overlap": """
        WITH d AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents) WHERE length(t) >= 2 GROUP BY ALL),
        b AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark) WHERE length(t) >= 2 GROUP BY ALL),
        s AS (SELECT item_id, sum(n) AS size FROM b GROUP BY item_id),
        c AS (SELECT doc_id, item_id, sum(least(d.n, b.n)) AS common FROM d JOIN b USING (t) GROUP BY doc_id, item_id)
        SELECT doc_id, c.item_id, CAST(common AS BIGINT) AS common, CAST(size AS INTEGER) AS size FROM c JOIN s ON c.item_id = s.item_id WHERE common >= greatest(ceil(size * 0.5), 1)""",
    "as_of_header": f"""
        WITH {WORDS}, l AS (SELECT doc_id, page, line_no, min(y0) AS y0, count(*) AS n FROM words GROUP BY doc_id, page, line_no),
        h AS (SELECT doc_id, page, max(y0) AS head_y, line_no AS head_line FROM l WHERE n <= 3 GROUP BY doc_id, page, line_no),
        j AS (SELECT l.doc_id, l.line_no, h.head_y, h.head_line, row_number() OVER (PARTITION BY l.doc_id, l.line_no ORDER BY h.head_y DESC) AS r
              FROM l LEFT JOIN h ON l.doc_id = h.doc_id AND l.page = h.page AND h.head_y <= l.y0 + 2 AND l.y0 - h.head_y <= 140 WHERE l.n > 3)
        SELECT doc_id, line_no, coalesce(head_y, -1) AS head_y, coalesce(head_line, -1) AS head_line FROM j WHERE r = 1""",
    "nearest_header": f"""
        WITH {WORDS}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line_no) AS n FROM words), h AS (SELECT DISTINCT doc_id, page, x0 AS mark FROM c WHERE n <= 6),
        j AS (SELECT w.doc_id, w.line_no, w.k, w.x0, h.mark, row_number() OVER (PARTITION BY w.doc_id, w.line_no, w.k ORDER BY abs(h.mark - w.x0), h.mark) AS r
              FROM c w LEFT JOIN h ON w.doc_id = h.doc_id AND w.page = h.page AND abs(h.mark - w.x0) <= 35 WHERE w.n > 6)
        SELECT doc_id, line_no, k, x0, coalesce(mark, -1) AS nearest_mark FROM j WHERE r = 1""",
    "stratified_pages": f"""
        WITH {WORDS}, p AS (SELECT DISTINCT doc_id, page FROM words),
        n AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM p)
        SELECT doc_id, CAST(max(n) AS INTEGER) AS n_pages, string_agg(CAST(page AS VARCHAR), ';' ORDER BY page) FILTER (WHERE i = 1 OR i = n OR page BETWEEN middle - 1 AND middle + 1) AS chosen
        FROM n JOIN (SELECT doc_id, page AS middle FROM n WHERE i = n // 2 + 1) USING (doc_id) GROUP BY doc_id""",
    "region_truncation": rf"""
        WITH {LINES}, s AS (SELECT *, max(CASE WHEN regexp_matches(line, ' [a-z]{{1,2}}\.$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped FROM lines)
        SELECT doc_id, count(*) AS n_lines, max(line_no) AS last_line FROM s WHERE stopped = 0 GROUP BY doc_id""",
    "line_gaps": f"""
        WITH {WORDS}, l AS (SELECT doc_id, page, line_no, min(y0) AS y0 FROM words GROUP BY doc_id, page, line_no),
        g AS (SELECT doc_id, line_no, y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y0) AS gap FROM l) SELECT doc_id, line_no, gap FROM g WHERE gap IS NOT NULL""",
    "nearest_anchor": f"""
        WITH {LINES}, a AS (
            SELECT *, last_value(CASE WHEN {HEADER} THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
                   first_value(CASE WHEN {HEADER} THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM lines)
        SELECT doc_id, line_no, coalesce(CASE WHEN b IS NULL THEN f WHEN f IS NULL THEN b WHEN f - line_no < line_no - b THEN f ELSE b END, -1) AS anchor FROM a""",
    "struck_lines": f"""
        WITH {WORDS}, h AS (SELECT doc_id, line_no, count(*) AS n, count(*) FILTER (WHERE x1 - 2 <= 120 AND -1 <= x0 + 2) AS hits FROM words WHERE line_no % 9 = 0 GROUP BY doc_id, line_no)
        SELECT doc_id, line_no, CAST(n AS INTEGER) AS n_words FROM h WHERE hits >= greatest(2, n * 0.35)""",
    "heading_lines": rf"""
        WITH {LINES} SELECT doc_id, line_no, CAST(line_no AS VARCHAR) AS set_number, CASE WHEN line_no % 3 = 0 THEN nullif(trim(line), '') END AS description
        FROM lines WHERE line_no % 3 = 2 OR (line_no % 3 = 0 AND length(trim('- ' || line)) <= 150)""",
    "quantity_parse": """
        WITH r AS (SELECT l_linenumber AS n, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
        SELECT CASE WHEN n > 2 THEN CAST(q AS DOUBLE) END AS qty_num, CASE WHEN n = 1 THEN q || '/2' END AS qty_text, CASE WHEN n = 1 THEN q || '/2' WHEN n = 2 THEN 'A/R' ELSE CAST(q AS VARCHAR) END AS qty_raw, count(*) AS n
        FROM r GROUP BY 1, 2, 3""",
    "page_ranges": """
        WITH r AS (SELECT l_linenumber AS a, l_linenumber + CAST(l_quantity AS INTEGER) % 5 AS b, count(*) AS n FROM lineitem GROUP BY 1, 2)
        SELECT a || '-' || b || ', 2' AS pages, (SELECT string_agg(CAST(i AS VARCHAR), ';' ORDER BY i) FROM (SELECT DISTINCT unnest(list_append(range(a, b + 1), 2)) AS i)) AS numbers, n FROM r""",
    "output_names": r"""
        WITH p AS (SELECT page_id, url, lower(regexp_replace(regexp_replace(replace(url, '\', '/'), '/+', '/', 'g'), '^/|/$', '', 'g')) AS path FROM pages)
        SELECT page_id, path, substr(regexp_replace(regexp_replace(path, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 100) || '-' || substr(sha256(path), 1, 12) AS name, substr(sha256(url), 1, 16) AS id FROM p""",
    "product_split": """
        SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS mfr, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type || ' - ' || p_name END AS catalog_number FROM part""",
    "cell_join": """
        SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN '-' ELSE ' ' END || CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type || ' ' END || p_brand AS joined FROM part""",
    "notes_dedupe": rf"""
        WITH {LINES}, n AS (SELECT doc_id, line_no, regexp_replace(line, '(?i)^notes?\s*:\s*', '') AS note FROM lines WHERE NOT regexp_matches(line, '(?i)^description\s*:')),
        f AS (SELECT doc_id, note, min(line_no) AS n FROM n GROUP BY doc_id, note)
        SELECT doc_id, CAST(count(*) AS INTEGER) AS n_notes, sha256(string_agg(note, chr(10) ORDER BY n)) AS notes_sha256 FROM f GROUP BY doc_id""",
    "alias_expansion": """
        WITH n AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
        o AS (SELECT orders.*, CAST(n AS INTEGER) AS n FROM orders JOIN n ON orders.o_orderkey = n.o_orderkey)
        SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS set_number, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderstatus ELSE o_orderpriority END AS description,
               n AS n_components, 1 AS n_notes, false AS is_alias FROM o
        UNION ALL SELECT o_orderkey, 'C' || o_custkey, substr(sha256(o_orderkey || ':C' || o_custkey), 1, 16), o_orderstatus, n, 2, true FROM o WHERE o_orderpriority LIKE '1%'""",
    "text_inventory": f"""
        WITH {LINES}, p AS (SELECT doc_id, CAST((line_no - 1) // 5 + 1 AS INTEGER) AS page, line_no % 11 = 0 AS h, length(trim(CASE WHEN line_no % 11 = 0 THEN 'SET ' || line_no ELSE line END)) AS n FROM lines),
        g AS (SELECT doc_id, page, sum(n) < 60 AS poor, bool_or(h) AS h FROM p GROUP BY doc_id, page),
        m AS (SELECT doc_id, max(page) AS pages FROM g GROUP BY doc_id),
        c AS (SELECT DISTINCT g.doc_id, q.page FROM g JOIN g q ON g.doc_id = q.doc_id AND g.h AND q.page BETWEEN g.page - 1 AND g.page + 2),
        cs AS (SELECT doc_id, string_agg(CAST(page AS VARCHAR), ';' ORDER BY page) AS s FROM c GROUP BY doc_id),
        ps AS (SELECT doc_id, string_agg(CAST(page AS VARCHAR), ';' ORDER BY page) FILTER (WHERE poor) AS poor, string_agg(CAST(page AS VARCHAR), ';' ORDER BY page) FILTER (WHERE h) AS h FROM g GROUP BY doc_id)
        SELECT m.doc_id, pages, coalesce(poor, '') AS poor_pages, coalesce(h, '') AS heading_pages, coalesce(s, '') AS candidate_pages FROM m JOIN ps ON m.doc_id = ps.doc_id LEFT JOIN cs ON m.doc_id = cs.doc_id""",
    "merged_cell_fill": """
        WITH f AS (SELECT l_orderkey, coalesce(last_value(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS filled FROM lineitem)
        SELECT l_orderkey, filled, count(*) AS n FROM f GROUP BY l_orderkey, filled""",
    "page_runs": """
        WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber AS page FROM lineitem),
        s AS (SELECT *, CASE WHEN page - lag(page) OVER w = 1 THEN 0 ELSE 1 END AS starts FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY page)),
        i AS (SELECT *, sum(starts) OVER (PARTITION BY l_orderkey ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM s)
        SELECT l_orderkey, CAST(island AS BIGINT) AS island, min(page) AS first_page, max(page) AS last_page FROM i GROUP BY l_orderkey, island""",
    "extract_schedules": """
        SELECT o_custkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS set_number, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS qty, p_name AS description, p_brand AS catalog_number, l_returnflag AS finish, p_type AS mfr
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE NOT (l_linenumber = 2 AND o_custkey % 2 = 1 AND o_custkey % 7 <> 0)""",
    "line_grouping": f"WITH {WORDS}, l AS (SELECT doc_id, page, line_no, count(*) AS n FROM words GROUP BY doc_id, page, line_no) SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS INTEGER) AS line_no, CAST(n AS INTEGER) AS n_words FROM l",
    "positioned_words": f"""WITH {WORDS}
        SELECT doc_id, page, count(*) AS n_words, CAST(sum(x0) AS BIGINT) AS x0, CAST(sum(x1) AS BIGINT) AS x1, CAST(sum(y1) AS BIGINT) AS y1,
               CAST(sum(length(text)) AS BIGINT) AS chars, max(text) AS last_word
        FROM words GROUP BY doc_id, page""",
    "document_check": f"""WITH {WORDS},
        files AS (SELECT doc_id, CAST(count(DISTINCT page) AS INTEGER) AS n FROM words GROUP BY doc_id)
        SELECT 'document/' || doc_id AS path, CASE WHEN doc_id % 3 <> 0 THEN n END AS page_count,
               CASE WHEN doc_id % 3 = 0 THEN n || ' of ' || (n + 1) || ' pages are there' END AS error FROM files
        UNION ALL SELECT 'page/' || page_id, NULL, 'not a positioned-text file' FROM pages""",
}

#: The stream of corrections gives what the overlay gives.
SQL["live_overlay"] = SQL["correction_overlay"]

#: Each copy with its own row: both texts equal, and three fields that agree.
SQL["assignment_totals"] = """
    SELECT l_orderkey AS o_orderkey, count(*) AS n_gold, count(*) FILTER (l_linenumber <> 5) AS n_matched, round(CAST(6.03 AS DOUBLE) * count(*) FILTER (l_linenumber <> 5), 2) AS total
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey"""

#: The gold orders: which of them and of their items the results have, and what is wrong with these.
GOLD = """
    i AS (
        SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth
        FROM lineitem JOIN part ON l_partkey = p_partkey),
    o AS (SELECT *, o_orderkey % 5 <> 0 AS found FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM i)),
    r AS (SELECT i.*, o.found AND nth <> 5 AS matched FROM i JOIN o ON l_orderkey = o_orderkey)"""

SQL["evaluation_metrics"] = f"""
    WITH {GOLD},
    m AS (
        SELECT 'set_recall' AS metric, count(*) FILTER (found) AS correct, count(*) AS total FROM o
        UNION ALL SELECT 'set_description', count(*) FILTER (found AND o_custkey % 2 = 0), count(*) FROM o
        UNION ALL SELECT 'set_status', count(*) FILTER (found), count(*) FROM o
        UNION ALL SELECT 'row_recall', count(*) FILTER (matched), count(*) FROM r
        UNION ALL SELECT 'row_precision', (SELECT count(*) FROM r WHERE matched), (SELECT count(*) FROM r WHERE matched) + (SELECT count(*) FROM o WHERE found AND starts_with(o_orderpriority, '1'))
        UNION ALL SELECT 'whole_row', count(*) FILTER (matched AND nth NOT IN (2, 3)), count(*) FROM r
        UNION ALL SELECT 'maker_finish_swaps', count(*) FILTER (matched AND nth = 2), count(*) FROM r
        UNION ALL SELECT unnest(['field_qty', 'field_description', 'field_catalog_number']), count(*) FILTER (matched), count(*) FROM r
        UNION ALL SELECT 'field_mfr', count(*) FILTER (matched AND nth NOT IN (2, 3)), count(*) FROM r)
    SELECT metric, correct, total, CAST(correct AS DOUBLE) / total AS accuracy FROM m"""

SQL["evaluation_extra_rows"] = f"""
    WITH {GOLD} SELECT o_orderkey, CAST(1 AS BIGINT) AS n, '%%%%' AS description FROM o WHERE found AND starts_with(o_orderpriority, '1')"""

SQL["grounding_failures"] = f"""
    WITH {LINES},
    plain AS (SELECT doc_id, line_no, regexp_replace(line, '[^A-Za-z0-9 ]', '', 'g') AS line FROM lines),
    rows AS (
        SELECT line_no % 3 = 0 AS away, len(list_filter(regexp_extract_all(lower(line), '[a-z0-9]+'), lambda t: length(t) >= 2)) AS n
        FROM plain WHERE regexp_matches(line, '[^ ]'))
    SELECT kind, CAST(n AS BIGINT) AS n FROM (
        SELECT 'box' AS kind, count(*) FILTER (away) AS n FROM rows
        UNION ALL SELECT 'description', count(*) FILTER (away OR n = 0) FROM rows
        UNION ALL SELECT 'raw_text', count(*) FILTER (away AND n > 0) FROM rows) WHERE n > 0"""

SQL["legend_codes"] = """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS nth FROM part),
    e AS (
        SELECT CAST(p_size AS BIGINT) AS p_size, CAST(nth // 20 + 1 AS INTEGER) AS page, CAST(nth % 20 + 2 AS INTEGER) AS line_no, 'B' || regexp_extract(p_brand, '([0-9]+)', 1) AS code,
               p_name AS description, CAST(p_partkey AS VARCHAR) AS catalog_number, p_type AS mfr FROM n)
    SELECT p_size, page, code, description, catalog_number, mfr, line_no, CAST(0.94 AS DOUBLE) AS confidence FROM e
    QUALIFY row_number() OVER (PARTITION BY p_size, page, code ORDER BY line_no DESC) = 1"""
