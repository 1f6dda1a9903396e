"""DuckDB SQL with the same results as the registered queries, where SQL has them.

The pages' markup is regular enough for regular expressions to find what the parser
finds; rows that queries render as markup are taken from their tables directly.
"""

_HREFS = """regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)"""
_TEXTS = """regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)"""
_A = f"SELECT page_id, url AS base, unnest(range(1, len({_HREFS}) + 1)) AS pos, unnest({_HREFS}) AS href, unnest({_TEXTS}) AS text FROM pages"
_SITE = "regexp_extract(base, '^(https?://[^/]+)', 1)"
_TITLE = "replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '\"'), '&amp;', '&')"
#: Titles are cut in the middle of a reference now and then: those are read without a semicolon.
_CLEAN = "regexp_matches(html, '&(a|am|amp|q|qu|quo|quot)</title>')"

_STATUS = "(200 + (event_id * 7) % 360)::INT"
_OK = "(200, 201, 202, 203, 204, 205, 206, 207, 208, 226, 304)"
_AGAIN = "(408, 425, 429, 502, 503, 504)"
_CLASS = f"CASE WHEN status_code IN {_OK} THEN 'successful' WHEN status_code IN {_AGAIN} THEN 'transient' ELSE 'persistent' END"

_PROBES = "SELECT user_id AS entry, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type <> 'error' AS ok FROM events"

_FORM = """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, pos, name, field_type, value FROM customer,
  LATERAL (VALUES (0, 'key', 'hidden', c_custkey::VARCHAR), (1, 'name', 'text', c_name), (2, 'on', 'checkbox', 'on'), (3, 'segment', 'select', c_mktsegment),
    (4, 'note', 'textarea', 'n ' || c_nationkey), (5, 'go', 'submit', '1'), (6, 'go', 'submit', '2')) f(pos, name, field_type, value)
"""

SQL = {
    "links": f"SELECT page_id, pos, href, text FROM ({_A})",
    "links_absolute": f"SELECT page_id, pos, {_SITE} || href AS url FROM ({_A})",
    "link_requests": f"""SELECT page_id::VARCHAR AS parent_id, {_SITE} || href AS url, sha256('GET ' || {_SITE} || href || '|') AS dedup_key,
        '{{"type":"link","selector":"(//a)[' || pos || ']","selector_type":"xpath","description":"link: ' || text || '"}}' AS via_json FROM ({_A})""",
    "page_title": f"SELECT page_id, CASE WHEN {_CLEAN} THEN regexp_replace({_TITLE}, '&amp$', '&') ELSE {_TITLE} END AS title FROM pages",
    "count_contract": """SELECT page_id, url, n AS actual_count, 'HTML structure mismatch for ''menu items'': expected exactly 6, found ' || n AS message
        FROM (SELECT page_id, url, len(regexp_extract_all(html, '<li>')) AS n FROM pages) WHERE n <> 6""",
    "tag_histogram": """SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) AS tag FROM pages) GROUP BY 1""",
    "nested_query": f"SELECT page_id, pos, text FROM ({_A})",
    "css_query": """SELECT page_id, regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS text FROM pages""",
    "positional": f"SELECT page_id, href FROM ({_A}) WHERE pos = 2",
    "attribute_strings": f"SELECT page_id, pos, href AS value FROM ({_A})",
    "scalar_query": "SELECT page_id, len(regexp_extract_all(html, '<li>'))::VARCHAR AS n_items FROM pages",
    "union_query": """SELECT page_id, unnest(range(1, n + 3)) AS pos, unnest(['title'] || list_transform(range(1, n + 1), lambda x: 'li') || ['footer']) AS tag
        FROM (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n FROM pages)""",
    "page_errors": """SELECT page_id, n AS n_items, CASE WHEN page_id % 28 IN (0, 7) THEN 'Failed to parse HTML: the document is empty' END AS message FROM (
        SELECT page_id, CASE WHEN page_id % 28 IN (0, 7) THEN 0 ELSE len(regexp_extract_all(CASE WHEN page_id % 28 = 21 THEN left(html, 600) ELSE html END, '<li>')) END AS n
        FROM pages WHERE page_id % 28 <> 14) WHERE n > 0 OR page_id % 28 IN (0, 7)""",
    "step_errors": """SELECT page_id::VARCHAR AS request_id, len(regexp_extract_all(html, '<li>')) + (page_id % 10 <> 0)::INT AS n_data,
        CASE WHEN page_id % 10 = 0 THEN 'ZeroDivisionError' WHEN len(regexp_extract_all(html, '<li>')) > 5 THEN 'StructureError' END AS error_class FROM pages""",
    "inner_html": "SELECT page_id, regexp_extract(html, '<nav>(.*)</nav>', 1) AS inner_html FROM pages",
    "preceding_count": f"SELECT page_id, count(*)::VARCHAR AS n FROM ({_A}) GROUP BY 1",
    "native_xpath": "SELECT s_suppkey AS suppkey, s_name AS name, s_nationkey AS nationkey FROM supplier",
    "form_fields": f"SELECT c_custkey AS page_id, 'http://forms.example.org/find' AS action, method, pos::BIGINT AS pos, name, field_type, value FROM ({_FORM})",
    "form_submit": f"""SELECT parent_id, method, url, body, sha256(CASE WHEN method = 'GET' THEN 'GET ' || url || '?' || pairs || '|' ELSE 'POST ' || url || '|' || pairs END) AS dedup_key FROM (
        SELECT c_custkey::VARCHAR AS parent_id, method, 'http://forms.example.org/find' AS url, string_agg(name || '=' || v, '&' ORDER BY pos) AS body,
        '[' || string_agg('(''' || name || ''', ''' || v || ''')', ', ' ORDER BY name) || ']' AS pairs
        FROM (SELECT *, CASE WHEN name = 'note' THEN 'changed' ELSE value END AS v FROM ({_FORM}) WHERE pos <> 5) GROUP BY 1, 2)""",
    "dedup_key": "SELECT page_id, sha256('GET ' || url || '|') AS dedup_key FROM pages",
    "frontier_dedup": f"SELECT DISTINCT {_SITE} || href AS url, sha256('GET ' || {_SITE} || href || '|') AS dedup_key FROM ({_A}) WHERE {_SITE} || href NOT IN (SELECT url FROM pages)",
    "priority_topk": "SELECT o_orderkey, left(o_orderpriority, 1)::INT AS priority FROM orders ORDER BY 2, 1 LIMIT 100",
    "resolve_requests": """SELECT page_id::VARCHAR AS parent_id, regexp_extract(url, '^(https?://[^/]+)', 1) || CASE WHEN regexp_matches(url, '^https?://[^/]+/[^/?#]+/[^/?#]+/') THEN regexp_extract(url, '^https?://[^/]+(/[^/?#]+/)', 1) ELSE '/' END || 'detail?id=7' AS url,
        url AS current_location, page_id::VARCHAR AS site, true AS key_is_new FROM pages""",
    "ancestor_depth": "WITH RECURSIVE r AS (SELECT 0::BIGINT AS id, 0::BIGINT AS depth UNION ALL SELECT o_orderkey, depth + 1 FROM r JOIN orders ON o_orderkey > 0 AND o_orderkey // 2 = id) SELECT id AS request_id, depth FROM r",
    "archive_decisions": "SELECT page_id::VARCHAR AS request_id, page_id % 3 <> 0 AS download, CASE WHEN page_id % 3 = 0 THEN 'file:/' || page_id END AS file_url FROM pages",
    "accum_chain": "SELECT c_custkey AS custkey, c_name AS customer_name, n_name AS nation_name, r_name AS region_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "requote": "SELECT page_id, url || 'A%20b%2Fc%25zz' AS url FROM pages",
    "via_roundtrip": f"SELECT page_id::VARCHAR AS parent_id, 'link' AS type, '(//a)[' || pos || ']' AS selector, 'xpath' AS selector_type, 'link: ' || text AS description FROM ({_A})",
    "http_class": f"SELECT class, count(*) AS n, count(DISTINCT status_code) AS codes FROM (SELECT status_code, {_CLASS} AS class FROM (SELECT {_STATUS} AS status_code FROM events)) GROUP BY 1",
    "outcomes": f"""SELECT CASE WHEN class = 'successful' AND event_type <> 'error' THEN 'step' WHEN class = 'transient' AND event_id % 4 + 1 < 3 THEN 'retry'
        WHEN event_id % 2 = 0 THEN 'failed_probe' ELSE 'error' END AS action, count(*) AS n
        FROM (SELECT event_id, event_type, CASE WHEN {_CLASS} = 'successful' THEN 'successful' ELSE {_CLASS} END AS class FROM (SELECT event_id, event_type, {_STATUS} AS status_code FROM events)) GROUP BY 1""",
    "incidental_glob": "SELECT page_id, url FROM pages WHERE url LIKE '%utm_source=%' AND regexp_matches(url, '[?&]utm_source=feed(&|#|$)')",
    "incidental_cardinality": "SELECT conv_id AS request_id, count(*) FILTER (role = 'user') AS actual_count FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'user') <> 1",
    "json_contains": """SELECT event_id, props FROM events WHERE json_contains(props, '{"k": 69}')""",
    "rate_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_window FROM events",
    "validate_rows": """SELECT o_orderkey, len(locs) = 0 AS valid, len(locs)::BIGINT AS n_errors, array_to_string(locs, ',') AS locs FROM (
        SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 7 = 0 OR round(o_totalprice, 2) < 1000 THEN 'price' END, CASE WHEN o_orderkey % 5 = 0 THEN 'day' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END], lambda x: x IS NOT NULL) AS locs FROM orders)""",
    "decode_text": "SELECT page_id, CASE WHEN page_id % 10 <> 0 THEN length(html) END AS n_chars, CASE WHEN page_id % 10 = 0 THEN 'Failed to decode content as utf-8' END AS error FROM pages",
    "spec_stop": f"""WITH p AS ({_PROBES}), b AS (SELECT *, n - coalesce(max(CASE WHEN ok THEN n END) OVER (PARTITION BY entry ORDER BY n), 0) AS beyond FROM p),
        s AS (SELECT entry, min(CASE WHEN beyond >= 2 THEN n END) AS stop_n FROM b GROUP BY 1)
        SELECT entry, stop_n, max(CASE WHEN ok THEN n END) AS highest_success FROM b JOIN s USING (entry) WHERE stop_n IS NULL OR n <= stop_n GROUP BY 1, 2""",
    "spec_loop": f"""WITH ok AS (SELECT entry, n, n > 3 AND coalesce(n - lag(n) OVER (PARTITION BY entry ORDER BY n) > 5, n > 5) AS unreached FROM ({_PROBES}) WHERE ok),
        reached AS (SELECT entry, n FROM (SELECT *, bool_or(unreached) OVER (PARTITION BY entry ORDER BY n) AS beyond FROM ok) WHERE NOT beyond)
        SELECT entry::VARCHAR AS entry, max(r.n) AS highest_success, true AS done FROM (SELECT DISTINCT user_id AS entry FROM events) LEFT JOIN reached r USING (entry) GROUP BY 1""",
    "spec_seeds": "SELECT c_custkey::VARCHAR AS entry, unnest(range(c_nationkey + 1, greatest(c_nationkey + 1, 20))) AS n FROM customer",
    "speculation_stream": f"""WITH p AS ({_PROBES}), b AS (SELECT *, n - coalesce(max(CASE WHEN ok THEN n END) OVER (PARTITION BY entry ORDER BY n), 0) AS beyond FROM p)
        SELECT entry::VARCHAR AS entry, max(beyond) >= 2 AS done, coalesce(min(CASE WHEN beyond >= 2 THEN n END), max(n)) AS last_n FROM b GROUP BY 1""",
    "frontier_stream": f"SELECT DISTINCT {_SITE} || href AS url, sha256('GET ' || {_SITE} || href || '|') AS dedup_key FROM ({_A})",
    "observer_rollup": """SELECT page_id, selector, n AS match_count, least(n, 3)::BIGINT AS n_samples FROM (SELECT page_id, '//li' AS selector, len(regexp_extract_all(html, '<li>')) AS n FROM pages
        UNION ALL SELECT page_id, '//p', len(regexp_extract_all(html, '<p>')) FROM pages) WHERE n > 0""",
    "observer_tree": f"""WITH items AS (SELECT page_id, {_TEXTS} AS t FROM pages), told AS (SELECT page_id, len(t) AS n, array_to_string(t, '') AS nav, t[1] AS item FROM items)
        SELECT page_id::VARCHAR AS request_id, '- //nav "menu" ✓ (1 match)' || chr(10) || '  → "' || CASE WHEN length(nav) > 100 THEN left(nav, 100) || '...' ELSE nav END || '"' || chr(10)
        || '  - .//li "items" ✓ (' || n || CASE WHEN n = 1 THEN ' match)' ELSE ' matches)' END || chr(10) || '    → "' || item || '"' || chr(10)
        || '    - a "links" ✓ (' || n || CASE WHEN n = 1 THEN ' match)' ELSE ' matches)' END || chr(10) || '      → "' || item || '"'
        || CASE WHEN page_id % 10 = 0 THEN '' ELSE chr(10) || '- nav li "few items" ' || CASE WHEN n > 5 THEN '✗ (' ELSE '✓ (' END || n || CASE WHEN n = 1 THEN ' match' ELSE ' matches' END
        || CASE WHEN n > 5 THEN ', expected max 5' ELSE '' END || ')' || chr(10) || '  → "' || item || '"' END AS tree FROM told""",
    "absolute_selector": """SELECT page_id::VARCHAR AS request_id, e AS element_id, s AS absolute_selector FROM pages, (VALUES ('selector_match_1', '//nav'), ('selector_match_2', '//nav//li'), ('selector_match_3', '//nav//li//a'),
        ('selector_match_4', 'nav li')) v(e, s) WHERE e <> 'selector_match_4' OR page_id % 10 <> 0""",
    "run_step": """SELECT c_custkey::VARCHAR AS request_id, seq::BIGINT AS seq, kind, payload FROM customer, LATERAL (VALUES
        (0, 'data', '{"key": "' || c_custkey || '", "note": "n ' || c_nationkey || '"}'),
        (1, 'request', '{"url": "/record/' || c_custkey || '", "continuation": "parse_form", "method": "GET", "priority": 3}')) v(seq, kind, payload)""",
    "parser_records": f"""WITH e AS (SELECT page_id, pos, text, substr(href, 2) AS path, length(text) AS size FROM ({_A}) WHERE page_id % 28 NOT IN (0, 7, 14, 21))
        SELECT page_id, pos AS record, CASE WHEN size BETWEEN 4 AND 8 THEN text END AS label, CASE WHEN size BETWEEN 4 AND 8 THEN path END AS path, CASE WHEN size BETWEEN 4 AND 8 THEN size END AS size,
        size BETWEEN 4 AND 8 AS valid, CASE WHEN size < 4 THEN 'label string_too_short' WHEN size > 8 THEN 'size less_than' ELSE '' END AS errors FROM e
        UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, false, CASE WHEN page_id % 28 = 21 THEN '__root__ StructureError' ELSE '__root__ page_parsing' END FROM pages WHERE page_id % 28 IN (0, 7, 21)""",
    "seed_table": """WITH o AS (SELECT o_orderkey, o_orderkey % 9 AS k, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
        SELECT o_orderkey, 'by_day' AS entry, 'request' AS kind, '/list?day=' || day AS url, NULL::BIGINT AS place, NULL AS types FROM o WHERE k < 3
        UNION ALL SELECT o_orderkey, 'by_number', 'template', greatest(o_orderkey, 1) || '-' || (o_orderkey + 2) || '-3', row_number() OVER (ORDER BY o_orderkey) - 1, NULL FROM o WHERE k IN (3, 4)
        UNION ALL SELECT o_orderkey, CASE WHEN k = 6 THEN 'by_number' WHEN k = 8 AND o_orderkey % 2 = 0 THEN 'by_name' ELSE 'by_day' END, 'error', NULL, NULL,
            CASE k WHEN 5 THEN 'day date_from_datetime_parsing' WHEN 6 THEN 'numbers value_error' WHEN 7 THEN '__root__ json_invalid' ELSE CASE WHEN o_orderkey % 2 = 0 THEN '__root__ unknown_entry' ELSE 'more extra_forbidden' END END FROM o WHERE k > 4""",
    "form_overrides": "SELECT c_custkey::VARCHAR AS parent_id, 'k=' || c_custkey || '&k=two&m=only&t=kept&new=n' AS body FROM customer",
    "link_contracts": f"""WITH n AS (SELECT page_id, page_id % 6 AS k, CASE WHEN page_id % 6 = 2 THEN 0 ELSE len({_HREFS}) END AS n FROM pages), c AS (SELECT 'StructureError' AS class, * FROM n)
        SELECT page_id, class, 'links' AS description, n::BIGINT AS actual_count FROM c WHERE n < 1 OR n > 5 UNION ALL SELECT page_id, class, 'links missing href', 1 FROM c WHERE k = 1 AND n > 1""",
    "incidental_body": """SELECT event_id, 'json' AS spec FROM events WHERE event_id % 7 <> 0 AND event_id % 2 = 0 AND event_id % 5 = 3 AND event_type = 'error'
        UNION ALL SELECT event_id, 'form' FROM events WHERE event_id % 7 <> 0 AND event_id % 2 = 1 AND user_id = 7 AND event_type = 'error'
        UNION ALL SELECT event_id, 'text' FROM events WHERE event_id % 7 <> 0 AND event_id % 2 = 1 AND user_id::VARCHAR LIKE '1%'""",
    "spec_table": """SELECT s_suppkey::VARCHAR AS spec_id, page_id FROM supplier JOIN pages ON url LIKE '%.example.' || ['com', 'net', 'org'][s_suppkey % 3 + 1] || '/' || ['en', 'de', 'fr', 'es'][s_suppkey % 4 + 1] || '/' || s_nationkey || '%'
        AND (s_suppkey % 2 = 1 OR regexp_matches(url, '[?&]utm_source=feed(&|#|$)'))""",
    "permanent_chain": """SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'custkey: ' || c_custkey || ', nation: ' || n_name || ', place: customer' ELSE 'nation: ' || n_name || ', place: nation' END || ', region: own' AS headers
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "observer_json": f"""SELECT page_id::VARCHAR AS request_id, '//nav' AS selector, len(t)::VARCHAR AS items, 'xpath' AS link_type, t[1] AS sample, 'selector_match_2' AS up, CASE WHEN page_id % 10 <> 0 THEN '5' END AS most FROM (SELECT page_id, {_TEXTS} AS t FROM pages)""",
    "failure_actions": """WITH e AS (SELECT event_id, event_type, event_id % 10 AS k, event_id % 3 + 1 AS attempt FROM events WHERE event_id % 10 < 9)
        SELECT event_id::VARCHAR AS request_id, ['DataFormatError', 'PersistentHTTPError', 'HTTPAssumptionError', 'TimeoutError_', 'IncidentalError', 'SkipRequest', 'HaltRun', 'StructureError', 'ValueError'][k + 1] AS error_class,
        CASE WHEN k IN (2, 3) AND attempt < 3 THEN 'retry' WHEN k = 5 THEN 'skip' WHEN k = 6 THEN 'halt' WHEN k = 7 AND attempt < 2 THEN 'await' ELSE 'error' END AS action,
        CASE k WHEN 0 THEN 'MenuItem: label: String should have at least 4 characters, path: Field required, size: Field required' WHEN 1 THEN 'gone' WHEN 2 THEN 'odd status' WHEN 3 THEN 'slow' WHEN 4 THEN 'two captures'
            WHEN 5 THEN 'not this' WHEN 6 THEN 'stop' WHEN 7 THEN 'HTML structure mismatch for ''text'': expected at least 1, found 0' ELSE event_type END AS said FROM e""",
    "nested_records": """WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) - 1 AS i, l_quantity > 45 AS bad FROM lineitem),
        b AS (SELECT l_orderkey, list('lines.' || i || '.quantity less_than_equal') AS bad FROM l WHERE bad GROUP BY 1),
        e AS (SELECT o_orderkey, list_sort(list_concat(CASE WHEN o_orderkey % 11 = 0 THEN ['day date_from_datetime_parsing'] ELSE [] END, coalesce(bad, []))) AS errors FROM orders LEFT JOIN b ON o_orderkey = l_orderkey)
        SELECT o_orderkey, len(errors) = 0 AS valid, len(errors)::BIGINT AS n_errors, array_to_string(errors, ',') AS found FROM e""",
    "nested_columns": """WITH l AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) - 1 AS i FROM lineitem),
        b AS (SELECT l_orderkey, list('lines.' || i || '.quantity less_than_equal') FILTER (l_quantity > 45) AS bad, count(*) AS n, max(l_quantity) AS most FROM l GROUP BY 1),
        e AS (SELECT *, list_sort(list_concat(CASE WHEN o_orderkey % 11 = 0 THEN ['day date_from_datetime_parsing'] ELSE [] END, coalesce(bad, []))) AS errors FROM orders LEFT JOIN b ON o_orderkey = l_orderkey)
        SELECT o_orderkey, len(errors) = 0 AS valid, array_to_string(errors, ',') AS found, CASE WHEN len(errors) = 0 THEN o_orderkey END AS key,
            CASE WHEN len(errors) = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN len(errors) = 0 THEN coalesce(n, 0) END AS n_lines, CASE WHEN len(errors) = 0 THEN most END AS most FROM e""",
    "stream_retries": """WITH RECURSIVE e AS (SELECT user_id AS u, epoch_us(ts::TIMESTAMP) // 1000 AS t, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS kind FROM events),
        o AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t, kind) AS n FROM e),
        r AS (SELECT DISTINCT u, 0::BIGINT AS n, NULL::BIGINT AS attempts, NULL::BIGINT AS due, NULL::BIGINT AS last, false AS done, NULL::BIGINT AS again, NULL::BIGINT AS again_at, NULL::BIGINT AS said, NULL::BIGINT AS said_at, false AS gave_up FROM o
        UNION ALL SELECT u, n, CASE WHEN fresh THEN 1 ELSE a END, CASE WHEN retry THEN t + 3600000 * (1 << (a - 1)) ELSE d END, CASE WHEN fresh OR heard THEN t ELSE l END,
            CASE WHEN fresh THEN false WHEN heard THEN NOT retry ELSE f END, again, again_at, CASE WHEN fresh THEN 1 WHEN heard AND kind = 2 AND NOT retry THEN a END, t, NOT fresh
        FROM (SELECT *, kind = 0 AND a IS NULL AS fresh, kind > 0 AND a IS NOT NULL AND NOT f AND d IS NULL AS heard, kind = 2 AND a IS NOT NULL AND NOT f AND d IS NULL AND a <= 2 AS retry
            FROM (SELECT *, CASE WHEN old THEN NULL ELSE a1 END AS a, d1 AS d, l1 AS l, f1 AND NOT old AS f
                FROM (SELECT *, coalesce(a1 IS NOT NULL AND d1 IS NULL AND t - l1 > 86400000, false) AS old
                    FROM (SELECT o.u, o.n, o.t, o.kind, coalesce(due <= o.t, false) AS fell, CASE WHEN fell THEN attempts + 1 ELSE attempts END AS a1, CASE WHEN fell THEN NULL ELSE due END AS d1,
                        CASE WHEN fell THEN due ELSE last END AS l1, done AS f1, CASE WHEN fell THEN attempts + 1 END AS again, due AS again_at FROM r JOIN o ON o.u = r.u AND o.n = r.n + 1))))),
        ends AS (SELECT arg_max(attempts, n) AS attempts, max(n) AS n, u FROM r GROUP BY u),
        late AS (SELECT r.* FROM r JOIN ends ON r.u = ends.u AND r.n = ends.n WHERE due <= (SELECT max(t) - 3600000 FROM o))
        SELECT u::VARCHAR AS dedup_key, 'send' AS decision, again AS attempt, again_at AS ms FROM r WHERE again IS NOT NULL
        UNION ALL SELECT u::VARCHAR, CASE WHEN gave_up THEN 'give up' ELSE 'send' END, said, said_at FROM r WHERE said IS NOT NULL
        UNION ALL SELECT u::VARCHAR, 'send', attempts + 1, due FROM late""",
    "step_catalog": """SELECT 'CustomerSite' AS scraper, 'parse_form' AS name, 3::BIGINT AS priority, 'utf-8' AS encoding, '["page", "response"]' AS wants""",
    "crawl": """WITH RECURSIVE r AS (SELECT min(o_orderkey) AS id FROM orders UNION SELECT o_orderkey FROM r JOIN orders ON o_orderkey > 0 AND (o_orderkey - 1) // 16 = id) SELECT id AS o_orderkey FROM r""",
    "crawl_deep": """WITH RECURSIVE r AS (SELECT 0::BIGINT AS id UNION SELECT o_orderkey FROM r JOIN orders ON o_orderkey > 0 AND (o_orderkey - 1) // 2 = id) SELECT id AS o_orderkey FROM r""",
    "crawl_retries": f"""WITH e AS (SELECT event_id, event_type, event_id % 4 AS k, status_code, {_CLASS} AS class FROM (SELECT event_id, event_type, {_STATUS} AS status_code FROM events)),
        d AS (SELECT *, CASE WHEN class = 'transient' THEN least(k + 1, 3) ELSE 1 END AS attempts, class = 'successful' OR (class = 'transient' AND k < 3) AS answered FROM e)
        SELECT event_id, attempts::BIGINT AS attempts, CASE WHEN answered AND event_type <> 'error' THEN 'step' ELSE 'error' END AS decision,
        'HTTP ' || CASE WHEN class = 'transient' AND k < 3 THEN 200 ELSE status_code END AS reason FROM d""",
    "crawl_probing": f"""WITH RECURSIVE ok AS (SELECT entry, n, n > 19 AND coalesce(n - lag(n) OVER (PARTITION BY entry ORDER BY n) > 10, n > 10) AS unreached FROM ({_PROBES}) WHERE ok),
        reached AS (SELECT entry, n FROM (SELECT *, bool_or(unreached) OVER (PARTITION BY entry ORDER BY n) AS beyond FROM ok) WHERE NOT beyond),
        o AS (SELECT DISTINCT o_orderkey AS id FROM reached JOIN orders ON o_orderkey = entry * 31 + n * 7 UNION SELECT id // 3 FROM o WHERE id > 0)
        SELECT entry::VARCHAR AS "user", n FROM reached UNION ALL SELECT '', id FROM o""",
    "rate_admit": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts::TIMESTAMP) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        r AS (SELECT event_id, user_id, n, true AS admitted, NULL::BIGINT AS older, t AS newer FROM e WHERE n = 1
        UNION ALL SELECT e.event_id, e.user_id, e.n, r.older IS NULL OR r.older <= e.t - 3600000000,
            CASE WHEN r.older IS NULL OR r.older <= e.t - 3600000000 THEN r.newer ELSE r.older END, CASE WHEN r.older IS NULL OR r.older <= e.t - 3600000000 THEN e.t ELSE r.newer END
        FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
        SELECT event_id, admitted FROM r""",
    "rate_stretches": """WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts::TIMESTAMP) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events WHERE event_id % 9 <> 0),
        r AS (SELECT event_id, event_type, n, true AS admitted, [t] AS passed FROM e WHERE n = 1
        UNION ALL SELECT e.event_id, e.event_type, e.n, coalesce(r.passed[-2] <= e.t - 1800000000, true) AND coalesce(r.passed[-5] <= e.t - 7200000000, true),
            CASE WHEN coalesce(r.passed[-2] <= e.t - 1800000000, true) AND coalesce(r.passed[-5] <= e.t - 7200000000, true) THEN list_append(r.passed, e.t)[-5:] ELSE r.passed END
        FROM r JOIN e ON e.event_type = r.event_type AND e.n = r.n + 1)
        SELECT event_id, admitted FROM r UNION ALL SELECT event_id, true FROM events WHERE event_id % 9 = 0""",
    "reseed_points": "SELECT conv_id || '/' || turn AS failed_id, conv_id || '/' || (turn - turn % 3) AS reseed_id FROM conversations WHERE role = 'assistant'",
    "speculative_requests": "SELECT '/s/' || s_suppkey AS url, true AS is_speculative, 'by_number' AS entry, s_suppkey AS n FROM supplier",
    "deferred_fields": "SELECT s_suppkey, 'captcha=solved&id=' || s_suppkey AS body FROM supplier",
    "default_headers": "SELECT s_suppkey, 'Accept: text/html, user-agent: ' || s_name AS headers FROM supplier",
    "json_api_join": "SELECT s_suppkey AS suppkey, s_name AS name, s_nationkey AS nationkey FROM supplier",
    "split_outputs": "SELECT c_custkey::VARCHAR AS parent_id, '/record/' || c_custkey AS url, 'parse_form' AS continuation, 3::BIGINT AS priority FROM customer",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
