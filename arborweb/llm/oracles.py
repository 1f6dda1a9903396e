"""DuckDB SQL for the queries of this subpackage that SQL can express."""

MIXING = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
rate AS (SELECT source, power(n, 0.5) / sum(power(n, 0.5)) OVER () * sum(n) OVER () / n AS rate FROM n),
steps AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM rate),
facts AS (SELECT *, sum(ln(greatest(k, 1))) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS fact FROM steps),
cdf AS (SELECT source, k, sum(exp(k * ln(rate) - rate - fact)) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM facts),
draws AS (SELECT *, ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents),
counts AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(c.k) AS count, any_value(d.u) AS u
  FROM draws d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.c <= d.u GROUP BY ALL),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, count + 1))::INTEGER AS copy FROM counts)
SELECT *, ('0x' || substr(md5('42:shuffle:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS shuffle_key FROM copies
"""

_SPAM_HOST = "regexp_matches(host, 'casino|poker|bets|betting|pills|pharma|viagra|cheap|spam|porn|xxx|adult|loan|replica|track|ads-|adserver|free-|click|win-')"


def _levels() -> str:
    out = []
    for k in range(1, 5):
        out.append(
            f"s{k} AS (SELECT right(gram, {k}) AS g, sum(a) AS a, sum(r) AS r FROM counted GROUP BY 1),"
            f" o{k} AS (SELECT g, a, r, sum(a) OVER w AS ta, sum(r) OVER w AS tr, sum((a > 0)::INT) OVER w AS da, sum((r > 0)::INT) OVER w AS dr FROM s{k} WINDOW w AS (PARTITION BY left(g, {k - 1})))"
        )
    return ",\n".join(out)


def _chain(c: str) -> str:
    p = "(1.0::DOUBLE / 256)"
    for k in range(1, 5):
        p = f"CASE WHEN o{k}.t{c} > 0 THEN (o{k}.{c} + o{k}.d{c} * {p}) / (o{k}.t{c} + o{k}.d{c})::DOUBLE ELSE {p} END"
    return p


URL_FILTER = f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT page_id, host, path, host || substr(rest, length(host) + 1) AS text, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts),
texts AS (SELECT text, CASE WHEN {_SPAM_HOST} THEN 'r' ELSE 'a' END AS label, ('0x' || substr(md5(text), 1, 6))::BIGINT % 5 = 0 AS held, count(*) AS n FROM ruled GROUP BY 1, 2, 3),
padded AS (SELECT *, chr(2) || chr(2) || chr(2) || text || chr(3) AS padded FROM texts),
grams AS (SELECT text, label, held, n, substr(padded, i, 4) AS gram FROM (SELECT *, unnest(range(1, length(padded) - 2)) AS i FROM padded)),
counted AS (SELECT gram, sum(CASE WHEN label = 'a' AND NOT held THEN n ELSE 0 END) AS a, sum(CASE WHEN label = 'r' AND NOT held THEN n ELSE 0 END) AS r FROM grams GROUP BY 1),
{_levels()},
llr AS (SELECT counted.gram, ln({_chain("a")}) - ln({_chain("r")}) AS llr FROM counted
  {" ".join(f"JOIN o{k} ON o{k}.g = right(counted.gram, {k})" for k in range(1, 5))}),
scored AS (SELECT text, label, held, n, avg(llr) AS score FROM grams JOIN llr USING (gram) GROUP BY 1, 2, 3, 4),
stats AS (SELECT label, sum(n * score) / sum(n) AS m, sqrt(greatest(sum(n * score * score) / sum(n) - (sum(n * score) / sum(n)) ** 2, 0)) + 1e-9 AS s FROM scored WHERE held GROUP BY 1),
threshold AS (SELECT CASE WHEN (SELECT count(DISTINCT label) FROM scored WHERE NOT held) = 2 THEN
    (SELECT (a.m * r.s + r.m * a.s) / (a.s + r.s) FROM stats a, stats r WHERE a.label = 'a' AND r.label = 'r') END AS t)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN t IS NULL OR score >= t THEN 'allow' ELSE 'block' END AS verdict
FROM ruled JOIN scored USING (text), threshold
"""

WARC = """
WITH base AS (SELECT page_id, url, md5(page_id::VARCHAR) AS h, coalesce(html, '') AS body, '"' || substr(md5(html), 1, 16) || '"' AS etag FROM pages),
times AS (SELECT *, 1700000000 + ('0x' || substr(h, 1, 6))::BIGINT % 1000000 AS first, ('0x' || substr(h, 11, 2))::BIGINT % 8 AS e, ('0x' || substr(h, 13, 2))::BIGINT % 5 AS m FROM base),
paired AS (SELECT *, first + 500000 + ('0x' || substr(h, 7, 4))::BIGINT % 1000 AS second,
  regexp_replace(url, '#.*$', '') AS plain FROM times),
split AS (SELECT *, lower(regexp_extract(plain, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS site,
  regexp_replace(plain, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', '') AS rest FROM paired),
known AS (SELECT *, regexp_replace(regexp_replace(site, '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1')
  || regexp_replace(regexp_replace(rest, '([?&])utm_[^&]*(&|$)', '\\1', 'g'), '[?&]+$', '') AS curl FROM split),
response AS (
  SELECT page_id * 5 AS source_id, curl AS url, first AS captured, etag AS s_etag, first::VARCHAR AS s_modified, md5(body) AS s_digest, '100' AS len, etag AS h_etag, first::VARCHAR AS h_modified FROM known
  UNION ALL SELECT page_id * 5 + 1, curl, second, NULL, second::VARCHAR, md5(body || '2'), '200', NULL, second::VARCHAR FROM known),
latest AS (SELECT url, captured, max(source_id) AS source_id FROM response GROUP BY 1, 2),
revisit AS (
  SELECT page_id * 5 + 2 AS record_id, curl AS url, first + 250000 AS captured, CASE WHEN e = 0 THEN '"other"' ELSE 'W/' || etag END AS etag, NULL AS modified, 2 AS n FROM known
  UNION ALL SELECT page_id * 5 + 3, curl, second + 250000, NULL, CASE WHEN m <> 0 THEN second::VARCHAR END, 3 FROM known
  UNION ALL SELECT page_id * 5 + 4, curl, first - 10, etag, NULL, 4 FROM known),
found AS (SELECT v.*, l.source_id FROM revisit v ASOF LEFT JOIN latest l ON v.url = l.url AND v.captured > l.captured),
met AS (SELECT f.*, r.s_etag, r.s_modified, r.s_digest, r.len FROM found f LEFT JOIN response r USING (source_id)),
judged AS (SELECT *, CASE WHEN source_id IS NULL THEN 'no_response'
  WHEN etag IS NOT NULL AND s_etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = s_etag THEN 'resolved' ELSE 'mismatch' END
  WHEN modified IS NOT NULL AND s_modified IS NOT NULL THEN CASE WHEN modified = s_modified THEN 'resolved' ELSE 'mismatch' END
  ELSE 'no_validator' END AS status FROM met)
SELECT record_id, url, captured, source_id, status, CASE WHEN status = 'resolved' THEN s_digest END AS payload_digest,
  concat_ws(chr(10), 'cache-control: max-age=' || n, 'content-length: ' || CASE WHEN status = 'resolved' THEN len ELSE '0' END, 'date: ' || captured,
    'etag: ' || CASE WHEN status = 'resolved' THEN coalesce(etag, s_etag) ELSE etag END,
    'last-modified: ' || CASE WHEN status = 'resolved' THEN coalesce(modified, s_modified) ELSE modified END) AS headers
FROM judged
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
first AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN first ON first.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

#: The stored pages' text stands in one article element of paragraphs and headings, which
#: regular expressions find as well; titles are cut in the middle of a reference now and then.
MAIN_TEXT = r"""
WITH body AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '&(amp|quot)</', '&\1;</', 'g') AS body FROM pages),
blocks AS (SELECT page_id, url, regexp_split_to_array(replace(replace(replace(replace(replace(regexp_replace(body, '</?b>', '', 'g'),
  '<br>', ' '), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '</?(?:p|h1)>') AS blocks FROM body),
lines AS (SELECT page_id, url, list_filter(list_transform(blocks, lambda x: trim(regexp_replace(replace(x, '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM blocks)
SELECT page_id, url, coalesce(array_to_string(lines, chr(10)), '') AS text, length(coalesce(array_to_string(lines, chr(10)), '')) AS n_chars FROM lines
"""

#: Every word's near words by wildcard and deleted spellings, with CRC-32 computed bit by bit.
VARIANTS = r"""WITH RECURSIVE runs AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY 1, 2),
-- CRC-32 bit by bit, lowest first
coded AS (SELECT run, times, hex(encode(id || ':' || run)) AS h FROM runs),
summed AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(4 * length(h)), lambda k: (('0x' || h[2 * (k // 8) + 1 : 2 * (k // 8) + 2])::BIGINT >> (k % 8)) & 1)),
    lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1)))) AS crc FROM coded),
words AS (SELECT word, sum(times)::BIGINT AS n FROM (SELECT times, CASE WHEN crc % 31 = 0 THEN left(run, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word FROM summed)
    WHERE length(word) >= 7 GROUP BY 1 HAVING sum(times) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words),
wild AS (SELECT word, n, k, left(word, k - 1) || '*' || substr(word, k + 1) AS g FROM places),
cut AS (SELECT DISTINCT word, n, left(word, k - 1) || substr(word, k + 1) AS g FROM places),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM wild a JOIN wild b ON a.g = b.g AND a.word <> b.word
    UNION ALL SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.g = w.word UNION ALL SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.g = w.word),
near AS (SELECT word, count(*) AS n_near, min({'m': -m, 'other': other}) AS best FROM pairs GROUP BY 1),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * n THEN best.other END AS form, CASE WHEN -best.m >= 10 * n THEN -best.m END AS form_n FROM words LEFT JOIN near USING (word)),
up AS (SELECT word, word AS spot, 0 AS steps FROM forms UNION ALL SELECT up.word, f.form, steps + 1 FROM up JOIN forms f ON f.word = up.spot WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT max_by(spot, steps) FROM up WHERE up.word = f.word) AS root, n, n_near, form_n::BIGINT AS form_n FROM forms f
"""

#: All phrases counted as lists; numbers of 128 bits for the scores.
COLLOCATIONS = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda k: w[k : k + size - 1])) AS p FROM w, (VALUES (1), (2), (3)) s(size)),
f AS (SELECT lang, size, p, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE size > 1 AND f >= 10),
inner_ AS (SELECT lang, q, max(f) AS longer FROM (SELECT lang, f, unnest([p[1:2], p[2:3]]) AS q FROM c WHERE size = 3) GROUP BY 1, 2),
cuts AS (SELECT c.lang, c.p, c.f AS a, k, l.f AS l, r.f AS r, (1000000 * c.f::HUGEINT * c.f) // (l.f::HUGEINT * r.f) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.p = c.p[1 : k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1 : c.size]),
best AS (SELECT lang, p, a, min({'score': score, 'k': k, 'l': l, 'r': r}) AS cut FROM cuts GROUP BY 1, 2, 3),
ranked AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, cut.l AS l, cut.r AS r, cut.score::BIGINT AS score, row_number() OVER (PARTITION BY b.lang ORDER BY cut.score DESC, a DESC, array_to_string(b.p, ' ')) AS rank
    FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.q = b.p WHERE NOT (longer IS NOT NULL AND 100 * longer >= 50 * a))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
