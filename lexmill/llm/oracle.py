"""SQL for the text queries that SQL can express over whole tables."""

from __future__ import annotations

from lexmill.functions.text import RE2_SPACE
from lexmill.functions.url import PAGE_TRACKING

_LINES = r"""
WITH c AS (
  SELECT capture_id, domain, text FROM captures
  WHERE domain <> '' AND regexp_matches(text, '[^\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')),
l AS (
  SELECT capture_id, domain, u.line_no, lower(regexp_replace(u.line, '[^\p{L}]', '', 'g')) AS k
  FROM c, (SELECT unnest(string_split(text, chr(10))) AS line,
                  CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS line_no) u),
n AS (SELECT domain, count(*) AS n FROM c GROUP BY 1),
f AS (
  SELECT l.domain, k, count(*) AS times FROM l JOIN n USING (domain) WHERE k <> ''
  GROUP BY 1, 2 HAVING count(DISTINCT capture_id) >= 5 AND count(DISTINCT capture_id) >= 0.05 * max(n))
"""

_TRACK = "^(utm_.*|" + "|".join(PAGE_TRACKING) + ")$"

_PAGES = rf"""
WITH u AS (
  SELECT *,
         regexp_replace(regexp_replace(regexp_replace(url_canonical, '^[{RE2_SPACE}]+|[{RE2_SPACE}]+$', '', 'g'), '(?s)#.*$', ''),
                        '^(https?:)?//', '', 'i') AS a
  FROM captures WHERE url_canonical IS NOT NULL),
h AS (
  SELECT *, regexp_extract(a, '^[^/?]*') AS head, substr(a, length(regexp_extract(a, '^[^/?]*')) + 1) AS rest FROM u),
k AS (
  SELECT *,
         regexp_replace(regexp_replace(lower(head), ':(80|443)?$', ''), '^www\.', '') || '|' ||
         regexp_replace(replace(regexp_extract(rest, '^[^?]*'), '%c3%a9', '%C3%A9'), '/+$', '') || '?' ||
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '(?s)\?(.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(lower(regexp_extract(p, '^[^=]*')), '{_TRACK}'))), '&') AS page,
         coalesce(len(regexp_extract_all(text, '[^{RE2_SPACE}]+')), 0) AS words
  FROM h WHERE head <> '')"""
_FILLED = lambda c: f"CASE WHEN coalesce(regexp_matches({c}, '[^{RE2_SPACE}]'), false) THEN 1.0 ELSE 0.0 END"

ORACLE = {
    "p1_found": _LINES + "SELECT capture_id, line_no FROM l JOIN f USING (domain, k)",
    "p1_report": _LINES
    + """SELECT n.domain, max(n.n) AS documents, count(f.k) AS repeated_lines, CAST(coalesce(sum(f.times), 0) AS BIGINT) AS occurrences
FROM n LEFT JOIN f USING (domain) GROUP BY 1""",
    "p4_found": _PAGES
    + """,
r AS (
  SELECT *, row_number() OVER (PARTITION BY page ORDER BY words DESC, ts DESC NULLS LAST, capture_id) AS rn,
         count(*) OVER (PARTITION BY page) AS n, min(capture_id) OVER (PARTITION BY page) AS first_capture_id
  FROM k)
SELECT first_capture_id, capture_id AS best_capture_id FROM r WHERE rn = 1 AND n > 1""",
    "p4_choices": _PAGES
    + f""",
implied AS (
  SELECT extraction_method, source AS implied FROM (
    SELECT extraction_method, source, row_number() OVER (PARTITION BY extraction_method ORDER BY count(*) DESC, source DESC) AS rn
    FROM k WHERE source <> '' AND extraction_method IS NOT NULL GROUP BY 1, 2) WHERE rn = 1),
s AS (
  SELECT page, capture_id AS id, coalesce(implied, '') AS ctie, coalesce(source, '') AS stie, greatest(coalesce(ts, 0.0), 0.0) AS recent,
         CASE WHEN words > 0 THEN 1.0 ELSE 0.0 END AS c1, CASE WHEN words > 0 THEN coalesce(trust, 0) ELSE 0 END AS c2, words AS c3,
         {_FILLED('source')} + CASE WHEN error IS NULL THEN 0.5 ELSE 0.0 END AS p1, {_FILLED('title')} AS t1, {_FILLED('title')} * coalesce(trust, 0) AS t2,
         {_FILLED('url_final')} + {_FILLED('domain')} AS a1
  FROM k LEFT JOIN implied USING (extraction_method) LEFT JOIN method_trust USING (extraction_method)),
c AS (SELECT page, ctie, id AS cid, c1, c2, c3, recent AS cr FROM (SELECT *, row_number() OVER (PARTITION BY page, ctie ORDER BY c1 DESC, c2 DESC, c3 DESC, recent DESC, id) AS rn FROM s) WHERE rn = 1),
p AS (SELECT page, stie AS ptie, id AS pid, p1, recent AS pr FROM (SELECT *, row_number() OVER (PARTITION BY page, stie ORDER BY p1 DESC, recent DESC, id) AS rn FROM s) WHERE rn = 1),
t AS (SELECT page, stie AS ttie, id AS tid, t1, t2, recent AS tr FROM (SELECT *, row_number() OVER (PARTITION BY page, stie ORDER BY t1 DESC, t2 DESC, recent DESC, id) AS rn FROM s) WHERE rn = 1),
b AS (
  SELECT page, cid, pid, tid, row_number() OVER (PARTITION BY page ORDER BY
    (ctie = '' OR ptie = '' OR ctie = ptie) AND (ptie = '' OR ttie = '' OR ptie = ttie) AND (ctie = '' OR ttie = '' OR ctie = ttie) DESC,
    c1 + p1 + t1 DESC, c2 + t2 DESC, c3 DESC, cr + pr + tr DESC, c1 DESC, c2 DESC, c3 DESC, cr DESC, cid, p1 DESC, pr DESC, pid, t1 DESC, t2 DESC, tr DESC, tid) AS rn
  FROM c JOIN p USING (page) JOIN t USING (page)),
g AS (SELECT page, count(*) AS captures, min(id) AS first_capture_id FROM s GROUP BY 1),
a AS (SELECT page, id AS address_from FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY a1 DESC, recent DESC, id) AS rn FROM s) WHERE rn = 1),
w AS (SELECT page, id AS time_from FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY recent DESC, id) AS rn FROM s) WHERE rn = 1)
SELECT captures, first_capture_id, cid AS content_from, pid AS provenance_from, tid AS title_from, address_from, time_from
FROM g JOIN a USING (page) JOIN w USING (page) JOIN b USING (page) WHERE rn = 1""",
}
