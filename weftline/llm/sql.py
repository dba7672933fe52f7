"""DuckDB SQL that gives the rows of the queries which SQL can express."""
from __future__ import annotations

from weftline.llm import urls
from weftline.llm.common import LOWER_ASCII, UPPER_ASCII


def _words(text: str) -> str:
    return (f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{UPPER_ASCII}', '{LOWER_ASCII}'), "
            r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")


DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: list_slice(w, i, i + 12))) AS g
  FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
grams AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, lens WHERE len(w) >= n),
hits AS (
  SELECT x.doc_id, x.s, x.n, win.item_id FROM (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS g FROM grams) x JOIN win ON x.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


#: The five rules as the query states them, longest first; not taken from the operator's own table.
_RULED = """
CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
     WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
     WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END"""
_JUDGED = "CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END"


def _level(name: str, key: str, parent: str, above: str) -> str:
    mean = "(SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM bysuffix)" if not above else "p.a / (p.a + p.b)"
    source = f"by{key} x" if not above else f"by{key} x JOIN {above} p ON x.{parent} = p.k"
    return f"""
{name}_m AS (SELECT x.*, {mean} AS mean FROM {source}),
{name}_w AS (SELECT CASE WHEN more > 0 AND (seen - base) / more > 0 THEN greatest({urls.LEAST_WEIGHT}, least({urls.MOST_WEIGHT}, 1 / ((seen - base) / more) - 1)) ELSE {urls.MOST_WEIGHT} END AS weight
  FROM (SELECT sum(power(bad / n - mean, 2) * n) AS seen, sum(mean * (1 - mean)) AS base, sum(mean * (1 - mean) * (n - 1)) AS more FROM {name}_m)),
{name} AS (SELECT {key} AS k, weight * mean + bad AS a, weight * (1 - mean) + n - bad AS b FROM {name}_m, {name}_w)"""


_TWO = ", ".join(f"'{s}'" for s in urls.SUFFIXES)
_LABELS = "string_split(regexp_replace(host, ':[0-9]*$', ''), '.')"
_ADDRESS = r"regexp_matches(regexp_replace(host, ':[0-9]*$', ''), '^[0-9]+(\.[0-9]+){3}$')"


def _last(n: int) -> str:
    return f"array_to_string({_LABELS}[-{n}:], '.')"


URLS = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, translate(coalesce(string_split(rest, '/')[1], ''), '{UPPER_ASCII}', '{LOWER_ASCII}') AS host,
    coalesce(substr(rest, length(string_split(rest, '/')[1]) + 1), '') AS path FROM parts),
ruled AS (SELECT *, {_JUDGED} AS judged FROM (SELECT *, {_RULED} AS rule FROM hp)),
named AS (
  SELECT *, CASE WHEN {_ADDRESS} OR len({_LABELS}) < 2 THEN {_last(4)} WHEN {_last(2)} IN ({_TWO}) THEN {_last(3)} ELSE {_last(2)} END AS domain,
    CASE WHEN {_ADDRESS} THEN {_last(4)} WHEN {_last(2)} IN ({_TWO}) THEN {_last(2)} ELSE {_last(1)} END AS suffix FROM ruled),
byhost AS (
  SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, CAST(count(*) FILTER (judged = 'block') AS DOUBLE) AS bad, CAST(count(*) AS DOUBLE) AS n
  FROM named WHERE judged IS NOT NULL AND host <> '' GROUP BY host),
bydomain AS (SELECT domain, any_value(suffix) AS suffix, sum(bad) AS bad, sum(n) AS n FROM byhost GROUP BY domain),
bysuffix AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM bydomain GROUP BY suffix),
{_level("psuffix", "suffix", "", "")},
{_level("pdomain", "domain", "suffix", "psuffix")},
{_level("phost", "host", "domain", "pdomain")},
pall AS (SELECT coalesce(sum(bad), 0) + 0.5 AS a, coalesce(sum(n), 0) - coalesce(sum(bad), 0) + 0.5 AS b FROM byhost),
post AS (
  SELECT page_id, x.host, path, rule, judged, coalesce(h.a, d.a, s.a, pall.a) AS a, coalesce(h.b, d.b, s.b, pall.b) AS b
  FROM named x LEFT JOIN phost h ON h.k = x.host LEFT JOIN pdomain d ON d.k = x.domain LEFT JOIN psuffix s ON s.k = x.suffix, pall)
SELECT page_id, host, path, rule,
  coalesce(judged, CASE WHEN a / (a + b) - {urls.DEVIATIONS} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {urls.BAD_RATE} THEN 'block' ELSE 'allow' END) AS verdict
FROM post
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest,
  CASE WHEN strlen(t) >= 1000 THEN max(page_id) OVER (PARTITION BY t) END AS chosen FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM chosen AND chosen IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM chosen THEN chosen END AS refers_to
FROM d
"""
