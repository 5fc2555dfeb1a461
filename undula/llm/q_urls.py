"""op3: URL filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undula.llm import urls
from undula.llm.catalogue import query, table

_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in urls.RULES)
_AFTER = "CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"


def _host(u: str) -> str:
    return f"coalesce(translate(regexp_extract({_AFTER.format(u=u)}, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}'), '')"


def _path(u: str) -> str:
    return f"coalesce(regexp_extract({_AFTER.format(u=u)}, '^[^/?#]*([^?#]*)', 1), '')"


def _key(u: str) -> str:
    q = f"regexp_replace(regexp_replace(regexp_extract({_AFTER.format(u=u)}, '^[^?#]*\\?([^#]*)', 1), '{urls.TRACKING}', '', 'g'), '^&', '')"
    path = f"regexp_replace(regexp_replace({_path(u)}, '(?i)(/index)?\\.html?$', ''), '/+$', '')"
    return f"CASE WHEN {_host(u)} <> '' THEN {_host(u)} || {path} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END END"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SQL = f"""WITH RECURSIVE rules(kind, rhost, rpath) AS (VALUES {_RULES}),
p AS (SELECT row_number() OVER () AS rid, page_id, url, html, {_host('url')} AS host, {_path('url')} AS path, {_key('url')} AS key FROM pages),
fit AS (SELECT rid, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(kind, length(rhost || rpath)) AS own
        FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid),
pf AS (SELECT p.*, rule, own FROM p LEFT JOIN fit USING (rid)),
found AS (SELECT url, host, path, replace(unnest(list_concat(list_transform(regexp_extract_all(html, {_quoted(urls.CANONICAL)}), lambda t: regexp_extract(t, {_quoted(urls.HREF)}, 1)),
                 list_transform(regexp_extract_all(html, {_quoted(urls.REFRESH)}), lambda t: regexp_extract(t, {_quoted(urls.TARGET)}, 1)))), '&amp;', '&') AS link FROM p),
ab AS (SELECT url, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link WHEN starts_with(link, '/') THEN 'http://' || host || link
              ELSE 'http://' || host || CASE WHEN regexp_extract(path, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || link END AS to_url
       FROM found WHERE link <> ''),
e AS (SELECT DISTINCT {_key('url')} AS a, {_key('to_url')} AS b FROM ab),
both_ AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b UNION SELECT a, a FROM e WHERE a <> b UNION SELECT b, b FROM e WHERE a <> b),
reach AS (SELECT a, b FROM both_ UNION SELECT r.a, s.b FROM reach r JOIN both_ s ON r.b = s.a),
roots AS (SELECT a AS key, min(b) AS root FROM reach GROUP BY a),
cls AS (SELECT coalesce(root, key) AS root, bool_or(own = 'block') AS blocked, bool_or(own = 'allow') AS allowed
        FROM pf LEFT JOIN roots USING (key) WHERE key IS NOT NULL AND own IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN EXISTS (SELECT 1 FROM cls WHERE cls.root = coalesce(roots.root, pf.key) AND blocked AND NOT allowed) THEN 'block' ELSE 'allow' END) AS verdict
FROM pf LEFT JOIN roots USING (key)"""


@query("op3_urls", SQL)
def op3_urls(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judged(table(spark, sf, "pages"))
