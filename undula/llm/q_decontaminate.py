"""op9: benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undula.llm import decontaminate
from undula.llm.catalogue import query, table

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p + 1 : p + least(len(w), 10)], ' ') AS s
        FROM (SELECT *, unnest(range(greatest(len(w) - 9, 1))) AS p FROM i WHERE len(w) > 0)),
at_ AS (SELECT rid, w, unnest(range(len(w))) AS p FROM d),
occ AS (SELECT rid, p, k, item_id FROM (SELECT rid, p, kk AS k, array_to_string(w[p + 1 : p + kk], ' ') AS s FROM at_, (SELECT DISTINCT k AS kk FROM pat) WHERE p + kk <= len(w)) JOIN pat USING (k, s)),
hit AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)"""


@query("op9_decontamination", SQL)
def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.digests(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
