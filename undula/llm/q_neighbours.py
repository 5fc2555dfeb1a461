"""op13: near-duplicate embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undula.llm import neighbours
from undula.llm.catalogue import query, table

SQL = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS i, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT i, vec_id, v FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT a.i AS a, b.i AS b FROM s a JOIN s b ON a.i <> b.i AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT i AS a, i AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT r.a AS i, min(t.vec_id) AS component_id FROM r JOIN v t ON r.b = t.i GROUP BY r.a),
n AS (SELECT a AS i, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (i) LEFT JOIN n USING (i)"""


@query("op13_embeddings", SQL)
def op13_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf, "embeddings"))
