"""op5: exact top-k search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undula.llm import topk
from undula.llm.catalogue import query, table
from undula.session import stage

SQL = """WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


@query("op5_topk", SQL)
def op5_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = stage(topk.integer_vectors(table(spark, sf, "embeddings")), "vectors")
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)
