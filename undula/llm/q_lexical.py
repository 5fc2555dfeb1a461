"""op12: ranked lexical search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undula.llm import lexical
from undula.llm.catalogue import query, table

_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical.TERM}')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce({_TERMS}, []) AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n, sum(len(t))::BIGINT AS l FROM d),
q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY item_id, term),
u AS (SELECT i, unnest(t) AS term FROM d),
p AS (SELECT i, term, count(*) AS tf FROM u SEMI JOIN q USING (term) GROUP BY i, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * (SELECT n FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term),
m AS (SELECT i, doc_id, 25 + (75 * len(t) * (SELECT n FROM s)) // (SELECT l FROM s) AS m FROM d WHERE len(t) > 0),
x AS (SELECT item_id, i, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM p JOIN w USING (term) JOIN m USING (i) JOIN q USING (term) GROUP BY item_id, i),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INT) AS rank, doc_id, score
  FROM x JOIN m USING (i) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""


@query("op12_lexical", SQL)
def op12_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.ranked(lexical.index(table(spark, sf, "documents")), lexical.query_terms(table(spark, sf, "benchmark")))
