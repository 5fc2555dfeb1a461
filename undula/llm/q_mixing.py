"""op6: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undula.llm import mixing
from undula.llm.catalogue import query, table
from undula.llm.mixing import BLOCK, LANE_KEY, LANES, PRIME, ROUND_KEYS


def _permuted(src: str, x: str, n: str, key: str, name: str) -> str:
    """SQL of mixing.permuted over ``src``; nested one level per round."""
    q = f"SELECT *, {x} AS {name} FROM {src}"
    for a, c, m, d in ROUND_KEYS:
        q = f"SELECT *, ((({key} + 1) * {m} + {d}) % {PRIME} % {n} - {name} + {n}) % {n} AS o_ FROM ({q})"
        q = f"SELECT *, (greatest({name}, o_) % {PRIME} * {a} + {c} + {key}) % {PRIME} AS h_ FROM ({q})"
        q = f"SELECT * EXCLUDE ({name}, o_, h_), CASE WHEN h_ * h_ % {PRIME} % 2 = 1 THEN o_ ELSE {name} END AS {name} FROM ({q})"
    return q


def mixed_sql(docs: str = "documents") -> str:
    return rf"""WITH sizes AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS sidx FROM s0),
s2 AS (SELECT *, CASE sidx % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM s1),
s3 AS (SELECT *, CAST((SELECT sum(source_size) FROM s2) - coalesce(sum(cap) OVER f, 0) AS DOUBLE)
              / CAST((SELECT sum(weight) FROM s2) - coalesce(sum(weight) OVER f, 0) AS DOUBLE) AS lv
       FROM s2 WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / weight, sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, coalesce((SELECT lv FROM s3 WHERE lv <= CAST(cap AS DOUBLE) / weight ORDER BY CAST(cap AS DOUBLE) / weight, sidx LIMIT 1), 0) AS level FROM s3),
s5 AS (SELECT sidx, source, source_size, least(CAST(cap AS DOUBLE), level * weight) AS target, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM s4),
s6 AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN least(floor(target * blocks / source_size + 0.5), blocks * 3) ELSE 0 END AS BIGINT) AS slots FROM s5),
j0 AS (SELECT sidx, blocks, j % blocks AS i, sidx * 4 + j // blocks AS k FROM (SELECT sidx, blocks, unnest(range(slots)) AS j FROM s6)),
j1 AS ({_permuted("j0", "i", "blocks", "k", "block")}),
used AS (SELECT sidx, block, count(*) AS times FROM j1 GROUP BY ALL),
placed AS (SELECT rid, doc_id, size, source_size, target, sidx,
       CAST(coalesce(sum(size) OVER (PARTITION BY sidx ORDER BY (coalesce((doc_id % {PRIME} + {PRIME}) % {PRIME}, 0) * {LANE_KEY} + size % {PRIME}) % {PRIME} * {LANE_KEY} % {PRIME} % {LANES}, doc_id NULLS FIRST, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_word
       FROM sizes z JOIN s6 ON z.source IS NOT DISTINCT FROM s6.source),
parts AS (SELECT *, unnest(range(first_word // {BLOCK}, (first_word + size - 1) // {BLOCK} + 1)) AS block FROM placed WHERE size > 0)
SELECT p.doc_id, p.size, p.source_size, p.target,
       CAST(coalesce((SELECT sum((least(b.first_word + b.size, (b.block + 1) * {BLOCK}) - greatest(b.first_word, b.block * {BLOCK})) * u.times)
                      FROM parts b JOIN used u ON u.sidx = b.sidx AND u.block = b.block WHERE b.rid = p.rid), 0) AS BIGINT) AS taken
FROM placed p"""


@query("op6_mixing", mixed_sql())
def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(table(spark, sf, "documents"))
