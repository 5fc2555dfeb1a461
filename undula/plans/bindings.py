"""The driver tables seen as sensor data, as DataFrames and as SQL text.

``ev``: short recordings, one per user; ``mr``: long six-channel recordings, one per supplier;
``wn``: fixed windows; ``iv``: annotated intervals; ``sp``: file names; ``pr``: scored rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.operators.sequence import sequence_number

CH = [f"c{i}" for i in range(6)]
ACC, GYR = CH[:3], CH[3:]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def k_of(props: str = "props"):
    return F.get_json_object(props, "$.k").cast("int")


def ev(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("rec_id"), "ts", "event_id", "event_type", "value",
        F.col("value").cast("float").alias("c0"), k_of().alias("c1"), (F.col("user_id") % 3).cast("int").alias("y"),
    )
    return sequence_number(e, ["rec_id"], ["ts", "event_id"], F.col("ts").cast("date"))


EV = """ev AS (
  SELECT user_id AS rec_id, ts, event_id, event_type, value, CAST(value AS FLOAT) AS c0,
         CAST(json_extract_string(props, '$.k') AS INT) AS c1, CAST(user_id % 3 AS INT) AS y,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx
  FROM events)"""


_MR_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


def mr_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Samples without their position, for operators that need no order."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("rec_id"), *_MR_ORDER,
        F.col("l_quantity").cast("float").alias("c0"),
        (F.col("l_extendedprice") / 1000).cast("float").alias("c1"),
        (F.col("l_discount") * 100).cast("float").alias("c2"),
        (F.col("l_tax") * 100).cast("float").alias("c3"),
        (F.col("l_partkey") % 97).cast("float").alias("c4"),
        F.col("l_linenumber").cast("float").alias("c5"),
        (F.col("l_suppkey") % 3).cast("int").alias("y"),
    )


def mr(spark: SparkSession, sf: str) -> DataFrame:
    li = sequence_number(mr_rows(spark, sf), ["rec_id"], _MR_ORDER, F.trunc(F.col("l_shipdate").cast("date"), "quarter"))
    return li.select("rec_id", "y", "idx", *CH)


MR = """mr AS (
  SELECT l_suppkey AS rec_id, CAST(l_suppkey % 3 AS INT) AS y,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
                            l_quantity, l_extendedprice) - 1 AS idx,
         CAST(l_quantity AS FLOAT) AS c0, CAST(l_extendedprice / 1000 AS FLOAT) AS c1,
         CAST(l_discount * 100 AS FLOAT) AS c2, CAST(l_tax * 100 AS FLOAT) AS c3,
         CAST(l_partkey % 97 AS FLOAT) AS c4, CAST(l_linenumber AS FLOAT) AS c5
  FROM lineitem)"""


def wn(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("win_id"), F.col("label").alias("y"), (F.col("vec_id") % 30).cast("int").alias("domain"),
        F.when(F.col("vec_id") % 10 < 7, "train").otherwise("test").alias("split"), F.array("embedding").alias("x"),
    )


WN = """wn AS (
  SELECT vec_id AS win_id, label AS y, CAST(vec_id % 30 AS INT) AS domain,
         CASE WHEN vec_id % 10 < 7 THEN 'train' ELSE 'test' END AS split, embedding AS x
  FROM embeddings)"""


def iv(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf)
    kind = F.expr(
        "CASE event_type WHEN 'purchase' THEN 'transition' WHEN 'view' THEN 'no_transition' "
        "WHEN 'click' THEN 'no_transition' WHEN 'error' THEN 'ambiguous' END"
    )
    t0 = F.col("idx") + F.lit(0.25)
    return e.select("rec_id", "y", kind.alias("kind"), t0.alias("t0"), (t0 + 1 + F.col("c1") % 5).alias("t1")).filter("kind IS NOT NULL")


IV = """iv AS (
  SELECT rec_id, y, CASE event_type WHEN 'purchase' THEN 'transition' WHEN 'view' THEN 'no_transition'
         WHEN 'click' THEN 'no_transition' WHEN 'error' THEN 'ambiguous' END AS kind,
         CAST(idx AS DOUBLE) + 0.25 AS t0, CAST(idx AS DOUBLE) + 0.25 + 1 + c1 % 5 AS t1
  FROM ev WHERE event_type IN ('purchase', 'view', 'click', 'error'))"""

_SP_NAME = """
  CASE WHEN event_id % 101 = 0 THEN 'desktop.ini'
       WHEN event_id % 13 = 0 THEN 'note_' || CAST(event_id AS STRING) || '.txt'
       WHEN event_id % 7 = 0 THEN lower(base) || '.txt'
       WHEN event_id % 11 = 0 THEN base || '.csv' ELSE base || '.txt' END"""
_SP_CODE = """
  CASE WHEN event_id % 39 < 24 THEN 'D' || lpad(CAST(event_id % 39 + 1 AS STRING), 2, '0')
       ELSE 'F' || lpad(CAST(event_id % 39 - 23 AS STRING), 2, '0') END"""


def sp(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", k_of().alias("k"))
    e = e.withColumn("subj", F.expr("'SA' || lpad(CAST(user_id % 23 + 1 AS STRING), 2, '0')"))
    e = e.withColumn("raw_code", F.expr(_SP_CODE))
    e = e.withColumn("base", F.expr("raw_code || '_' || subj || '_R0' || CAST(k % 5 + 1 AS STRING)"))
    return e.withColumn("path", F.concat(F.lit("/data/"), "subj", F.lit("/"), F.expr(_SP_NAME)))


SP = f"""sp0 AS (
  SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k,
         'SA' || lpad(CAST(user_id % 23 + 1 AS STRING), 2, '0') AS subj, {_SP_CODE} AS raw_code FROM events),
sp1 AS (SELECT *, raw_code || '_' || subj || '_R0' || CAST(k % 5 + 1 AS STRING) AS base FROM sp0),
sp AS (SELECT *, '/data/' || subj || '/' || {_SP_NAME} AS path FROM sp1)"""

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def pr(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows: truth, prediction, logits of five classes, dual labels, weights, source."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", k_of().alias("k"))
    y = F.lit(None).cast("int")
    for i, t in enumerate(EVENT_TYPES):
        y = F.when(F.col("event_type") == t, i).otherwise(y)
    logits = F.array(*[((F.col("k") * (i + 3)) % 17) / 8.0 - F.col("value") / 50.0 * i for i in range(5)])
    return e.select(
        "event_id", "user_id", "k", "value", y.alias("y_true"), (F.col("k") % 5).alias("y_pred"),
        logits.alias("logits"), ((F.col("k") - 50) / 16.0).alias("z"), (F.col("user_id") % 3).cast("int").alias("y_h1"),
        (F.col("event_id") % 3 / 2.0).alias("y_h2"), (F.col("event_id") % 2).cast("int").alias("src_h2"),
        (0.4 + 0.6 * (F.col("event_id") % 2)).alias("w_h2"),
    )


PR = """pr0 AS (
  SELECT event_id, user_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type FROM events),
pr AS (
  SELECT event_id, user_id, k, value,
         CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS y_true,
         k % 5 AS y_pred,
         [((k * (i + 3)) % 17) / 8.0::DOUBLE - value / 50.0::DOUBLE * i FOR i IN range(5)] AS logits,
         (k - 50) / 16.0::DOUBLE AS z, CAST(user_id % 3 AS INT) AS y_h1, (event_id % 3) / 2.0::DOUBLE AS y_h2,
         CAST(event_id % 2 AS INT) AS src_h2, 0.4::DOUBLE + 0.6::DOUBLE * (event_id % 2) AS w_h2
  FROM pr0)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"
