"""Streaming runs: events arrive in three time slices, and the sink must equal the batch result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.plans.bindings import EV, ev, table, with_
from undula.plans.q_scan import scratch
from undula.plans.registry import query
from undula.session import stage
from undula.streaming import stateful


def drain(spark: SparkSession, rows: DataFrame, order: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stream ``rows`` in three slices of ``order`` and return the sink's rows.

    After each slice the query is started again from its checkpoint, so the state survives restarts.
    """
    source, sink, state = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    rows = stage(rows, "stream-rows")
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    cut = [lo + (hi - lo) * i / 3 for i in range(1, 3)]
    part = F.when(F.col(order) < F.lit(cut[0]), 0).when(F.col(order) < F.lit(cut[1]), 1).otherwise(2)
    for i in range(3):
        rows.filter(part == i).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        q = (
            run(stream)
            .writeStream.format("parquet")
            .option("path", sink)
            .option("checkpointLocation", state)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()
    return spark.read.parquet(sink)


def samples(spark: SparkSession, sf: str, value: str) -> DataFrame:
    return ev(spark, sf).select("rec_id", F.col("idx").alias("seq"), "ts", F.expr(value).cast("float").alias("value"))


SD_EV = """, sd AS (
  SELECT rec_id, idx, c0 AS xh, 0 AS ev FROM ev WHERE idx = 0
  UNION ALL
  SELECT e.rec_id, e.idx, CAST(s.xh + CAST(q.ev AS FLOAT) * 5::FLOAT AS FLOAT), q.ev FROM sd s JOIN ev e ON e.rec_id = s.rec_id AND e.idx = s.idx + 1,
  LATERAL (SELECT CASE WHEN CAST(e.c0 - s.xh AS FLOAT) > 2.5::FLOAT THEN 1 WHEN CAST(e.c0 - s.xh AS FLOAT) < -2.5::FLOAT THEN -1 ELSE 0 END AS ev) q)"""


@query("st1_sigma_delta_stream", with_(EV) + SD_EV + "SELECT rec_id, idx AS seq, ev AS event FROM sd")
def st1_sigma_delta_stream(spark: SparkSession, sf: str) -> DataFrame:
    return drain(spark, samples(spark, sf, "c0"), "ts", lambda s: stateful.sigma_delta_stream(s, ["rec_id"], "seq", 5.0, 0.5))


LC_EV = """, lc AS (
  SELECT rec_id, idx, c0 AS lv, 0 AS net FROM ev WHERE idx = 0
  UNION ALL
  SELECT e.rec_id, e.idx, CAST(l.lv + CAST(q.net AS FLOAT) * 4::FLOAT AS FLOAT), q.net FROM lc l JOIN ev e ON e.rec_id = l.rec_id AND e.idx = l.idx + 1,
  LATERAL (SELECT CAST(least(floor(CAST(abs(CAST(e.c0 - l.lv AS FLOAT)) / 4::FLOAT AS FLOAT)), 3) AS INT) * CASE WHEN e.c0 < l.lv THEN -1 ELSE 1 END AS net) q)"""


@query("st2_level_crossing_stream", with_(EV) + LC_EV + "SELECT rec_id, idx AS seq, net AS event FROM lc")
def st2_level_crossing_stream(spark: SparkSession, sf: str) -> DataFrame:
    return drain(spark, samples(spark, sf, "c0"), "ts", lambda s: stateful.level_crossing_stream(s, ["rec_id"], "seq", 4.0, 3))


LIF_EV = """, lif AS (
  SELECT rec_id, idx, CAST(c1 / 100.0::DOUBLE AS FLOAT) AS m, CAST(CAST(c1 / 100.0::DOUBLE AS FLOAT) > 1.0::FLOAT AS INT) AS s FROM ev WHERE idx = 0
  UNION ALL
  SELECT e.rec_id, e.idx, q.m, CAST(q.m > 1.0::FLOAT AS INT) FROM lif l JOIN ev e ON e.rec_id = l.rec_id AND e.idx = l.idx + 1,
  LATERAL (SELECT CAST(CAST((l.m - l.s) * 0.5::FLOAT AS FLOAT) + CAST(e.c1 / 100.0::DOUBLE AS FLOAT) AS FLOAT) AS m) q)"""


@query("st2_leaky_stream", with_(EV) + LIF_EV + "SELECT rec_id, idx AS seq, s AS spike FROM lif")
def st2_leaky_stream(spark: SparkSession, sf: str) -> DataFrame:
    return drain(spark, samples(spark, sf, "c1 / 100.0D"), "ts", lambda s: stateful.leaky_stream(s, ["rec_id"], "seq", 0.5, 1.0))


@query(
    "st3_hysteresis_stream",
    with_(EV)
    + """SELECT rec_id, idx AS seq, CAST(coalesce(last_value(CASE WHEN c1 >= 60 THEN 1 WHEN c1 <= 40 THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INT) AS state FROM ev""",
)
def st3_hysteresis_stream(spark: SparkSession, sf: str) -> DataFrame:
    return drain(spark, samples(spark, sf, "c1"), "ts", lambda s: stateful.hysteresis_stream(s, ["rec_id"], "seq", 60.0, 40.0))


@query(
    "st4_event_time_counts",
    """WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k AS start, event_type FROM events, range(2) r(k)),
c AS (SELECT start, start + INTERVAL 12 HOUR AS stop, event_type, count(*) AS n FROM w GROUP BY ALL)
SELECT CAST(epoch_us(start) AS BIGINT) AS start_us, event_type, n FROM c""",
)
def st4_event_time_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    e = e.unionByName(stateful.closing_row(e, "ts", "13 hours"))
    c = drain(spark, e, "ts", lambda s: stateful.windowed_counts(s, "ts", ["event_type"], "12 hours", "6 hours"))
    return c.select(F.unix_micros("start").alias("start_us"), "event_type", "n")
