"""Segmentation, window functions, resampling and encoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.operators import encode, resample, search, segment, splits, tagging
from undula.operators.features import neighbour_context
from undula.plans.bindings import CH, EV, MR, WN, ev, mr, mr_rows, with_, wn
from undula.plans.registry import query
from undula.session import stage

EV_STRIDES = {0: 6, 1: 16, 2: 8}
WIN, HOP = 410, 205


def ev_stride():
    return segment.class_stride(F.col("y"), EV_STRIDES)


def ev_lengths(e: DataFrame) -> DataFrame:
    return segment.recording_lengths(e, ["rec_id"], "y")


_LEN = ", len AS (SELECT rec_id, y, count(*) AS n FROM {t} GROUP BY rec_id, y)"
EV_LEN, MR_LEN = _LEN.format(t="ev"), _LEN.format(t="mr")
_EV_S = "CASE y WHEN 0 THEN 6 WHEN 1 THEN 16 ELSE 8 END"
EV_STARTS = EV_LEN + f", st AS (SELECT rec_id, y, n, CAST(unnest(range(0, n - 15, {_EV_S})) AS BIGINT) AS start FROM len WHERE n >= 16)"
MR_STARTS = MR_LEN + ", st AS (SELECT rec_id, y, n, CAST(unnest(range(0, n - 409, 205)) AS BIGINT) AS start FROM len WHERE n >= 410)"


@query("w1_window_starts", with_(EV) + EV_STARTS + "SELECT rec_id, y, start FROM st")
def w1_window_starts(spark: SparkSession, sf: str) -> DataFrame:
    return segment.window_starts(ev_lengths(ev(spark, sf)), ["rec_id"], 16, ev_stride()).select("rec_id", "y", "start")


@query(
    "w2_global_peak_windows",
    with_(EV)
    + EV_STARTS
    + """, top AS (SELECT rec_id, max(greatest(abs(c0), abs(c1))) AS m FROM ev GROUP BY rec_id),
pk AS (SELECT ev.rec_id, ev.idx FROM ev JOIN top USING (rec_id) WHERE greatest(abs(c0), abs(c1)) = m)
SELECT rec_id, start FROM st WHERE y = 0 AND EXISTS (SELECT 1 FROM pk WHERE pk.rec_id = st.rec_id AND idx >= start AND idx < start + 16)""",
)
def w2_global_peak_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = stage(ev(spark, sf).filter("y = 0"), "ev")
    return segment.global_peak_starts(e, ev_lengths(e), ["rec_id"], ["c0", "c1"], 16, ev_stride(), segment.peak_grid(16, EV_STRIDES)).select("rec_id", "start")


@query(
    "w3_first_peak_windows",
    with_(EV)
    + EV_STARTS
    + """, pk AS (SELECT rec_id, min_by(idx, (-greatest(abs(c0), abs(c1)), idx)) AS p FROM ev GROUP BY rec_id),
cov AS (SELECT rec_id, start FROM st JOIN pk USING (rec_id) WHERE y = 0 AND start <= p AND p < start + 16)
SELECT rec_id, start FROM cov UNION ALL
SELECT rec_id, greatest(0, least(p - 8, n - 16)) FROM len JOIN pk USING (rec_id)
WHERE y = 0 AND n >= 16 AND rec_id NOT IN (SELECT rec_id FROM cov)""",
)
def w3_first_peak_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = stage(ev(spark, sf).filter("y = 0"), "ev")
    return segment.first_peak_starts(e, ev_lengths(e), ["rec_id"], ["c0", "c1"], 16, ev_stride()).select("rec_id", "start")


@query(
    "w4_window_counts",
    with_(EV) + EV_STARTS + "SELECT y, count(*) AS windows FROM st GROUP BY y",
)
def w4_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = segment.window_count(F.col("n"), 16, ev_stride())
    return ev_lengths(ev(spark, sf)).groupBy("y").agg(F.sum(n).alias("windows"))


def mr_windows(spark: SparkSession, sf: str) -> DataFrame:
    return segment.regular_windows(mr(spark, sf), ["rec_id"], CH, WIN, F.lit(HOP))


@query(
    "w5_window_samples",
    with_(MR)
    + MR_STARTS
    + """SELECT st.rec_id, start, count(*) AS n, max(CASE WHEN idx = start THEN c1 END) AS first_c1,
  max(CASE WHEN idx = start + 409 THEN c4 END) AS last_c4, CAST(sum(c4 * (idx - start)) AS BIGINT) AS ordered
FROM st JOIN mr ON st.rec_id = mr.rec_id AND idx >= start AND idx < start + 410 GROUP BY st.rec_id, start""",
)
def w5_window_samples(spark: SparkSession, sf: str) -> DataFrame:
    w = mr_windows(spark, sf)
    c4 = F.col("x")[4]
    ordered = F.aggregate(F.transform(c4, lambda v, i: v.cast("bigint") * i), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return w.select(
        "rec_id", "start", F.size(c4).cast("bigint").alias("n"), F.col("x")[1][0].alias("first_c1"),
        F.element_at(c4, -1).alias("last_c4"), ordered.alias("ordered"),
    )


PAD_SQL = """, pad AS (
  SELECT rec_id, idx + 410 AS p, c0, c1, c2, c3, c4, c5 FROM mr
  UNION ALL SELECT rec_id, idx + r * 205, c0, c1, c2, c3, c4, c5 FROM mr, (VALUES (0), (1)) v(r) WHERE idx < 205
  UNION ALL SELECT rec_id, idx + 205 + 410 + r * 205, c0, c1, c2, c3, c4, c5 FROM mr JOIN len USING (rec_id), (VALUES (0), (1)) v(r) WHERE idx >= n - 205),
pst AS (SELECT rec_id, y, n, CAST(unnest(range(0, n + 820 - 409, 205)) AS BIGINT) AS start FROM len WHERE n >= 410)"""


def padded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples with repeated edges, their recordings, and window starts on the padded axis."""
    m = stage(mr(spark, sf), "mr")
    rec = segment.long_enough(segment.recording_lengths(m, ["rec_id"], "y"), WIN)
    p = segment.pad_edges(m, rec, ["rec_id"], HOP, 2)
    starts = segment.window_starts(
        rec.withColumn("n0", F.col("n")).withColumn("n", F.col("n") + 4 * HOP), ["rec_id"], WIN, F.lit(HOP)
    ).withColumn("k", F.expr(f"start div {HOP}")).drop("n")
    return p, rec, starts


@query(
    "w6_padded_windows",
    with_(MR)
    + MR_LEN
    + PAD_SQL
    + """SELECT pst.rec_id, start - 410 AS start, CAST(sum(c4 * (p - start)) AS BIGINT) AS ordered, count(*) AS n
FROM pst JOIN pad ON pst.rec_id = pad.rec_id AND p >= start AND p < start + 410 GROUP BY pst.rec_id, start""",
)
def w6_padded_windows(spark: SparkSession, sf: str) -> DataFrame:
    p, _, _ = padded(spark, sf)
    w = segment.regular_windows(p, ["rec_id"], ["c4"], WIN, F.lit(HOP))
    c4 = F.col("x")[0]
    ordered = F.aggregate(F.transform(c4, lambda v, i: v.cast("bigint") * i), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return w.select("rec_id", (F.col("start") - 2 * HOP).alias("start"), ordered.alias("ordered"), F.size(c4).cast("bigint").alias("n"))


_EV_K = ", w AS (SELECT rec_id, idx, c0::DOUBLE AS a, c1::DOUBLE / 10 AS b FROM ev)"


@query(
    "w7_neighbour_context",
    with_(EV)
    + _EV_K
    + """, n AS (SELECT rec_id, idx, a, b, lag(a) OVER o AS pa, lag(b) OVER o AS pb, lead(a) OVER o AS na, lead(b) OVER o AS nb
  FROM w WINDOW o AS (PARTITION BY rec_id ORDER BY idx)),
l AS (SELECT *, abs(a) + abs(b) + 1e-6::DOUBLE AS lc, abs(pa) + abs(pb) + 1e-6::DOUBLE AS lp, abs(na) + abs(nb) + 1e-6::DOUBLE AS ln FROM n
  WHERE pa IS NOT NULL AND na IS NOT NULL)
SELECT rec_id, idx, round(a - pa, 6) AS dp0, round(nb - b, 6) AS dn1, round((a * pa + b * pb) / (lc * lp), 6) AS cp,
  round((a * na + b * nb) / (lc * ln), 6) AS cn, round(sqrt((a - pa) ** 2 + (b - pb) ** 2 + 1e-6::DOUBLE), 6) AS lp,
  round(sqrt((na - a) ** 2 + (nb - b) ** 2 + 1e-6::DOUBLE), 6) AS ln FROM l""",
)
def w7_neighbour_context(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf)
    f = e.select("rec_id", "idx", F.array(F.col("c0").cast("double"), F.col("c1") / 10.0).alias("f"))
    v = neighbour_context(f, ["rec_id"], "idx")
    at = lambda i, n: F.round(F.col("f")[i], 6).alias(n)
    return v.select("rec_id", "idx", at(2, "dp0"), at(5, "dn1"), at(6, "cp"), at(7, "cn"), at(8, "lp"), at(9, "ln"))


@query(
    "w8_inside_signal",
    with_(MR) + MR_LEN + PAD_SQL + "SELECT rec_id, start - 410 AS start FROM pst WHERE start - 410 >= 0 AND start - 410 + 410 <= n",
)
def w8_inside_signal(spark: SparkSession, sf: str) -> DataFrame:
    _, _, starts = padded(spark, sf)
    raw = starts.withColumn("start", F.col("start") - 2 * HOP)
    return segment.inside_signal(raw, WIN, F.col("n0")).select("rec_id", "start")


@query(
    "w9_moving_average",
    with_(EV)
    + """SELECT rec_id, idx, round(coalesce(sum(c0::DOUBLE) OVER (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 0) / 3, 6) AS k3,
  round(sum(c0::DOUBLE) OVER (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4, 6) AS k4 FROM ev""",
)
def w9_moving_average(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf).select("rec_id", "idx", F.col("c0").cast("double").alias("v"))
    e = tagging.moving_average(e, ["rec_id"], "idx", "v", 3, "k3")
    e = tagging.moving_average(e, ["rec_id"], "idx", "v", 4, "k4")
    return e.select("rec_id", "idx", F.round("k3", 6).alias("k3"), F.round("k4", 6).alias("k4"))


HYST_SQL = """, hy AS (
  SELECT rec_id, idx, CASE WHEN c1 >= 60 THEN 1 ELSE 0 END AS h, c1 FROM ev WHERE idx = 0
  UNION ALL SELECT e.rec_id, e.idx, CASE WHEN hy.h = 0 AND e.c1 >= 60 THEN 1 WHEN hy.h = 1 AND e.c1 <= 40 THEN 0 ELSE hy.h END, e.c1
  FROM hy JOIN ev e ON e.rec_id = hy.rec_id AND e.idx = hy.idx + 1)"""


@query("w10_hysteresis", with_(EV) + HYST_SQL + "SELECT rec_id, idx, h FROM hy")
def w10_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    e = stage(ev(spark, sf).select("rec_id", "idx", "c1"), "ev")
    return tagging.hysteresis(e, ["rec_id"], "idx", "c1", 60, 40, "h", width=32).select("rec_id", "idx", "h")


@query(
    "w11_window_statistics",
    with_(MR)
    + MR_STARTS
    + """SELECT st.rec_id, start, round(avg(c1::DOUBLE), 6) AS mean, round(stddev_pop(c1::DOUBLE), 6) AS std, max(c1) AS top
FROM st JOIN mr ON st.rec_id = mr.rec_id AND idx >= start AND idx < start + 410 GROUP BY st.rec_id, start""",
)
def w11_window_statistics(spark: SparkSession, sf: str) -> DataFrame:
    w = segment.window_statistics(mr(spark, sf), ["rec_id"], "c1", WIN, HOP)
    return w.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    "w12_order_in_class",
    with_(WN) + "SELECT win_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(win_id AS VARCHAR) || ':7'), win_id) - 1 AS rn FROM wn",
)
def w12_order_in_class(spark: SparkSession, sf: str) -> DataFrame:
    return splits.order_in_class(wn(spark, sf).select("win_id", "y"), "y", "win_id", 7)


# -- resampling ---------------------------------------------------------------------------------

GRID = """, grid AS (SELECT g, CAST(g * (63.0::DOUBLE / 319.0::DOUBLE) AS FLOAT) AS t FROM range(320) r(g)),
gl AS (SELECT g, t, CAST(floor(t) AS INT) AS lo, least(CAST(floor(t) AS INT) + 1, 63) AS hi FROM grid),
ga AS (SELECT g, lo, hi, CAST(t - CAST(lo AS FLOAT) AS FLOAT) AS a FROM gl),
up AS (SELECT win_id, y, split, g, CAST(x[lo + 1] + CAST(a * CAST(x[hi + 1] - x[lo + 1] AS FLOAT) AS FLOAT) AS FLOAT) AS v, x[lo + 1] AS held FROM wn, ga)"""


@query(
    "r1_output_length",
    with_(MR) + MR_LEN + "SELECT rec_id, greatest(CAST(round_even(n * 0.5::DOUBLE, 0) AS BIGINT), 300) AS out_len FROM len",
)
def r1_output_length(spark: SparkSession, sf: str) -> DataFrame:
    n = segment.recording_lengths(mr_rows(spark, sf), ["rec_id"])
    return n.select("rec_id", resample.output_length(F.col("n"), 0.5, 300).alias("out_len"))


def up_long(df: DataFrame) -> DataFrame:
    return df.select("win_id", F.posexplode(F.col("x")[0]).alias("g", "v"))


@query(
    "r2_resample_grid",
    with_(WN) + GRID + """SELECT g, lo, hi, a AS alpha, count(*) AS windows FROM wn, ga GROUP BY g, lo, hi, a""",
)
def r2_resample_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The grid read off each window's own resampled ramp of sample numbers.

    Beside the ramp run two saw-tooth channels that rise by 1 from even or from odd samples: after the lower
    sample of a grid point, one of them gives alpha without rounding.
    """
    n = F.size(F.col("x")[0])
    ramp = F.sequence(F.lit(0), n - 1)
    channels = [F.transform(ramp, f) for f in (lambda i: i.cast("float"), lambda i: (i % 2).cast("float"), lambda i: (1 - i % 2).cast("float"))]
    up = resample.resample_windows(wn(spark, sf).select(n.alias("n"), F.array(*channels).alias("x")), 64, 320)
    p = up.select("n", F.posexplode(F.arrays_zip(F.col("x")[0].alias("at"), F.col("x")[1].alias("even"), F.col("x")[2].alias("odd"))).alias("g", "p"))
    p = p.withColumn("lo", F.floor("p.at").cast("int"))
    p = p.withColumn("hi", F.least(F.col("lo") + 1, F.col("n") - 1)).withColumn("alpha", F.when(F.col("lo") % 2 == 0, F.col("p.even")).otherwise(F.col("p.odd")))
    return p.groupBy("g", "lo", "hi", "alpha").agg(F.count(F.lit(1)).alias("windows"))


@query("r3_linear_resample", with_(WN) + GRID + "SELECT win_id, CAST(g AS INT) AS g, v FROM up")
def r3_linear_resample(spark: SparkSession, sf: str) -> DataFrame:
    return up_long(resample.resample_windows(wn(spark, sf).select("win_id", "x"), 64, 320))


@query("r4_hold_resample", with_(WN) + GRID + "SELECT win_id, CAST(g AS INT) AS g, held AS v FROM up")
def r4_hold_resample(spark: SparkSession, sf: str) -> DataFrame:
    return up_long(resample.resample_windows(wn(spark, sf).select("win_id", "x"), 64, 320, "zoh"))


@query(
    "r5_cubic_resample",
    with_(WN)
    + """, z AS (SELECT win_id, unnest(range(64)) AS i, x FROM wn)
SELECT win_id, CAST(i AS INT) AS knot, x[i + 1] AS sample, 0.0::DOUBLE AS off FROM z""",
)
def r5_cubic_resample(spark: SparkSession, sf: str) -> DataFrame:
    """The spline at out_len 64 must return all samples themselves; the values between knots are tested
    against polynomials in the test suite."""
    w = wn(spark, sf).select("win_id", F.col("x").alias("raw"), "x")
    c = resample.resample_windows(w, 64, 64, "cubic")
    k = c.select("win_id", "raw", "x", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("knot"))
    at = F.col("knot")
    off = F.round(F.abs(F.col("x")[0][at] - F.col("raw")[0][at]).cast("double"), 5)
    return k.select("win_id", "knot", F.col("raw")[0][at].alias("sample"), off.alias("off"))


AT_SQL = """, src AS (SELECT rec_id, idx, epoch_us(ts) / 1e6::DOUBLE AS t, c0::DOUBLE AS v FROM ev),
dst AS (SELECT rec_id, idx AS target, epoch_us(ts) / 1e6::DOUBLE + (idx % 7 - 3) * 5000.0::DOUBLE AS t FROM ev),
pre AS (SELECT d.rec_id, target, d.t, s.t AS t0, s.v AS v0 FROM dst d ASOF LEFT JOIN src s ON d.rec_id = s.rec_id AND d.t >= s.t),
nxt AS (SELECT p.*, s.t AS t1, s.v AS v1 FROM pre p ASOF LEFT JOIN src s ON p.rec_id = s.rec_id AND p.t < s.t)"""


def times(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = stage(ev(spark, sf).select("rec_id", "idx", "ts", "c0"), "ev")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    src = e.select("rec_id", "idx", t.alias("t"), F.col("c0").cast("double").alias("v"))
    dst = e.select("rec_id", F.col("idx").alias("target"), (t + (F.col("idx") % 7 - 3) * 5000.0).alias("t"))
    return src, dst


# a Thomas solve of the not-a-knot spline, forward over the samples and back again
SPLINE_SQL = """, kn AS (SELECT rec_id, idx AS i, t, v, count(*) OVER (PARTITION BY rec_id) AS n, t - lag(t) OVER o AS h0, lead(t) OVER o - t AS h1,
  (lead(v) OVER o - v) / (lead(t) OVER o - t) - (v - lag(v) OVER o) / (t - lag(t) OVER o) AS bend FROM src
  WINDOW o AS (PARTITION BY rec_id ORDER BY idx)),
co AS (SELECT rec_id, i, n, 6 * bend AS r, CASE WHEN i = 1 THEN 0 WHEN i = n - 2 THEN h0 - h1 * h1 / h0 ELSE h0 END AS a,
  2 * (h0 + h1) + CASE WHEN i = 1 THEN h0 + h0 * h0 / h1 ELSE 0 END + CASE WHEN i = n - 2 THEN h1 + h1 * h1 / h0 ELSE 0 END AS b,
  CASE WHEN i = n - 2 THEN 0 WHEN i = 1 THEN h1 - h0 * h0 / h1 ELSE h1 END AS c FROM kn WHERE i BETWEEN 1 AND n - 2),
fw AS (SELECT rec_id, i, n, c / b AS p, r / b AS q FROM co WHERE i = 1
  UNION ALL SELECT co.rec_id, co.i, co.n, c / (b - a * p), (r - a * q) / (b - a * p) FROM fw JOIN co ON co.rec_id = fw.rec_id AND co.i = fw.i + 1),
bw AS (SELECT rec_id, i, q AS m FROM fw WHERE i = n - 2
  UNION ALL SELECT fw.rec_id, fw.i, q - p * m FROM bw JOIN fw ON fw.rec_id = bw.rec_id AND fw.i = bw.i - 1),
mm AS (FROM bw UNION ALL
  SELECT rec_id, 0, max(CASE WHEN i = 1 THEN m * (1 + h0 / h1) END) - max(CASE WHEN i = 2 THEN m END) * max(CASE WHEN i = 1 THEN h0 / h1 END) FROM bw JOIN kn USING (rec_id, i) GROUP BY rec_id
  UNION ALL SELECT rec_id, max(n) - 1, max(CASE WHEN i = n - 2 THEN m * (1 + h1 / h0) END) - max(CASE WHEN i = n - 3 THEN m END) * max(CASE WHEN i = n - 2 THEN h1 / h0 END)
  FROM bw JOIN kn USING (rec_id, i) GROUP BY rec_id),
sg AS (SELECT rec_id, i, t, v, m, lead(t) OVER o AS t1, lead(v) OVER o AS v1, lead(m) OVER o AS m1 FROM kn JOIN mm USING (rec_id, i) WINDOW o AS (PARTITION BY rec_id ORDER BY i)),
cu AS (SELECT d.rec_id, target, (d.t - s.t) / (s.t1 - s.t) AS b, s.t1 - s.t AS h, s.v AS v0, s.v1, s.m AS m0, s.m1 FROM dst d JOIN
  (SELECT rec_id, target, least(coalesce(max(i) FILTER (src_t <= t), 0), max(n) - 2) AS i
   FROM (SELECT d.rec_id, d.target, d.t, kn.i, kn.t AS src_t, kn.n FROM dst d JOIN kn USING (rec_id)) GROUP BY rec_id, target) USING (rec_id, target) JOIN sg s USING (rec_id, i)),
cv AS (SELECT rec_id, target, (1 - b) * v0 + b * v1 + (((1 - b) * (1 - b) * (1 - b) - (1 - b)) * m0 + (b * b * b - b) * m1) * h * h / 6 AS cubic FROM cu)"""


@query(
    "r6_at_times",
    with_(EV)
    + AT_SQL
    + """SELECT rec_id, target, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE (v1 - v0) / (t1 - t0) * (t - t0) + v0 END, 6) AS v FROM nxt""",
)
def r6_at_times(spark: SparkSession, sf: str) -> DataFrame:
    src, dst = times(spark, sf)
    out = resample.at_times(src, dst, ["rec_id"], "t", "v", "idx", width=86_400.0)
    return out.select("rec_id", "target", F.round("v", 6).alias("v"))


@query(
    "r6_cubic_at_times",
    with_(EV) + AT_SQL + SPLINE_SQL + "SELECT rec_id, target, round(sign(cubic) * ln(1 + abs(cubic)), 4) + 0 AS log_v FROM cv",
)
def r6_cubic_at_times(spark: SparkSession, sf: str) -> DataFrame:
    """On a log scale, since values outside the samples grow with the cube of the time."""
    src, dst = times(spark, sf)
    out = resample.at_times(src, dst, ["rec_id"], "t", "v", "idx", width=86_400.0, method="cubic")
    return out.select("rec_id", "target", (F.round(F.signum("v") * F.log1p(F.abs("v")), 4) + 0.0).alias("log_v"))


@query("j8_as_of_lookup", with_(EV) + AT_SQL + "SELECT rec_id, target, coalesce(v0, v1) AS v FROM nxt")
def j8_as_of_lookup(spark: SparkSession, sf: str) -> DataFrame:
    src, dst = times(spark, sf)
    return resample.at_times(src, dst, ["rec_id"], "t", "v", "idx", width=86_400.0, method="zoh").select("rec_id", "target", "v")


@query(
    "r7_resample_error",
    with_(WN)
    + GRID
    + """, e AS (SELECT y, v::DOUBLE AS a, held::DOUBLE AS b FROM up)
SELECT y, round(avg(abs(a - b)), 9) AS mae, round(avg((a - b) * (a - b)), 9) AS mse,
  round(sum((a - b) * (a - b)) / greatest(sum(a * a), 1e-12::DOUBLE), 9) AS rel_err FROM e GROUP BY y""",
)
def r7_resample_error(spark: SparkSession, sf: str) -> DataFrame:
    w = wn(spark, sf).select("y", F.col("x").alias("raw"), "x")
    lin = resample.resample_windows(w, 64, 320).withColumnRenamed("x", "lin").withColumnRenamed("raw", "x")
    both = resample.resample_windows(lin, 64, 320, "zoh")
    pairs = both.select("y", F.explode(F.arrays_zip(F.col("lin")[0].alias("a"), F.col("x")[0].alias("b"))).alias("p"))
    pairs = pairs.select("y", F.col("p.a").cast("double").alias("a"), F.col("p.b").cast("double").alias("b"))
    e = resample.resample_error(pairs, "a", "b", ["y"])
    return e.select("y", *[F.round(c, 9).alias(c) for c in ("mae", "mse", "rel_err")])


# -- encoders -----------------------------------------------------------------------------------

SD_SQL = """, sd AS (
  SELECT win_id, 0 AS g, x[1] AS xh, 0 AS ev FROM wn
  UNION ALL
  SELECT d.win_id, d.g + 1, CAST(d.xh + CAST(e.ev AS FLOAT) * 0.1::FLOAT AS FLOAT), e.ev
  FROM sd d JOIN up u ON u.win_id = d.win_id AND u.g = d.g + 1,
  LATERAL (SELECT CASE WHEN CAST(u.v - d.xh AS FLOAT) > CAST(0.5::FLOAT * 0.1::FLOAT AS FLOAT) THEN 1
                       WHEN CAST(u.v - d.xh AS FLOAT) < -CAST(0.5::FLOAT * 0.1::FLOAT AS FLOAT) THEN -1 ELSE 0 END AS ev) e)"""
UP = ("linear",)


def encoded(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return encode.encode_windows(wn(spark, sf), 0.1, 0.5, resample=(64, 320, "linear"), **kw)


@query(
    "e1_default_step",
    with_(MR)
    + "SELECT rec_id, "
    + ", ".join(f"round(CAST(greatest(1e-6::DOUBLE, 0.1::DOUBLE * stddev_pop({c}::DOUBLE)) AS FLOAT)::DOUBLE, 5) AS {c}" for c in CH)
    + " FROM mr GROUP BY rec_id",
)
def e1_default_step(spark: SparkSession, sf: str) -> DataFrame:
    d = encode.default_step(mr_rows(spark, sf), ["rec_id"], CH)
    return d.select("rec_id", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in CH])


@query(
    "e2_sigma_delta",
    with_(WN) + GRID + SD_SQL + "SELECT win_id, 0 AS channel, CAST(g AS INT) AS t, ev AS n FROM sd WHERE ev <> 0",
)
def e2_sigma_delta(spark: SparkSession, sf: str) -> DataFrame:
    return encode.event_table(encoded(spark, sf).select("win_id", "events"), "win_id")


@query(
    "e3_reconstruction",
    with_(WN) + GRID + SD_SQL + "SELECT win_id, CAST(g AS INT) AS g, xh AS v, last_value(xh) OVER (PARTITION BY win_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS state FROM sd",
)
def e3_reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    e = encoded(spark, sf, trace=True)
    return e.select("win_id", F.posexplode(F.col("recon")[0]).alias("g", "v"), F.col("state")[0].alias("state"))


LC_SQL = """, lc AS (
  SELECT win_id, 1 AS i, x[1] AS lv, 0 AS net FROM wn
  UNION ALL
  SELECT l.win_id, l.i + 1, CAST(l.lv + CAST(e.net AS FLOAT) * 0.05::FLOAT AS FLOAT), e.net
  FROM lc l JOIN wn w ON w.win_id = l.win_id AND l.i < 64,
  LATERAL (SELECT CAST(w.x[l.i + 1] - l.lv AS FLOAT) AS d) q,
  LATERAL (SELECT CAST(least(floor(CAST(abs(d) / 0.05::FLOAT AS FLOAT)), 4) AS INT) * CASE WHEN d < 0 THEN -1 ELSE 1 END AS net) e)"""


@query("e4_level_crossing", with_(WN) + LC_SQL + "SELECT win_id, i - 1 AS t, net AS n FROM lc WHERE net <> 0")
def e4_level_crossing(spark: SparkSession, sf: str) -> DataFrame:
    w = wn(spark, sf).select("win_id", "x")
    return encode.event_table(encode.encode_windows(w, 0.05, kind="level_crossing", cap=4), "win_id").drop("channel")


@query("e5_window_offset", with_(WN) + "SELECT win_id, x[1] AS off FROM wn")
def e5_window_offset(spark: SparkSession, sf: str) -> DataFrame:
    """The offset that the encoder emits with its events."""
    return encode.encode_windows(wn(spark, sf).select("win_id", "x"), 0.05).select("win_id", F.col("offset")[0].alias("off"))


@query(
    "e7_fixed_window_events",
    with_(WN)
    + GRID
    + SD_SQL
    + """SELECT split, y, count(*) AS windows, CAST(sum(up) AS BIGINT) AS n_up, CAST(sum(dn) AS BIGINT) AS n_down, round(avg(state::DOUBLE), 6) AS state FROM (
  SELECT split, y, win_id, count_if(ev = 1) AS up, count_if(ev = -1) AS dn, max(CASE WHEN g = 319 THEN xh END) AS state
  FROM sd JOIN wn USING (win_id) GROUP BY split, y, win_id) GROUP BY split, y""",
)
def e7_fixed_window_events(spark: SparkSession, sf: str) -> DataFrame:
    e = encoded(spark, sf)
    return e.groupBy("split", "y").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("n_up").alias("n_up"), F.sum("n_down").alias("n_down"),
        F.round(F.avg(F.col("state")[0].cast("double")), 6).alias("state"),
    )


@query(
    "e8_event_counts",
    with_(WN) + GRID + SD_SQL + "SELECT win_id, count_if(ev <> 0) AS n_events, round(count_if(ev <> 0) / 640.0::DOUBLE, 9) AS density FROM sd GROUP BY win_id",
)
def e8_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(spark, sf).select("win_id", "n_events", F.round(F.col("n_events") / 640.0, 9).alias("density"))


@query(
    "r8_rebin_events",
    with_(WN)
    + GRID
    + SD_SQL
    + """, ev0 AS (SELECT win_id, g AS t, ev AS n FROM sd WHERE ev <> 0),
b1 AS (SELECT 'sum' AS how, win_id, t // 5 AS bin, CAST(sum(n) AS DOUBLE) AS n FROM ev0 GROUP BY ALL),
bins AS (SELECT i, i * 320 // 48 AS a, ((i + 1) * 320 + 47) // 48 AS b FROM range(48) r(i)),
b2 AS (SELECT 'mean', win_id, i, CAST(sum(n) AS DOUBLE) / (b - a) * (320.0::DOUBLE / 48) FROM ev0 JOIN bins ON t >= a AND t < b GROUP BY win_id, i, a, b),
b3 AS (SELECT 'nearest', win_id, j, CAST(n AS DOUBLE) FROM ev0 JOIN range(500) r(j) ON j * 320 // 500 = t)
SELECT how, win_id, CAST(bin AS BIGINT) AS bin, round(n, 9) AS n FROM (FROM b1 UNION ALL FROM b2 UNION ALL FROM b3)""",
)
def r8_rebin_events(spark: SparkSession, sf: str) -> DataFrame:
    e = encode.event_table(encoded(spark, sf).select("win_id", "events"), "win_id")
    parts = []
    for how, target in (("sum", 64), ("mean", 48), ("nearest", 500)):
        r = resample.rebin_events(e, ["win_id"], 320, target)
        parts.append(r.select(F.lit(how).alias("how"), "win_id", F.col("bin").cast("bigint"), F.round(F.col("n").cast("double"), 9).alias("n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "a20_event_statistics",
    with_(WN)
    + GRID
    + SD_SQL
    + """, pw AS (SELECT win_id, y, count_if(ev <> 0)::DOUBLE AS n FROM sd JOIN wn USING (win_id) GROUP BY win_id, y),
st AS (SELECT y, avg(n) AS m, stddev_pop(n) AS s, count(*) AS c FROM pw GROUP BY GROUPING SETS ((y), ()))
SELECT v.y, v.name, round(coalesce(m, 0), 6) AS mean, round(coalesce(s, 0), 6) AS std, coalesce(c, 0) AS n
FROM (SELECT CAST(i AS INT) AS y, 'class' || i AS name FROM range(12) r(i) UNION ALL SELECT NULL, 'global') v
LEFT JOIN st ON st.y IS NOT DISTINCT FROM v.y""",
)
def a20_event_statistics(spark: SparkSession, sf: str) -> DataFrame:
    s = search.event_statistics(encoded(spark, sf).select("y", "n_events"), {i: f"class{i}" for i in range(12)})
    return s.select("y", "name", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


LIF_SQL = """, sig AS (SELECT rec_id, idx, CAST(c1 / 100.0::DOUBLE AS FLOAT) AS i FROM ev),
lif AS (
  SELECT rec_id, 15 AS last, idx, m, s FROM (SELECT rec_id, idx, i AS m, CAST(i > 1.0 AS INT) AS s FROM sig WHERE idx = 0)
  UNION ALL
  SELECT e.rec_id, 15, e.idx, q.m, CAST(q.m > 1.0::FLOAT AS INT)
  FROM lif l JOIN sig e ON e.rec_id = l.rec_id AND e.idx = l.idx + 1,
  LATERAL (SELECT CAST(CAST((CASE WHEN e.idx % 16 = 0 THEN 0 ELSE l.m - l.s END) * 0.5::FLOAT AS FLOAT) + e.i AS FLOAT) AS m) q)"""


def ev_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Complete runs of 16 samples per recording as packed rows."""
    e = ev(spark, sf)
    x = F.sort_array(F.collect_list(F.struct("idx", (F.col("c1") / 100.0).cast("float").alias("v"))))
    b = e.groupBy("rec_id", F.expr("idx div 16").alias("block")).agg(x.alias("s")).filter(F.size("s") == 16)
    return b.select("rec_id", "block", F.array(F.col("s.v")).alias("x"))


@query(
    "m10_leaky_accumulator",
    with_(EV)
    + EV_LEN
    + LIF_SQL
    + """SELECT rec_id, idx, s FROM lif JOIN len USING (rec_id) WHERE (idx // 16 + 1) * 16 <= n""",
)
def m10_leaky_accumulator(spark: SparkSession, sf: str) -> DataFrame:
    s = encode.leaky_accumulate(ev_blocks(spark, sf), 0.5, 1.0)
    return s.select("rec_id", "block", F.posexplode(F.col("spikes")[0]).alias("i", "v")).select(
        "rec_id", (F.col("block") * 16 + F.col("i")).alias("idx"), F.col("v").cast("int").alias("s")
    )


@query(
    "m11_firing_rate",
    with_(EV)
    + EV_LEN
    + LIF_SQL
    + """SELECT rec_id, idx // 16 AS block, round(avg(s), 9) AS rate FROM lif JOIN len USING (rec_id) WHERE (idx // 16 + 1) * 16 <= n GROUP BY ALL""",
)
def m11_firing_rate(spark: SparkSession, sf: str) -> DataFrame:
    s = encode.leaky_accumulate(ev_blocks(spark, sf), 0.5, 1.0)
    return s.select("rec_id", "block", F.round(F.col("rate")[0], 9).alias("rate"))
