"""Interval joins, window features, tagging, dual-label event data and threshold search."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.operators import features, intervals, search, segment, tagging
from undula.operators.intervals import coverage_score
from undula.plans import jobs
from undula.plans.bindings import CH, EV, IV, MR, PR, WN, ev, iv, mr, mr_rows, pr, with_, wn
from undula.plans.q_window import EV_LEN, GRID, MR_LEN, PAD_SQL
from undula.plans.registry import query
from undula.session import stage, times_cleared

WIN, HOP = 16, 8
KINDS = ("transition", "no_transition", "ambiguous")

GRID_STARTS = EV_LEN + ", st AS (SELECT rec_id, y, n, CAST(unnest(range(0, n - 15, 8)) AS BIGINT) AS start FROM len WHERE n >= 16)"
# Brute force: mark every sample, then look at the samples of each window.
MARKS = """, rg AS (SELECT rec_id, kind, greatest(0, CAST(floor(t0) AS BIGINT)) AS a, CAST(ceil(t1) AS BIGINT) AS b FROM iv),
smp AS (SELECT rec_id, idx FROM ev),
mk AS (SELECT s.rec_id, s.idx, bool_or(kind = 'transition') AS tr, bool_or(kind = 'no_transition') AS no, bool_or(kind = 'ambiguous') AS am
  FROM smp s LEFT JOIN rg ON rg.rec_id = s.rec_id AND s.idx >= a AND s.idx < b GROUP BY s.rec_id, s.idx),
cov AS (SELECT st.rec_id, st.y, start, count_if(tr) AS tr, count_if(no) AS no, count_if(am) AS am,
    max(CASE WHEN idx = start + 8 AND tr THEN 1 ELSE 0 END) AS mid, quantile_cont(CASE WHEN tr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 0.8) AS qt,
    quantile_cont(CASE WHEN no THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 0.8) AS qn
  FROM st JOIN mk ON mk.rec_id = st.rec_id AND idx >= start AND idx < start + 16 GROUP BY st.rec_id, st.y, start)"""
# All intervals, each of the kind of the block of 32 samples that it starts in, few undecided: so clear windows appear.
BLOCK_KIND = (
    "CASE WHEN floor(t0) % 64 = 3 THEN 'ambiguous' WHEN floor(floor(t0) / 32) % 2 = 0 THEN 'transition' ELSE 'no_transition' END"
)
GAUSS = """, gs AS (SELECT e.rec_id, e.idx, coalesce(max(exp(-0.5::DOUBLE * ((idx - (t0 + t1) / 2) / greatest((t1 - t0) * 0.4::DOUBLE, 1.0)) ** 2)), 0) AS g
  FROM ev e LEFT JOIN iv i ON i.rec_id = e.rec_id AND i.kind = 'transition' AND e.idx >= t0 AND e.idx <= t1 GROUP BY e.rec_id, e.idx),
gw AS (SELECT st.rec_id, start, avg(g) AS g_mean, max(g) AS g_max, max(CASE WHEN idx = start + 8 THEN g END) AS g_mid, quantile_cont(g, 0.8) AS g_q
  FROM st JOIN gs ON gs.rec_id = st.rec_id AND idx >= start AND idx < start + 16 GROUP BY st.rec_id, start)"""


def ev_grid(spark: SparkSession, sf: str) -> DataFrame:
    rec = segment.recording_lengths(ev(spark, sf), ["rec_id"], "y")
    return segment.window_starts(rec, ["rec_id"], WIN, F.lit(HOP)).select("rec_id", "y", "start")


def spans_of(spark: SparkSession, sf: str) -> DataFrame:
    """The intervals as a table: merging reads them twice."""
    return stage(iv(spark, sf), "spans")


def covered(spark: SparkSession, sf: str) -> DataFrame:
    ranges = intervals.sample_ranges(spans_of(spark, sf), 1.0)
    return intervals.window_coverage(ev_grid(spark, sf), ranges, ["rec_id"], WIN, HOP, KINDS)


@query(
    "u3_merged_intervals",
    with_(EV, IV)
    + """, rg AS (SELECT rec_id, kind, greatest(0, CAST(floor(t0) AS BIGINT)) AS a, CAST(ceil(t1) AS BIGINT) AS b FROM iv),
o AS (SELECT *, max(b) OVER (PARTITION BY rec_id, kind ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rg),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, kind ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT rec_id, kind, min(a) AS a, max(b) AS b FROM g GROUP BY rec_id, kind, island""",
)
def u3_merged_intervals(spark: SparkSession, sf: str) -> DataFrame:
    ranges = intervals.sample_ranges(spans_of(spark, sf), 1.0)
    return intervals.merge_ranges(ranges, ["rec_id", "kind"], width=32)


@query(
    "j1_window_coverage",
    with_(EV, IV)
    + GRID_STARTS
    + MARKS
    + """SELECT rec_id, start, round(tr / 16.0::DOUBLE, 9) AS mean, CAST(mid AS DOUBLE) AS center, CAST(tr > 0 AS INT)::DOUBLE AS max, round(qt, 9) AS q,
  round(am / 16.0::DOUBLE, 9) AS ambiguous FROM cov""",
)
def j1_window_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = covered(spark, sf)
    modes = [F.round(coverage_score("transition", WIN, m), 9).alias(m) for m in intervals.MODES]
    return c.select("rec_id", "start", *modes, F.round(coverage_score("ambiguous", WIN, "mean"), 9).alias("ambiguous"))


@query(
    "j2_gaussian_scores",
    with_(EV, IV)
    + GRID_STARTS
    + GAUSS
    + "SELECT rec_id, start, round(g_mean, 6) AS mean, round(g_max, 6) AS max, round(g_mid, 6) AS center, round(g_q, 6) AS q FROM gw",
)
def j2_gaussian_scores(spark: SparkSession, sf: str) -> DataFrame:
    tr = iv(spark, sf).filter("kind = 'transition'")
    g = intervals.gaussian_scores(ev_grid(spark, sf), tr, ["rec_id"], 1.0, WIN, HOP, {m: m for m in intervals.MODES})
    return g.select("rec_id", "start", *[F.round(m, 6).alias(m) for m in intervals.MODES])


@query(
    "j3_label_match",
    with_(EV)
    + """, len AS (SELECT rec_id, y, count(*) AS n FROM ev GROUP BY rec_id, y),
lb AS (SELECT DISTINCT rec_id + CASE WHEN rec_id % 5 = 0 THEN 1000000 ELSE 0 END AS rec_id FROM ev)
SELECT coalesce(CASE WHEN n IS NULL THEN 'not_found' WHEN y <> 2 THEN 'non_static' WHEN n < 60 THEN 'too_short' END, 'used') AS reject, count(*) AS n
FROM lb LEFT JOIN len USING (rec_id) GROUP BY 1""",
)
def j3_label_match(spark: SparkSession, sf: str) -> DataFrame:
    rec = segment.recording_lengths(ev(spark, sf), ["rec_id"], "y").withColumn("file", F.col("rec_id").cast("string"))
    shift = F.when(F.col("rec_id") % 5 == 0, 1_000_000).otherwise(0)
    labels = rec.select((F.col("rec_id") + shift).cast("string").alias("file")).distinct()
    m = intervals.match_labels(rec.drop("rec_id"), labels, 60)
    return m.groupBy(F.coalesce("reject", F.lit("used")).alias("reject")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "m5_manual_labels",
    with_(EV, IV)
    + GRID_STARTS
    + MARKS
    + GAUSS
    + """SELECT rec_id, start, round(g_q, 6) AS pt, round(g_max, 6) AS pt_max, round(no / 16.0::DOUBLE, 6) AS sp, round(am / 16.0::DOUBLE, 6) AS amb,
  CASE WHEN g_q >= 0.5 THEN 1.0::DOUBLE WHEN no / 16.0::DOUBLE >= 0.6 AND am / 16.0::DOUBLE < 0.25 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS y_win
FROM cov JOIN gw USING (rec_id, start) WHERE y = 2""",
)
def m5_manual_labels(spark: SparkSession, sf: str) -> DataFrame:
    spans = spans_of(spark, sf).filter("y = 2")
    grid = ev_grid(spark, sf).filter("y = 2")
    m = jobs.manual_tags(grid, spans, ["rec_id"], 1.0, WIN, HOP)
    return m.select("rec_id", "start", *[F.round(c, 6).alias(c) for c in ("pt", "pt_max", "sp", "amb")], "y_win")


@query(
    "m6_training_rows",
    with_(EV, IV)
    + GRID_STARTS
    + MARKS.replace("SELECT rec_id, kind,", f"SELECT rec_id, {BLOCK_KIND} AS kind,", 1)
    + """, c AS (SELECT rec_id, start, qt, qn, tr / 16.0::DOUBLE AS pt, no / 16.0::DOUBLE AS sp, am / 16.0::DOUBLE <= 0.1 AS sure FROM cov WHERE y = 2)
SELECT rec_id, start, qt >= 0.5 AND qn <= 0.05 AND sure AS clear_pt, qn >= 0.6 AND qt <= 0.05 AND sure AS clear_sp,
  pt >= 0.5 AND sp <= 0.05 AND sure AS mean_pt, sp >= 0.6 AND pt <= 0.05 AND sure AS mean_sp FROM c""",
)
def m6_training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every window of the static recordings, and whether it is clearly of a kind by quantile and by mean coverage."""
    ranges = intervals.sample_ranges(blocked_spans(spark, sf), 1.0)
    c = stage(intervals.window_coverage(ev_grid(spark, sf).filter("y = 2"), ranges, ["rec_id"], WIN, HOP, KINDS), "covered")
    at, out = ["rec_id", "start"], c.select("rec_id", "start")
    for mode, name in (("q", "clear"), ("mean", "mean")):
        clear = jobs.clear_rows(c, WIN, mode).select(*at, F.col("clear_pt").alias(f"{name}_pt"), F.col("clear_sp").alias(f"{name}_sp"))
        out = out.join(clear, at, "left")
    return out.fillna(False)


def blocked_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Every interval, with the kind of its block."""
    return spans_of(spark, sf).withColumn("kind", F.expr(BLOCK_KIND))


@query(
    "m6_all_intervals",
    with_(EV, IV)
    + GRID_STARTS
    + MARKS.replace("SELECT rec_id, kind,", f"SELECT rec_id, {BLOCK_KIND} AS kind,", 1)
    + """, c AS (SELECT rec_id, start, qt >= 0.5 AND qn <= 0.05 AND am / 16.0::DOUBLE <= 0.1 AS clear_pt, qn >= 0.6 AND qt <= 0.05 AND am / 16.0::DOUBLE <= 0.1 AS clear_sp FROM cov WHERE y = 2)
SELECT * FROM c WHERE clear_pt OR clear_sp""",
)
def m6_all_intervals(spark: SparkSession, sf: str) -> DataFrame:
    ranges = intervals.sample_ranges(blocked_spans(spark, sf), 1.0)
    c = intervals.window_coverage(ev_grid(spark, sf).filter("y = 2"), ranges, ["rec_id"], WIN, HOP, KINDS)
    return jobs.clear_rows(c, WIN, "q").select("rec_id", "start", "clear_pt", "clear_sp")


# -- features -----------------------------------------------------------------------------------

PADDED = MR_LEN + PAD_SQL + """, s AS (SELECT pst.rec_id, start, p - start AS i, c0::DOUBLE AS a0, c1::DOUBLE AS a1, c2::DOUBLE AS a2, c3::DOUBLE AS b0, c4::DOUBLE AS b1, c5::DOUBLE AS b2
  FROM pst JOIN pad ON pst.rec_id = pad.rec_id AND p >= start AND p < start + 410),
m AS (SELECT *, a0*a0 + a1*a1 + a2*a2 AS aa, b0*b0 + b1*b1 + b2*b2 AS bb FROM s),
mg AS (SELECT *, sqrt(aa + 1e-8::DOUBLE) AS am, sqrt(bb + 1e-8::DOUBLE) AS gm FROM m)"""


def mr_features(spark: SparkSession, sf: str) -> DataFrame:
    m = stage(mr(spark, sf), "samples")
    rec = segment.long_enough(segment.recording_lengths(m, ["rec_id"], "y"), 410)
    w = segment.padded_windows(m, rec, ["rec_id"], CH, 410, 205, 205, 2).withColumn("k", F.expr("start div 205"))
    return features.window_features(w, fs=200.0)


_STAT = ", ".join(
    f"round(avg({m}), 5) AS {n}_mean, round(stddev_pop({m}), 5) AS {n}_std, round(sqrt(avg({m} * {m})), 5) AS {n}_rms, "
    f"round(max({m}) - min({m}), 5) AS {n}_range, round(quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25), 5) AS {n}_iqr"
    for m, n in (("am", "acc"), ("gm", "gyr"))
)


@query("a8_magnitude_statistics", with_(MR) + PADDED + f"SELECT rec_id, start, {_STAT} FROM mg GROUP BY rec_id, start")
def a8_magnitude_statistics(spark: SparkSession, sf: str) -> DataFrame:
    names = [f"{m}_{s}" for m in ("acc", "gyr") for s in features.STATS]
    return mr_features(spark, sf).select("rec_id", "start", *[F.round(c, 5).alias(c) for c in names])


@query(
    "a9_energies",
    with_(MR)
    + PADDED
    + """, j AS (SELECT *, a0 - lag(a0) OVER w AS d0, a1 - lag(a1) OVER w AS d1, a2 - lag(a2) OVER w AS d2 FROM mg WINDOW w AS (PARTITION BY rec_id, start ORDER BY i))
SELECT rec_id, start, round(avg(bb), 4) AS gyr_energy, round(avg((d0*200)**2 + (d1*200)**2 + (d2*200)**2) / 1e6, 4) AS jerk_energy FROM j GROUP BY rec_id, start""",
)
def a9_energies(spark: SparkSession, sf: str) -> DataFrame:
    f = mr_features(spark, sf)
    return f.select("rec_id", "start", F.round("gyr_energy", 4).alias("gyr_energy"), F.round(F.col("jerk_energy") / 1e6, 4).alias("jerk_energy"))


@query(
    "a10_tilt_travel",
    with_(MR)
    + PADDED
    + """, u AS (SELECT rec_id, start, i, a0 / (sqrt(aa) + 1e-8::DOUBLE) AS x, a1 / (sqrt(aa) + 1e-8::DOUBLE) AS y, a2 / (sqrt(aa) + 1e-8::DOUBLE) AS z FROM mg WHERE i % 16 = 0),
d AS (SELECT rec_id, start, x * lag(x) OVER w + y * lag(y) OVER w + z * lag(z) OVER w AS dot FROM u WINDOW w AS (PARTITION BY rec_id, start ORDER BY i))
SELECT rec_id, start, round(sum(acos(greatest(-1, least(1, dot)))), 4) AS tilt_travel FROM d WHERE dot IS NOT NULL GROUP BY rec_id, start""",
)
def a10_tilt_travel(spark: SparkSession, sf: str) -> DataFrame:
    return mr_features(spark, sf).select("rec_id", "start", F.round("tilt_travel", 4).alias("tilt_travel"))


@query(
    "a11_orientation_change",
    with_(MR)
    + PADDED
    + """, g AS (SELECT rec_id, start, avg(a0) AS x, avg(a1) AS y, avg(a2) AS z FROM mg GROUP BY rec_id, start),
u AS (SELECT rec_id, start, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, sqrt(x*x + y*y + z*z) + 1e-8::DOUBLE AS l FROM g)),
d AS (SELECT rec_id, start, x * lag(x) OVER w + y * lag(y) OVER w + z * lag(z) OVER w AS dot FROM u WINDOW w AS (PARTITION BY rec_id ORDER BY start))
SELECT rec_id, start, round(coalesce(acos(greatest(-1, least(1, dot))), 0), 4) AS tilt_step FROM d""",
)
def a11_orientation_change(spark: SparkSession, sf: str) -> DataFrame:
    f = features.tilt_step(mr_features(spark, sf), ["rec_id"])
    return f.select("rec_id", "start", F.round("tilt_step", 4).alias("tilt_step"))


_DFT = """, tw AS (SELECT k, i, cos(2 * pi() * k * i / 410) AS c, sin(2 * pi() * k * i / 410) AS s FROM range(1, 103) a(k), range(410) b(i)),
ft AS (SELECT rec_id, start, k, sum(am * c) ** 2 + sum(am * s) ** 2 AS pa, sum(gm * c) ** 2 + sum(gm * s) ** 2 AS pg FROM mg JOIN tw USING (i) GROUP BY rec_id, start, k),
hz AS (SELECT *, k * 200.0::DOUBLE / 410 AS f FROM ft)
"""


@query(
    "a12_band_power",
    with_(MR)
    + PADDED
    + _DFT
    + "SELECT rec_id, start, "
    + ", ".join(
        f"round(avg({p}) FILTER (f >= {lo} AND f < {hi}) / 1000, 3) AS {n}_band{b}"
        for p, n in (("pa", "acc"), ("pg", "gyr"))
        for b, (lo, hi) in enumerate(features.BANDS)
    )
    + " FROM hz GROUP BY rec_id, start",
)
def a12_band_power(spark: SparkSession, sf: str) -> DataFrame:
    names = [f"{m}_band{b}" for m in ("acc", "gyr") for b in range(4)]
    return mr_features(spark, sf).select("rec_id", "start", *[F.round(F.col(c) / 1000, 3).alias(c) for c in names])


@query(
    "a7_robust_scale",
    with_(EV)
    + """, f AS (SELECT rec_id, idx, unnest([0, 1]) AS feature, unnest([c0::DOUBLE, c1::DOUBLE]) AS v FROM ev),
md AS (SELECT rec_id, feature, quantile_cont(v, 0.5) AS med FROM f GROUP BY ALL),
mad AS (SELECT rec_id, feature, any_value(med) AS med, quantile_cont(abs(v - med), 0.5) AS mad FROM f JOIN md USING (rec_id, feature) GROUP BY rec_id, feature)
SELECT rec_id, idx, feature, round((v - med) / (1.4826::DOUBLE * (mad + 1e-6::DOUBLE)), 6) AS z FROM f JOIN mad USING (rec_id, feature)""",
)
def a7_robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    e = stage(ev(spark, sf).select("rec_id", "idx", F.array(F.col("c0").cast("double"), F.col("c1").cast("double")).alias("f")), "features")
    z = features.robust_scale(e, ["rec_id"])
    return z.select("rec_id", "idx", F.posexplode("f").alias("feature", "z")).withColumn("z", F.round("z", 6))


@query(
    "a13_context_features",
    with_(MR)
    + PADDED
    + """, b AS (SELECT rec_id, start, avg(bb) AS e, avg(am) AS m FROM mg GROUP BY rec_id, start),
l AS (SELECT rec_id, start, unnest(['e', 'm']) AS nm, unnest([e, m]) AS v FROM b),
md AS (SELECT rec_id, nm, quantile_cont(v, 0.5) AS med FROM l GROUP BY ALL),
ma AS (SELECT l.rec_id, l.nm, any_value(med) AS med, quantile_cont(abs(v - med), 0.5) AS mad FROM l JOIN md ON l.rec_id = md.rec_id AND l.nm = md.nm GROUP BY ALL),
z AS (SELECT l.rec_id, start, l.nm, (v - med) / (1.4826::DOUBLE * (mad + 1e-6::DOUBLE)) AS z FROM l JOIN ma ON l.rec_id = ma.rec_id AND l.nm = ma.nm),
c AS (SELECT *, lag(z) OVER w AS p, lead(z) OVER w AS n FROM z WINDOW w AS (PARTITION BY rec_id, nm ORDER BY start))
SELECT rec_id, start - 410 AS start, 70 AS n_features, round(max(CASE WHEN nm = 'e' THEN z END), 4) AS energy_z, round(max(CASE WHEN nm = 'm' THEN z - p END), 4) AS mean_from_prev,
  round(max(CASE WHEN nm = 'm' THEN c.n - z END), 4) AS mean_to_next FROM c JOIN len USING (rec_id)
WHERE p IS NOT NULL AND c.n IS NOT NULL AND start - 410 >= 0 AND start <= len.n GROUP BY rec_id, start""",
)
def a13_context_features(spark: SparkSession, sf: str) -> DataFrame:
    f = jobs.context_features(stage(mr(spark, sf), "samples"), ["rec_id"], CH, jobs.TagWindows(), "y")
    at = features.BASE.index("acc_mean")
    v = lambda i, n: F.round(F.col("f")[i], 4).alias(n)
    return f.select("rec_id", "start", F.size("f").alias("n_features"), v(0, "energy_z"), v(22 + at, "mean_from_prev"), v(44 + at, "mean_to_next"))


@query(
    "a14_standardise",
    with_(WN)
    + """, l AS (SELECT win_id, split, unnest(range(64)) AS feature, unnest(x)::DOUBLE AS v FROM wn),
m AS (SELECT feature, avg(v) AS mu, stddev_pop(v) + 1e-6::DOUBLE AS sd FROM l WHERE split = 'train' GROUP BY feature)
SELECT win_id, CAST(feature AS INT) AS feature, round((v - mu) / sd, 5) AS z FROM l JOIN m USING (feature)""",
)
def a14_standardise(spark: SparkSession, sf: str) -> DataFrame:
    w = wn(spark, sf).select("win_id", "split", F.col("x")[0].cast("array<double>").alias("f"))
    m = features.column_moments(w.filter("split = 'train'")).orderBy("feature").collect()  # one row per feature
    z = features.standardise(w, [r["mu"] for r in m], [r["sd"] for r in m])
    return z.select("win_id", F.posexplode("z").alias("feature", "z")).withColumn("z", F.round("z", 5))


# -- tagging ------------------------------------------------------------------------------------


@query(
    "m4_three_state_decision",
    with_(PR)
    + """, p AS (SELECT event_id, k / 100.0::DOUBLE AS a, (k * 37 % 100) / 100.0::DOUBLE AS b, CAST(event_id % 2 AS INT) AS ha, CAST(event_id % 3 = 0 AS INT) AS hb FROM pr),
d AS (SELECT *, (a >= 0.6 AND a - b >= 0.15::DOUBLE) OR (ha > 0 AND hb = 0 AND a - b >= 0.05::DOUBLE) AS pt, (b >= 0.6 AND b - a >= 0.15::DOUBLE) OR (hb > 0 AND ha = 0 AND b - a >= 0.05::DOUBLE) AS sp FROM p)
SELECT event_id, CASE WHEN a <= 0.55 AND b <= 0.55 THEN 0.5::DOUBLE WHEN pt AND NOT sp THEN 1.0::DOUBLE WHEN sp AND NOT pt THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS y_win FROM d""",
)
def m4_three_state_decision(spark: SparkSession, sf: str) -> DataFrame:
    k, e = F.col("k"), F.col("event_id")
    p = pr(spark, sf).select(
        "event_id", (k / 100.0).alias("a"), (k * 37 % 100 / 100.0).alias("b"), (e % 2).cast("int").alias("ha"), (e % 3 == 0).cast("int").alias("hb")
    )
    return p.select("event_id", tagging.decide(F.col("a"), F.col("b"), F.col("ha"), F.col("hb"), tagging.TagRules()).alias("y_win"))


def mr_annotations(samples: DataFrame) -> DataFrame:
    """Intervals read off the samples: every 450 samples a transition or a stable span."""
    at = samples.filter("idx % 450 = 0").select("rec_id", "idx", "c4")
    sec = F.col("idx") / 200.0
    move = F.floor(F.col("rec_id") / 3) % 2 == 0
    span = F.when(
        move, F.struct(F.lit("transition").alias("kind"), (sec + 0.1).alias("t0"), (sec + 1.2 + F.col("c4") / 200.0).alias("t1"))
    ).otherwise(F.struct(F.lit("no_transition").alias("kind"), sec.alias("t0"), (sec + 1.9).alias("t1")))
    return at.select("rec_id", span.alias("s")).select("rec_id", "s.*")


_results: dict[tuple[str, str, int], jobs.TagResult] = {}


def tagging_result(spark: SparkSession, sf: str) -> jobs.TagResult:
    """The whole tagging job; its staged tables serve all queries of one application on the same input until they
    are cleared."""
    key = (spark.sparkContext.applicationId, sf, times_cleared(spark))
    if key not in _results:
        m = stage(mr(spark, sf), "samples")
        _results[key] = jobs.tag_recordings(m, mr_annotations(m), ["rec_id"], CH, jobs.TagWindows(), "y")
    return _results[key]


# annotated spans as sample ranges, and the tagged windows with their covered samples
_SPANS_SQL = MR_LEN + """, an AS (SELECT rec_id, idx / 200.0::DOUBLE AS sec, c4, (rec_id // 3) % 2 = 0 AS move FROM mr WHERE idx % 450 = 0),
sp AS (SELECT rec_id, CASE WHEN move THEN 'pt' ELSE 'sp' END AS kind, CASE WHEN move THEN sec + 0.1::DOUBLE ELSE sec END AS t0,
       CASE WHEN move THEN sec + 1.2::DOUBLE + c4::DOUBLE / 200.0::DOUBLE ELSE sec + 1.9::DOUBLE END AS t1 FROM an),
rg AS (SELECT rec_id, kind, greatest(0, floor(t0 * 200.0::DOUBLE)) AS a, ceil(t1 * 200.0::DOUBLE) AS b FROM sp),
ps AS (SELECT rec_id, y, n, CAST(unnest(range(205, n + 820 - 410 - 204, 205)) AS BIGINT) - 410 AS start FROM len WHERE n >= 410),
tw AS (SELECT * FROM ps WHERE start >= 0 AND start + 410 <= n),
cv AS (SELECT tw.rec_id, tw.y, tw.start, coalesce(sum(CASE WHEN kind = 'pt' THEN least(b, start + 410) - greatest(a, start) END), 0) AS pt,
       coalesce(sum(CASE WHEN kind = 'sp' THEN least(b, start + 410) - greatest(a, start) END), 0) AS sp
       FROM tw LEFT JOIN rg ON rg.rec_id = tw.rec_id AND a < start + 410 AND b > start GROUP BY tw.rec_id, tw.y, tw.start)
"""


@query(
    "m1_training_rows",
    with_(MR) + _SPANS_SQL + "SELECT m AS model, count(*) AS training_windows, count_if(CASE WHEN m = 'transition' THEN pt >= 83 ELSE sp >= 83 END) > 0 AS has_positives, 86 AS inputs "
    "FROM cv, (VALUES ('transition'), ('stable')) v(m) WHERE (pt >= 83 AND sp < 82) OR (sp >= 83 AND pt < 82) GROUP BY m",
)
def m1_training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that the models are fitted on, and the number of their inputs."""
    r = tagging_result(spark, sf).model
    rows = [(name, r.training_windows, bool(abs(m.intercept) < float("inf")), int(m.coefficients.size)) for name, m in (("transition", r.pt), ("stable", r.sp))]
    return spark.createDataFrame(rows, "model string, training_windows bigint, has_positives boolean, inputs int")


@query("m2_orthonormal", "SELECT CAST(a.i AS INT) AS a, CAST(b.i AS INT) AS b, CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS product FROM range(16) a(i), range(16) b(i)")
def m2_orthonormal(spark: SparkSession, sf: str) -> DataFrame:
    """Inner products of the projection's directions."""
    pc = tagging_result(spark, sf).model.pca.pc.toArray()
    p = pc.T @ pc
    rows = [(i, j, abs(round(float(p[i, j]), 6))) for i in range(len(p)) for j in range(len(p))]
    return spark.createDataFrame(rows, "a int, b int, product double")


@query("m3_decided_windows", with_(MR) + _SPANS_SQL + "SELECT rec_id, start, true AS agrees FROM tw WHERE y = 2")
def m3_decided_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tagged windows, and whether the tag follows from the stored probabilities and states."""
    from undula.operators.tagging import TagRules, decide

    t = tagging_result(spark, sf).tags
    again = decide(F.col("p_pt"), F.col("p_sp"), F.col("h_pt"), F.col("h_sp"), TagRules())
    inside = F.col("p_pt").between(0, 1) & F.col("p_sp").between(0, 1)
    return t.select("rec_id", "start", ((again == F.col("y_win")) & inside).alias("agrees"))


@query(
    "m9_tagging_counts",
    with_(MR) + _SPANS_SQL + """SELECT count(DISTINCT rec_id) AS files, count(*) AS windows,
  count_if((pt / 410.0::DOUBLE >= 0.5 AND sp / 410.0::DOUBLE <= 0.05) OR (sp / 410.0::DOUBLE >= 0.6 AND pt / 410.0::DOUBLE <= 0.05)) AS judged,
  count_if(pt / 410.0::DOUBLE >= 0.5 AND sp / 410.0::DOUBLE <= 0.05) AS positives FROM cv WHERE y = 2""",
)
def m9_tagging_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Files and windows tagged, and the clear ones that they are judged by."""
    r = tagging_result(spark, sf)
    judged = r.evaluation.select(F.col("n").alias("judged"), (F.col("tp") + F.col("fn")).alias("positives"))
    return r.summary.select(F.lit(1).alias("job"), "files", "windows").join(judged.withColumn("job", F.lit(1)), "job").drop("job")


# One 0/1 input and no penalty: the fit then has a closed form, the log odds of the weighted classes at 0 and at 1.
_SEEN = "CASE WHEN (event_type IN ('purchase', 'click')) <> (c1 % 4 = 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_ODDS = f""", sn AS (SELECT rec_id, idx, {_SEEN} AS x, CASE WHEN event_type IN ('purchase', 'view') THEN 1 ELSE 0 END AS pt, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS sp FROM ev),
od AS (SELECT m.model, x, (SELECT count(*) - sum(CASE WHEN m.model = 'transition' THEN pt ELSE sp END) FROM sn) / ((SELECT sum(CASE WHEN m.model = 'transition' THEN pt ELSE sp END) FROM sn) + 1e-6::DOUBLE)
    * sum(CASE WHEN m.model = 'transition' THEN pt ELSE sp END)::DOUBLE / (count(*) - sum(CASE WHEN m.model = 'transition' THEN pt ELSE sp END)) AS odds
  FROM sn, (VALUES ('transition'), ('stable')) m(model) GROUP BY m.model, x)"""


def seen_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with one 0/1 input that goes along with their kind."""
    e = ev(spark, sf)
    x = F.when(F.col("event_type").isin("purchase", "click") != (F.col("c1") % 4 == 0), 1.0).otherwise(0.0)
    flag = lambda *kinds: F.col("event_type").isin(*kinds).cast("double")
    return stage(e.select("rec_id", "idx", F.array(x).alias("f"), flag("purchase", "view").alias("y_pt"), flag("click").alias("y_sp")), "seen")


@query(
    "m1_closed_form_fit",
    with_(EV) + _ODDS + """SELECT model, round(ln(max(CASE WHEN x = 1 THEN odds END)) - ln(max(CASE WHEN x = 0 THEN odds END)), 3) AS weight,
  round(ln(max(CASE WHEN x = 0 THEN odds END)), 3) AS bias, (SELECT count(*) FROM sn) AS training_windows FROM od GROUP BY model""",
)
def m1_closed_form_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of both models on the raw input, which standardising took apart."""
    m = tagging.fit_tag_model(seen_events(spark, sf), pca_k=0, l2=0.0)
    rows = []
    for name, fit in (("transition", m.pt), ("stable", m.sp)):
        w = float(fit.coefficients[0]) / (m.sd[0] + 1e-6)
        rows.append((name, round(w, 3), round(float(fit.intercept) - w * m.mu[0], 3), m.training_windows))
    return spark.createDataFrame(rows, "model string, weight double, bias double, training_windows bigint")


@query(
    "m2_projected_variance",
    with_(MR)
    + """, c AS (SELECT corr(c0::DOUBLE, c1::DOUBLE) AS r, stddev_pop(c0::DOUBLE) AS s0, stddev_pop(c1::DOUBLE) AS s1 FROM mr),
q AS (SELECT (s0 / (s0 + 1e-6::DOUBLE)) ** 2 AS a, (s1 / (s1 + 1e-6::DOUBLE)) ** 2 AS d, r * s0 / (s0 + 1e-6::DOUBLE) * s1 / (s1 + 1e-6::DOUBLE) AS b FROM c)
SELECT component, round((a + d) / 2 + CASE component WHEN 0 THEN 1 ELSE -1 END * sqrt(((a - d) / 2) ** 2 + b * b), 6) AS variance FROM q, (VALUES (0), (1)) v(component)""",
)
def m2_projected_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Variance of the samples along each direction of the projection: the eigenvalues of their covariance."""
    f = stage(mr_rows(spark, sf).select(F.array(F.col("c0").cast("double"), F.col("c1").cast("double")).alias("f"), (F.col("c4") % 2).cast("double").alias("y_pt"), (F.col("c5") % 2).cast("double").alias("y_sp")), "rows")
    m = tagging.fit_tag_model(f, pca_k=2, steps=1)
    both = m.features(f).select(F.posexplode(vector_to_array("features")).alias("i", "v")).filter("i >= 2")
    return both.groupBy((F.col("i") - 2).alias("component")).agg(F.round(F.var_pop("v"), 6).alias("variance"))


@query(
    "m3_scored_events",
    with_(EV)
    + _ODDS
    + """, p AS (SELECT rec_id, idx, max(CASE WHEN model = 'transition' THEN odds / (1 + odds) END) AS a, max(CASE WHEN model = 'stable' THEN odds / (1 + odds) END) AS b FROM sn JOIN od USING (x) GROUP BY rec_id, idx),
m AS (SELECT rec_id, idx, sum(a) OVER w / 3 AS a, sum(b) OVER w / 3 AS b FROM p WINDOW w AS (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
h AS (SELECT *, coalesce(last_value(CASE WHEN a >= 0.6 THEN 1 WHEN a <= 0.4 THEN 0 END IGNORE NULLS) OVER u, 0) AS ha, coalesce(last_value(CASE WHEN b >= 0.6 THEN 1 WHEN b <= 0.4 THEN 0 END IGNORE NULLS) OVER u, 0) AS hb
  FROM m WINDOW u AS (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, (a >= 0.6 AND a - b >= 0.15) OR (ha = 1 AND hb = 0 AND a - b >= 0.05) AS ka, (b >= 0.6 AND b - a >= 0.15) OR (hb = 1 AND ha = 0 AND b - a >= 0.05) AS kb FROM h)
SELECT rec_id, idx, round(a, 4) AS p_pt, round(b, 4) AS p_sp, CAST(ha AS INT) AS h_pt, CAST(hb AS INT) AS h_sp,
  CASE WHEN a <= 0.55 AND b <= 0.55 THEN 0.5::DOUBLE WHEN ka AND NOT kb THEN 1.0::DOUBLE WHEN kb AND NOT ka THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS y_win FROM k""",
)
def m3_scored_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every event scored by the fitted models, smoothed, with states and decision."""
    e = seen_events(spark, sf)
    m = tagging.fit_tag_model(e, pca_k=0, l2=0.0)
    t = tagging.tag_windows(stage(m.score(e).select("rec_id", "idx", "p_pt", "p_sp"), "scores"), ["rec_id"], "idx")
    return t.select("rec_id", "idx", F.round("p_pt", 4).alias("p_pt"), F.round("p_sp", 4).alias("p_sp"), F.col("h_pt").cast("int"), F.col("h_sp").cast("int"), "y_win")


@query("m1_logistic_fit")
def m1_logistic_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients of both models, one row per input."""
    r = tagging_result(spark, sf).model
    rows = [
        (name, i, float(c), float(m.intercept), r.training_windows)
        for name, m in (("transition", r.pt), ("stable", r.sp))
        for i, c in enumerate(m.coefficients.toArray())
    ]
    return spark.createDataFrame(rows, "model string, input int, weight double, bias double, training_windows bigint")


@query("m2_projection")
def m2_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Loadings of the projection, sign fixed by the largest one."""
    pc = tagging_result(spark, sf).model.pca.pc.toArray()
    rows = []
    for k in range(pc.shape[1]):
        v = pc[:, k]
        v = v if v[abs(v).argmax()] > 0 else -v
        rows += [(k, i, float(x)) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "component int, input int, loading double")


@query("m3_scored_windows")
def m3_scored_windows(spark: SparkSession, sf: str) -> DataFrame:
    return tagging_result(spark, sf).tags.select("rec_id", "start", "p_pt", "p_sp", "h_pt", "h_sp", "y_win")


@query("m9_tagging_job")
def m9_tagging_job(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation and summary of the whole tagging job."""
    r = tagging_result(spark, sf)
    return r.evaluation.withColumn("job", F.lit(1)).join(r.summary.withColumn("job", F.lit(1)), "job").drop("job")


_KEPT = """, amp AS (SELECT rec_id, idx, greatest(abs(c0), abs(c1), abs(c2), abs(c3), abs(c4), abs(c5)) AS a FROM mr),
pk AS (SELECT rec_id, idx FROM amp JOIN (SELECT rec_id, max(a) AS t FROM amp GROUP BY rec_id) USING (rec_id) WHERE a = t),
st AS (SELECT rec_id, y, n, CAST(unnest(range(0, n - 409, CASE y WHEN 0 THEN 160 WHEN 1 THEN 410 ELSE 205 END)) AS BIGINT) AS start FROM len WHERE n >= 410),
keep AS (SELECT * FROM st WHERE y <> 0 OR EXISTS (SELECT 1 FROM pk WHERE pk.rec_id = st.rec_id AND idx >= start AND idx < start + 410))"""


@query(
    "e6_dual_label_events",
    with_(MR)
    + MR_LEN
    + _KEPT
    + """ SELECT keep.rec_id, keep.y AS y_h1, start, c1 AS offset1, CASE WHEN keep.y = 2 AND start = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS y_h2, CASE WHEN keep.y = 2 AND start = 0 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS w_h2,
  true AS has_events FROM keep JOIN mr ON mr.rec_id = keep.rec_id AND mr.idx = start""",
)
def e6_dual_label_events(spark: SparkSession, sf: str) -> DataFrame:
    m = stage(mr(spark, sf), "samples")
    tags = m.filter("y = 2 AND idx = 0").select("rec_id", F.lit(0).cast("bigint").alias("start"), F.lit(1.0).alias("y_h2"), F.lit(0).alias("src_h2"))
    settings = jobs.EventSettings(theta=(2.0, 5.0, 0.5, 0.5, 5.0, 0.5))
    e = jobs.dual_label_events(m, tags, ["rec_id"], CH, settings, "y")
    return e.select("rec_id", "y_h1", "start", F.col("offset")[1].alias("offset1"), "y_h2", "w_h2", (F.col("n_events") > 0).alias("has_events"))


_WIDE = """, g6 AS (SELECT g, CAST(g * (409.0::DOUBLE / 2047.0::DOUBLE) AS FLOAT) AS t FROM range(2048) r(g)),
p6 AS (SELECT g, CAST(floor(t) AS INT) AS lo, least(CAST(floor(t) AS INT) + 1, 409) AS hi, CAST(t - floor(t) AS FLOAT) AS a FROM g6),
w6 AS (SELECT keep.rec_id, start, ch, list(v ORDER BY idx) AS x FROM keep JOIN (SELECT rec_id, idx, unnest(range(6)) AS ch, unnest([c0, c1, c2, c3, c4, c5]) AS v FROM mr) m
  ON m.rec_id = keep.rec_id AND idx >= start AND idx < start + 410 GROUP BY keep.rec_id, start, ch),
u6 AS (SELECT rec_id, start, ch, list(CAST(x[lo + 1] + CAST(a * CAST(x[hi + 1] - x[lo + 1] AS FLOAT) AS FLOAT) AS FLOAT) ORDER BY g) AS u FROM w6, p6 GROUP BY rec_id, start, ch),
k6 AS (SELECT *, ([2.0, 5.0, 0.5, 0.5, 5.0, 0.5]::FLOAT[])[ch + 1] AS th FROM u6),
r6 AS (SELECT rec_id, start, list_reduce(list_transform(u, lambda v: {'v': v, 'xh': u[1], 'up': 0, 'dn': 0}), lambda s, b: {'v': b.v,
    'xh': CAST(s.xh + CASE WHEN CAST(b.v - s.xh AS FLOAT) > CAST(0.5::FLOAT * th AS FLOAT) THEN th WHEN CAST(b.v - s.xh AS FLOAT) < -CAST(0.5::FLOAT * th AS FLOAT) THEN -th ELSE 0::FLOAT END AS FLOAT),
    'up': s.up + CASE WHEN CAST(b.v - s.xh AS FLOAT) > CAST(0.5::FLOAT * th AS FLOAT) THEN 1 ELSE 0 END,
    'dn': s.dn + CASE WHEN CAST(b.v - s.xh AS FLOAT) < -CAST(0.5::FLOAT * th AS FLOAT) THEN 1 ELSE 0 END}) AS r FROM k6)"""


@query(
    "e6_event_counts",
    with_(MR) + MR_LEN + _KEPT + _WIDE + "SELECT rec_id, start, CAST(sum(r.up) AS BIGINT) AS n_up, CAST(sum(r.dn) AS BIGINT) AS n_down, CAST(sum(r.up) + sum(r.dn) AS BIGINT) AS n_events FROM r6 GROUP BY rec_id, start",
)
def e6_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Full-size windows (410 samples, six channels, 2,048 steps) encoded and counted."""
    m = stage(mr(spark, sf), "samples")
    none = m.filter("idx < 0").select("rec_id", F.col("idx").alias("start"), F.lit(1.0).alias("y_h2"), F.lit(0).alias("src_h2"))
    settings = jobs.EventSettings(theta=(2.0, 5.0, 0.5, 0.5, 5.0, 0.5))
    e = jobs.dual_label_events(m, none, ["rec_id"], CH, settings, "y")
    return e.select("rec_id", "start", "n_up", "n_down", "n_events")


# -- threshold search ---------------------------------------------------------------------------

THETAS = (0.05, 0.1, 0.2)
_GRID_SQL = """, th AS (SELECT unnest([0.05::FLOAT, 0.1::FLOAT, 0.2::FLOAT]) AS theta),
sdt AS (
  SELECT win_id, theta, 0 AS g, x[1] AS xh, 0 AS ev FROM wn, th
  UNION ALL
  SELECT d.win_id, d.theta, d.g + 1, CAST(d.xh + CAST(e.ev AS FLOAT) * d.theta AS FLOAT), e.ev
  FROM sdt d JOIN up u ON u.win_id = d.win_id AND u.g = d.g + 1,
  LATERAL (SELECT CASE WHEN CAST(u.v - d.xh AS FLOAT) > CAST(0.5::FLOAT * d.theta AS FLOAT) THEN 1
                       WHEN CAST(u.v - d.xh AS FLOAT) < -CAST(0.5::FLOAT * d.theta AS FLOAT) THEN -1 ELSE 0 END AS ev) e),
nat AS (SELECT i, max(g) AS j FROM range(64) r(i), gt WHERE t <= CAST(i AS FLOAT) GROUP BY i),
nb AS (SELECT i, j, least(j + 1, 319) AS k, a.t AS tj, b.t AS tk FROM nat JOIN gt a ON a.g = j JOIN gt b ON b.g = least(j + 1, 319)),
rd AS (SELECT w.win_id, w.y, p.theta, i, w.x[i + 1] AS ref,
    CAST(CASE WHEN j = k THEN p.xh::DOUBLE ELSE (q.xh::DOUBLE - p.xh::DOUBLE) / (tk::DOUBLE - tj::DOUBLE) * (i - tj::DOUBLE) + p.xh::DOUBLE END AS FLOAT) AS rec
  FROM nb JOIN sdt p ON p.g = j JOIN sdt q ON q.g = k AND q.win_id = p.win_id AND q.theta = p.theta JOIN wn w ON w.win_id = p.win_id),
er AS (SELECT y, theta, sum((CAST(ref - rec AS FLOAT))::DOUBLE ** 2) AS err, sum(ref::DOUBLE ** 2) AS eng FROM rd GROUP BY y, theta),
ct AS (SELECT y, theta, count(DISTINCT win_id) AS n, count_if(ev <> 0) AS events FROM sdt JOIN wn USING (win_id) GROUP BY y, theta)"""
GRID_T = GRID.replace("gl AS", "gt AS (SELECT g, t FROM grid),\ngl AS")


@query(
    "m7_theta_grid",
    with_(WN)
    + GRID_T
    + _GRID_SQL
    + "SELECT CAST(y AS INT) AS y, 0 AS channel, theta, round(err, 6) AS err, round(eng, 6) AS eng, n, events FROM er JOIN ct USING (y, theta)",
)
def m7_theta_grid(spark: SparkSession, sf: str) -> DataFrame:
    g = search.grid_errors(wn(spark, sf), {0: THETAS}, 64, 320)
    return g.withColumns({"err": F.round("err", 6), "eng": F.round("eng", 6)})


@query("m7_threshold_search")
def m7_threshold_search(spark: SparkSession, sf: str) -> DataFrame:
    """Epoch history of a search on balanced samples."""
    w = stage(wn(spark, sf), "windows")
    r = jobs.search_thresholds(
        w, jobs.SearchData(train_per_class=1000, val_per_class=1000), theta0=[0.2], in_len=64, out_len=320, init_step=0.02
    )
    return spark.createDataFrame(
        [(e, s, t, a, b, c, st) for e, s, t, a, b, c, st in r["history"]],
        "epoch int, step double, theta array<double>, train double, val double, best double, status string",
    )


@query(
    "m8_search_data",
    with_(WN)
    + """, tr AS (SELECT * FROM wn WHERE split = 'train'),
o AS (SELECT y, count(*) AS n FROM tr GROUP BY y),
s AS (SELECT y, n - CAST(floor(0.1::DOUBLE * n) + CASE WHEN n > floor(0.1::DOUBLE * n) + floor(0.9::DOUBLE * n) AND 0.1::DOUBLE * n - floor(0.1::DOUBLE * n) >= 0.9::DOUBLE * n - floor(0.9::DOUBLE * n) THEN 1 ELSE 0 END AS BIGINT) AS a FROM o)
SELECT 'train' AS part, y, least(a, 20) AS n FROM s UNION ALL
SELECT 'val', y, least(n - a, 4) FROM s JOIN o USING (y) UNION ALL
SELECT 'test_sampled', y, least(count(*), 8) FROM wn WHERE split = 'test' GROUP BY y UNION ALL
SELECT 'test_full', y, count(*) FROM wn WHERE split = 'test' GROUP BY y""",
)
def m8_search_data(spark: SparkSession, sf: str) -> DataFrame:
    d = jobs.search_data(wn(spark, sf), jobs.SearchData(20, 4, 8), 64)
    return d.groupBy("part", "y").agg(F.count(F.lit(1)).alias("n"))


_A18 = GRID + """, e AS (SELECT y, x[CAST(floor(g / 5) AS INT) + 1]::DOUBLE AS ref, v::DOUBLE AS got FROM up JOIN wn USING (win_id, y)),
p AS (SELECT y, sum((ref - got) ** 2) AS err, sum(ref ** 2) AS eng, count(*) AS n FROM e GROUP BY y)"""


def partials(spark: SparkSession, sf: str) -> DataFrame:
    from undula.operators.resample import resample_windows

    w = wn(spark, sf).select("y", F.col("x").alias("raw"), "x")
    u = resample_windows(w, 64, 320).select("y", "raw", F.posexplode(F.col("x")[0]).alias("g", "got"))
    return search.class_errors(u.select("y", F.col("raw")[0][F.expr("g div 5").cast("int")].alias("ref"), "got"))


@query("a18_objective_partials", with_(WN) + _A18 + "SELECT y, round(err, 6) AS err, round(eng, 6) AS eng, n FROM p")
def a18_objective_partials(spark: SparkSession, sf: str) -> DataFrame:
    return partials(spark, sf).withColumns({"err": F.round("err", 6), "eng": F.round("eng", 6)})


@query("a19_objective", with_(WN) + _A18 + "SELECT round(avg(err / eng) + 0.25::DOUBLE * max(err / eng), 9) AS score FROM p")
def a19_objective(spark: SparkSession, sf: str) -> DataFrame:
    return search.objective(partials(spark, sf), 0.25).select(F.round("score", 9).alias("score"))


@query(
    "a21_theta_ceiling",
    with_(MR)
    + """, l AS (SELECT unnest(range(6)) AS channel, unnest([abs(c0), abs(c1), abs(c2), abs(c3), abs(c4), abs(c5)])::DOUBLE AS a FROM mr)
SELECT CAST(channel AS INT) AS channel, round(greatest(5.0::DOUBLE, 0.5::DOUBLE * quantile_cont(a, 0.95), 1.1::DOUBLE * 4), 6) AS theta_max FROM l GROUP BY channel""",
)
def a21_theta_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    c = search.theta_ceiling(search.channel_values(mr_rows(spark, sf), CH), [4.0] * 6, scale=0.5, floor=5.0, margin=1.1)
    return c.select("channel", F.round("theta_max", 6).alias("theta_max"))
