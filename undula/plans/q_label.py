"""Splits, sampling, weights, label fusion, evaluation, losses and energy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.functions import scalar as S
from undula.operators import energy, fusion, losses, metrics, splits, tagging, weights
from undula.operators.segment import recording_lengths
from undula.plans.bindings import EV, EVENT_TYPES, PR, WN, ev, pr, table, with_, wn
from undula.plans.q_scan import scratch, write_runs
from undula.plans.registry import query
from undula.session import stage
from undula.sources import store

NAMES12 = {i: f"class{i}" for i in range(12)}
NAMES5 = dict(enumerate(EVENT_TYPES))


def order_sql(table_: str, label: str, key: str, seed: int) -> str:
    return (
        f"row_number() OVER (PARTITION BY {label} ORDER BY md5(CAST({key} AS VARCHAR) || ':{seed}'), {key}) - 1 AS rn, "
        f"count(*) OVER (PARTITION BY {label}) AS cnt"
    )


def split_sql(src: str, label: str, key: str, f: tuple, seed: int, cols: str) -> str:
    """Largest-remainder split in SQL: remainders ranked descending, later part first on ties."""
    fr = splits.normalise_fractions(f)
    raw = ", ".join(f"({v!r}::DOUBLE * cnt) AS r{i}" for i, v in enumerate(fr))
    return f"""(WITH o AS (SELECT {cols}, {label} AS lab, {order_sql(src, label, key, seed)} FROM {src}),
  q AS (SELECT *, {raw} FROM o),
  d AS (SELECT *, cnt - floor(r0) - floor(r1) - floor(r2) AS spare FROM q),
  parts AS (SELECT DISTINCT lab, cnt, spare, unnest([{{'i': 0, 'r': r0}}, {{'i': 1, 'r': r1}}, {{'i': 2, 'r': r2}}]) AS p FROM d),
  sz AS (SELECT lab, p.i AS i, floor(p.r) + CAST(row_number() OVER (PARTITION BY lab ORDER BY p.r - floor(p.r) DESC, p.i DESC) <= spare AS INT) AS size FROM parts),
  w AS (SELECT lab, max(CASE WHEN i = 0 THEN size END) AS a, max(CASE WHEN i = 1 THEN size END) AS b FROM sz GROUP BY lab)
  SELECT {cols}, CASE WHEN rn < a THEN 'train' WHEN rn < a + b THEN 'val' ELSE 'test' END AS part FROM o JOIN w USING (lab))"""


@query(
    "t1_balanced_sample",
    with_(WN)
    + f"""SELECT win_id, y FROM (SELECT win_id, y, {order_sql('wn', 'y', 'win_id', 101)} FROM wn) WHERE rn < 20""",
)
def t1_balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    return splits.balanced_sample(wn(spark, sf).select("win_id", "y"), "y", "win_id", 20, 101)


def _u(key: str, seed: str) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 13) AS BIGINT) / {float(16**13)!r}::DOUBLE)"


@query(
    "t2_weighted_draws",
    with_(WN)
    + f""", o AS (SELECT win_id, y, {order_sql('wn', 'y', 'win_id', 5)} FROM wn),
c AS (SELECT y, count(*) AS n, row_number() OVER (ORDER BY y) - 1 AS ord, count(*) OVER () AS k FROM wn GROUP BY y),
d AS (SELECT win_id AS draw, floor({_u('win_id', '5:class')} * (SELECT max(k) FROM c)) AS ord, {_u('win_id', '5:row')} AS u FROM wn)
SELECT draw, d2.y, o.win_id FROM (SELECT draw, c.y, floor(u * n) AS rn FROM d JOIN c ON d.ord = c.ord) d2 JOIN o ON o.y = d2.y AND o.rn = d2.rn""",
)
def t2_weighted_draws(spark: SparkSession, sf: str) -> DataFrame:
    return splits.balanced_draws(wn(spark, sf).select("win_id", "y"), "y", "win_id", 5)


@query(
    "t6_stratified_split",
    with_(WN) + f"SELECT win_id, y, part AS split FROM {split_sql('wn', 'y', 'win_id', (0.8, 0.1, 0.1), 3, 'win_id, y')}",
)
def t6_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_split(wn(spark, sf).select("win_id", "y"), "y", "win_id", (0.8, 0.1, 0.1), 3)


@query(
    "t7_train_val_split",
    with_(WN) + f"SELECT win_id, y, part AS split FROM {split_sql('wn', 'y', 'win_id', (0.85, 0.15, 0.0), 4, 'win_id, y')}",
)
def t7_train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.train_val_split(wn(spark, sf).select("win_id", "y"), "y", "win_id", 0.15, 4)


@query(
    "t8_split_cases",
    with_(WN)
    + f""", tr AS (SELECT * FROM wn WHERE split = 'train'),
pool AS (SELECT * FROM wn WHERE domain BETWEEN 0 AND 4 AND domain <> 3), big AS (SELECT * FROM wn WHERE domain <> 12)
SELECT 'official' AS kind, win_id, part AS split FROM {split_sql('tr', 'y', 'win_id', (0.9, 0.1, 0.0), 0, 'win_id')}
UNION ALL SELECT 'official', win_id, 'test' FROM wn WHERE split = 'test'
UNION ALL SELECT 'random', win_id, part FROM {split_sql('wn', 'y', 'win_id', (0.8, 0.1, 0.1), 0, 'win_id')}
UNION ALL SELECT 'subject', win_id, part FROM {split_sql('pool', 'y', 'win_id', (0.9, 0.1, 0.0), 0, 'win_id')}
UNION ALL SELECT 'subject', win_id, 'test' FROM wn WHERE domain = 3
UNION ALL SELECT 'subject_large', win_id, part FROM {split_sql('big', 'y', 'win_id', (0.9, 0.1, 0.0), 0, 'win_id')}
UNION ALL SELECT 'subject_large', win_id, 'test' FROM wn WHERE domain = 12""",
)
def t8_split_cases(spark: SparkSession, sf: str) -> DataFrame:
    w = wn(spark, sf).select("win_id", "y", "domain", "split")
    out = None
    for case, target in (("official", 0), ("random", 0), ("subject", 3), ("subject_large", 12)):
        part = splits.prepare_case(w, case, target=target).select(F.lit(case).alias("kind"), "win_id", "split")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "t9_recording_split",
    with_(EV)
    + f""", rec AS (SELECT rec_id, y FROM ev GROUP BY rec_id, y)
SELECT ev.rec_id, idx, part AS split FROM ev JOIN {split_sql('rec', 'y', 'rec_id', (0.8, 0.1, 0.1), 9, 'rec_id')} s ON s.rec_id = ev.rec_id""",
)
def t9_recording_split(spark: SparkSession, sf: str) -> DataFrame:
    e = ev(spark, sf).select("rec_id", "y", "idx")
    rec = recording_lengths(e, ["rec_id"], "y")
    return splits.by_recording_split(rec, e, "rec_id", "y", (0.8, 0.1, 0.1), 9).select("rec_id", "idx", "split")


@query("u1_union_all", with_(WN) + "SELECT split, count(*) AS n, count(DISTINCT domain) AS subjects FROM wn GROUP BY split UNION ALL SELECT 'all', count(*), count(DISTINCT domain) FROM wn")
def u1_union_all(spark: SparkSession, sf: str) -> DataFrame:
    w = wn(spark, sf).select("split", "domain")
    return w.unionByName(w.withColumn("split", F.lit("all"))).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("domain").alias("subjects")
    )


@query("u2_pool_minus_target", with_(WN) + "SELECT DISTINCT domain FROM wn WHERE domain < 30 EXCEPT SELECT 7")
def u2_pool_minus_target(spark: SparkSession, sf: str) -> DataFrame:
    w = wn(spark, sf)
    pool = w.select("domain").distinct()
    return pool.exceptAll(pool.filter("domain = 7"))


# -- counts and weights -------------------------------------------------------------------------


@query(
    "a1_class_counts",
    with_(WN) + "SELECT CAST(i AS INT) AS y, 'class' || i AS name, count(wn.y) AS n FROM range(12) r(i) LEFT JOIN wn ON wn.y = i GROUP BY i",
)
def a1_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return weights.class_counts(wn(spark, sf), "y", NAMES12)


@query(
    "a2_split_summary",
    with_(PR)
    + """SELECT CASE k % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, count(*) AS n, count_if(y_h1 = 0) AS fall, count_if(y_h1 = 1) AS normal_dynamic,
  count_if(y_h1 = 2) AS normal_static, count_if(y_h1 = 2 AND y_h2 <> 0.5) AS valid, count_if(y_h1 = 2 AND y_h2 = 0) AS stable_posture,
  count_if(y_h1 = 2 AND y_h2 = 1) AS postural_transition, count_if(y_h1 = 2 AND y_h2 = 0.5) AS ambiguous,
  count_if(y_h1 = 2 AND y_h2 <> 0.5 AND src_h2 = 1) AS manual, count_if(y_h1 = 2 AND y_h2 <> 0.5 AND src_h2 = 0) AS autotag
FROM pr GROUP BY 1""",
)
def a2_split_summary(spark: SparkSession, sf: str) -> DataFrame:
    part = F.when(F.col("k") % 3 == 0, "train").when(F.col("k") % 3 == 1, "val").otherwise("test")
    return weights.dual_split_summary(pr(spark, sf).withColumn("split", part))


@query(
    "a2_window_split_summary",
    with_(WN)
    + """SELECT split, y, count(*) AS n, any_value(t) AS total, any_value(d) AS domain_count FROM wn JOIN (
  SELECT split, count(*) AS t, count(DISTINCT domain) AS d FROM wn GROUP BY split) USING (split) GROUP BY split, y""",
)
def a2_window_split_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = weights.window_split_summary(wn(spark, sf))
    return s.select("split", F.col("n").alias("total"), "domain_count", F.explode("class_counts").alias("y", "n"))


@query(
    "a3_tag_summary",
    with_(PR)
    + "SELECT count(DISTINCT user_id) AS files, count(*) AS windows, count_if(y_h2 = 0) AS stable_posture, count_if(y_h2 = 1) AS postural_transition, count_if(y_h2 = 0.5) AS ambiguous FROM pr",
)
def a3_tag_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tagging.tag_summary(pr(spark, sf), "user_id", "y_h2")


@query(
    "a4_balanced_weights",
    with_(WN) + "SELECT CAST(y AS INT) AS y, count(*) AS n, CAST((SELECT count(*) FROM wn) / (10.0::DOUBLE * count(*)) AS FLOAT) AS weight FROM wn GROUP BY y",
)
def a4_balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    return weights.balanced_class_weights(wn(spark, sf), "y", 10)


@query(
    "a5_inverse_weights",
    with_(WN)
    + """, v AS (SELECT y + 2 AS y FROM wn)
SELECT CAST(i AS INT) AS y, CASE WHEN count(v.y) = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE / count(v.y) END AS weight
FROM range(12) r(i) LEFT JOIN v ON v.y = i GROUP BY i""",
)
def a5_inverse_weights(spark: SparkSession, sf: str) -> DataFrame:
    return weights.inverse_frequency_weights(wn(spark, sf).select((F.col("y") + 2).alias("y")), "y")


@query(
    "j7_sample_weights",
    with_(WN) + "SELECT win_id, y, 100.0::DOUBLE / count(*) OVER (PARTITION BY y) AS weight FROM wn",
)
def j7_sample_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = wn(spark, sf).select("win_id", "y")
    return weights.sample_weights(w, "y", stage(weights.inverse_frequency_weights(w, "y"), "weights"))


@query(
    "a6_positive_weight",
    with_(PR)
    + """SELECT k % 7 AS part, CASE WHEN count_if(y_h1 = 2 AND y_h2 = 1) = 0 THEN 1.0::DOUBLE ELSE
  count_if(y_h1 = 2 AND y_h2 = 0) / count_if(y_h1 = 2 AND y_h2 = 1) END AS pos_weight FROM pr GROUP BY 1
UNION ALL SELECT -1, 1.0::DOUBLE FROM pr HAVING count(*) > 0""",
)
def a6_positive_weight(spark: SparkSession, sf: str) -> DataFrame:
    p = pr(spark, sf)
    w = weights.positive_weight(F.col("y_h1"), F.col("y_h2")).alias("pos_weight")
    none = p.filter("y_h1 = 0").groupBy(F.lit(-1).alias("part")).agg(w)
    return p.groupBy((F.col("k") % 7).alias("part")).agg(w).unionByName(none)


# -- label fusion -------------------------------------------------------------------------------

TAGS = """, tg AS (SELECT event_id AS seq, user_id AS rec_id, CAST(k % 20 AS BIGINT) * 8 AS start, y_h2 + (k - 50) * 1e-7::DOUBLE AS v, src_h2 AS src FROM pr),
pick AS (SELECT *, row_number() OVER (PARTITION BY rec_id, start ORDER BY src DESC, CASE WHEN src = 1 THEN seq ELSE -seq END) AS r FROM tg),
merged AS (SELECT rec_id, start, CASE WHEN abs(v - 1) <= 1e-8::DOUBLE + 1e-5::DOUBLE THEN 1.0::DOUBLE WHEN abs(v) <= 1e-8::DOUBLE THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS y_h2, src AS src_h2 FROM pick WHERE r = 1)"""


def tags(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = pr(spark, sf).select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("rec_id"), (F.col("k") % 20 * 8).cast("bigint").alias("start"),
        (F.col("y_h2") + (F.col("k") - 50) * F.lit(1e-7)).alias("y_win"), "src_h2",
    )
    return p.filter("src_h2 = 0").drop("src_h2"), p.filter("src_h2 = 1").drop("src_h2")


@query("j4_priority_merge", with_(PR) + TAGS + "SELECT * FROM merged")
def j4_priority_merge(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.merge_tags(*tags(spark, sf), ["rec_id"])


@query(
    "j5_window_targets",
    with_(EV, PR)
    + """, len AS (SELECT rec_id, y, count(*) AS n FROM ev GROUP BY rec_id, y),
st AS (SELECT rec_id, y AS y_h1, CAST(unnest(range(0, n - 15, 8)) AS BIGINT) AS start FROM len WHERE n >= 16)"""
    + TAGS
    + """, j AS (SELECT st.*, m.y_h2 AS t, m.src_h2 AS s, y_h1 = 2 AND m.y_h2 IS NOT NULL AS use FROM st LEFT JOIN merged m USING (rec_id, start))
SELECT rec_id, y_h1, start, CASE WHEN use THEN t ELSE 0.5::DOUBLE END AS y_h2, CASE WHEN use THEN s ELSE 0 END AS src_h2,
  CASE WHEN use AND t <> 0.5 THEN CASE WHEN s = 1 THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END ELSE 0.2::DOUBLE END AS w_h2 FROM j""",
)
def j5_window_targets(spark: SparkSession, sf: str) -> DataFrame:
    from undula.operators.segment import window_starts

    rec = recording_lengths(ev(spark, sf), ["rec_id"], "y")
    st = window_starts(rec, ["rec_id"], 16, F.lit(8)).select("rec_id", F.col("y").alias("y_h1"), "start")
    merged = fusion.merge_tags(*tags(spark, sf), ["rec_id"])
    return fusion.window_targets(st, merged, ["rec_id"], ambiguous_weight=0.2, ignore_ambiguous=False)


@query(
    "j6_matching_predictions",
    with_(PR)
    + """, r AS (SELECT DISTINCT 'f' || user_id AS file, user_id % 5 AS c FROM pr),
l AS (SELECT DISTINCT 'f' || user_id AS file FROM pr WHERE user_id % 2 = 0)
SELECT 'f' || user_id AS file, event_id, upper('d0' || (user_id % 5)) AS code FROM pr WHERE user_id % 2 = 0 AND k >= 10""",
)
def j6_matching_predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = pr(spark, sf)
    file = F.concat(F.lit("f"), "user_id")
    code = F.concat(F.lit("d0"), F.col("user_id") % 5)
    cols = [file.alias("file"), F.lit("sa01").alias("subject"), F.lit("R01").alias("trial")]
    recs = p.select(*cols, F.upper(code).alias("code"), F.lit(100).alias("n")).distinct()
    preds = p.select(*cols, F.when(F.col("k") < 10, "other").otherwise(code).alias("code"), "event_id")
    labels = p.filter("user_id % 2 = 0").select(file.alias("file"))
    return fusion.matching_predictions(preds, recs, labels).select("file", "event_id", "code")


# -- evaluation ---------------------------------------------------------------------------------


@query(
    "a15_binary_evaluation",
    """WITH p AS (SELECT quality AS t, 1 - toxic AS p, CASE doc_id % 3 WHEN 0 THEN 0.5 ELSE 1 - toxic END AS tag, (doc_id % 100) / 100.0::DOUBLE AS a FROM labels),
c AS (SELECT count(*) AS n, count_if(p = 1 AND t = 1) AS tp, count_if(p = 0 AND t = 0) AS tn, count_if(p = 1 AND t = 0) AS fp, count_if(p = 0 AND t = 1) AS fn,
  count_if(tag = 0.5) AS ambiguous_on_clear, avg(a) AS pa, avg(1 - a) AS pb FROM p)
SELECT n, tp, tn, fp, fn, ambiguous_on_clear, round(pa, 9) AS p_pt_mean, round(pb, 9) AS p_sp_mean, round((tp + tn) / n, 9) AS accuracy, round(tp / greatest(1, tp + fp), 9) AS precision,
  round(tp / greatest(1, tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""",
)
def a15_binary_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "labels")
    pred = 1 - F.col("toxic")
    tag = F.when(F.col("doc_id") % 3 == 0, 0.5).otherwise(pred)
    a = F.col("doc_id") % 100 / 100.0
    e = tagging.binary_evaluation(p, F.col("quality"), pred, tag, a, 1 - a)
    ints = ("n", "tp", "tn", "fp", "fn", "ambiguous_on_clear")
    return e.select(*ints, *[F.round(c, 9).alias(c) for c in e.columns if c not in ints])


@query(
    "a16_classification_report",
    with_(PR)
    + """, v AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS name, CAST(unnest(range(5)) AS INT) AS l),
c AS (SELECT name, (SELECT count(*) FROM pr WHERE y_true = l AND y_pred = l) AS tp, (SELECT count(*) FROM pr WHERE y_pred = l) AS np,
  (SELECT count(*) FROM pr WHERE y_true = l) AS s FROM v),
m AS (SELECT name, tp / np AS p, tp / s AS r, 2 * tp / (np + s) AS f, s FROM c),
u AS (SELECT * FROM m UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT count_if(y_true = y_pred) / count(*) AS a, count(*) AS n FROM pr)
UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), CAST(sum(s) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), CAST(sum(s) AS BIGINT) FROM m)
SELECT name, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, s AS support FROM u""",
)
def a16_classification_report(spark: SparkSession, sf: str) -> DataFrame:
    r = metrics.classification_report(pr(spark, sf), NAMES5)
    return r.select("name", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "a17_confusion",
    with_(PR)
    + """, g AS (SELECT CAST(a AS INT) AS y_true, CAST(b AS INT) AS y_pred FROM range(5) x(a), range(6) z(b)),
c AS (SELECT g.y_true, g.y_pred, count(pr.event_id) AS n FROM g LEFT JOIN pr USING (y_true, y_pred) GROUP BY ALL)
SELECT y_true, y_pred, n, round(n / sum(n) OVER (PARTITION BY y_true), 9) AS share FROM c
UNION ALL SELECT 5, CAST(b AS INT), 0, 0.0 FROM range(6) z(b)""",
)
def a17_confusion(spark: SparkSession, sf: str) -> DataFrame:
    c = metrics.confusion_counts(pr(spark, sf), range(6))
    return c.withColumn("share", F.round("share", 9))


@query(
    "a17_confusion_matrix",
    with_(PR)
    + "SELECT y_true, "
    + ", ".join(f'count_if(y_pred = {i}) AS "{i}"' for i in range(5))
    + " FROM pr GROUP BY y_true",
)
def a17_confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(metrics.confusion_counts(pr(spark, sf), range(5)), range(5))


_BATCH = """, b AS (SELECT k % 10 AS epoch, value AS loss, value / 2 AS loss_h1, value / 4 AS loss_h2, CAST(k AS BIGINT) AS n,
  CAST(k // 2 AS BIGINT) AS h1_correct, CAST(k // 8 AS BIGINT) AS h2_correct, CASE WHEN k % 10 = 3 THEN 0 ELSE CAST(k // 4 AS BIGINT) END AS n_h2 FROM pr)"""


@query(
    "a25_epoch_metrics",
    with_(PR)
    + _BATCH
    + """SELECT epoch, round(sum(loss * n) / sum(n), 6) AS loss, round(sum(loss_h1 * n) / sum(n), 6) AS loss_h1, round(sum(loss_h2 * n) / sum(n), 6) AS loss_h2,
  round(sum(h1_correct) / sum(n), 6) AS acc_h1, CASE WHEN sum(n_h2) > 0 THEN round(sum(h2_correct) / sum(n_h2), 6) ELSE 'nan'::DOUBLE END AS acc_h2,
  CAST(sum(n) AS BIGINT) AS total, CAST(sum(n_h2) AS BIGINT) AS total_h2 FROM b GROUP BY epoch""",
)
def a25_epoch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k").cast("bigint")
    div = lambda d: F.floor(k / d)
    b = pr(spark, sf).select(
        (F.col("k") % 10).alias("epoch"), F.col("value").alias("loss"), (F.col("value") / 2).alias("loss_h1"), (F.col("value") / 4).alias("loss_h2"),
        k.alias("n"), div(2).alias("h1_correct"), div(8).alias("h2_correct"), F.when(k % 10 == 3, F.lit(0)).otherwise(div(4)).alias("n_h2"),
    )
    e = metrics.epoch_metrics(b, ["epoch"])
    return e.select("epoch", *[F.round(c, 6).alias(c) for c in ("loss", "loss_h1", "loss_h2", "acc_h1", "acc_h2")], "total", "total_h2")


@query(
    "a26_dual_head_counts",
    with_(PR)
    + """SELECT k % 4 AS part, count(*) AS n, count_if(list_position(logits, list_max(logits)) - 1 = y_h1) AS h1_correct,
  count_if(y_h1 = 2 AND y_h2 <> 0.5 AND w_h2 > 0 AND CAST(1 / (1 + exp(-z)) >= 0.5 AS INT) = y_h2) AS h2_correct,
  count_if(y_h1 = 2 AND y_h2 <> 0.5 AND w_h2 > 0) AS n_h2 FROM pr GROUP BY 1""",
)
def a26_dual_head_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.dual_head_counts(pr(spark, sf).withColumn("part", F.col("k") % 4), by=["part"])


_CE = """, ce AS (SELECT *, list_sum([exp(v - list_max(logits)) FOR v IN logits]) AS se, list_max(logits) AS mx FROM pr),
l AS (SELECT *, mx + ln(se) AS lse, [1.0::DOUBLE, 2.0, 0.5, 1.5, 0.25] AS cw FROM ce),
loss AS (SELECT *, lse - logits[y_true + 1] AS nll, cw[y_true + 1] AS c,
  0.9::DOUBLE * (lse - logits[y_true + 1]) * cw[y_true + 1] + 0.1::DOUBLE / 5 * list_sum([(lse - logits[i]) * cw[i] FOR i IN range(1, 6)]) AS smooth FROM l)"""


@query(
    "a27_cross_entropy",
    with_(PR)
    + _CE
    + """SELECT 'mean' AS kind, round(avg(nll), 6) AS loss FROM loss UNION ALL SELECT 'weighted', round(sum(smooth * w_h2) / sum(w_h2), 6) FROM loss
UNION ALL SELECT 'head1', round(sum(smooth) / sum(c), 6) FROM loss""",
)
def a27_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    p, cw = pr(spark, sf), [1.0, 2.0, 0.5, 1.5, 0.25]
    parts = {
        "mean": losses.weighted_cross_entropy(p, "logits", "y_true"),
        "weighted": losses.weighted_cross_entropy(p, "logits", "y_true", "w_h2", cw, 0.1),
        "head1": losses.head1_loss(p, "logits", "y_true", cw, 0.1),
    }
    out = [d.select(F.lit(k).alias("kind"), F.round("loss", 6).alias("loss")) for k, d in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "a28_masked_bce",
    with_(PR)
    + """, b AS (SELECT *, ln(1 + exp(-abs(z))) + greatest(-z, 0) AS sp, y_h1 = 2 AS st, y_h2 = 0.5 AS amb FROM pr),
l AS (SELECT *, (1 - y_h2) * z + (1 + (1.7::DOUBLE - 1) * y_h2) * sp AS loss FROM b),
r AS (SELECT 'sample' AS kind, loss, w_h2 AS w, st AND NOT amb AS ok, st, amb, y_h2 FROM l
UNION ALL SELECT 'source', loss, CASE WHEN src_h2 = 1 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END * CASE WHEN amb THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END, st, st, amb, y_h2 FROM l)
SELECT kind, round(sum(CASE WHEN ok THEN loss * w END) / sum(CASE WHEN ok THEN w END), 6) AS loss, count(*) AS n_total, count_if(st) AS n_static, count_if(st AND amb) AS n_ambiguous,
  count_if(ok) AS n_valid, count_if(ok AND y_h2 > 0.5) AS n_pos_valid, round(sum(CASE WHEN ok THEN w END), 6) AS weight_sum FROM r GROUP BY kind
UNION ALL SELECT 'none', 0.0, count(*), 0, 0, 0, 0, 0.0 FROM pr WHERE y_h1 <> 2""",
)
def a28_masked_bce(spark: SparkSession, sf: str) -> DataFrame:
    p = pr(spark, sf)
    parts = {
        "sample": losses.head2_loss(p, sample_weight="w_h2", source="src_h2", pos_weight=1.7),
        "source": losses.head2_loss(p, source="src_h2", ignore_ambiguous=False, ambiguous_weight=0.3, pos_weight=1.7),
        "none": losses.head2_loss(p.filter("y_h1 <> 2"), source="src_h2"),
    }
    out = None
    for k, d in parts.items():
        d = d.select(F.lit(k).alias("kind"), F.round("loss", 6).alias("loss"), "n_total", "n_static", "n_ambiguous", "n_valid", "n_pos_valid", F.round("weight_sum", 6).alias("weight_sum"))
        out = d if out is None else out.unionByName(d)
    return out


@query(
    "a28_total_loss",
    with_(PR)
    + _CE
    + """, b AS (SELECT avg(nll) AS l1 FROM loss), c AS (SELECT avg((1 - y_h2) * z + ln(1 + exp(-abs(z))) + greatest(-z, 0)) AS l2, count(*) AS n FROM pr WHERE y_h1 = 2 AND y_h2 <> 0.5)
SELECT round(l1, 6) AS loss_head1, round(l2, 6) AS loss_head2, round(0.7::DOUBLE * l1 + 0.3::DOUBLE * l2, 6) AS loss, n AS n_valid FROM b, c""",
)
def a28_total_loss(spark: SparkSession, sf: str) -> DataFrame:
    p = pr(spark, sf)
    t = losses.dual_loss(losses.head1_loss(p, "logits", "y_true"), losses.head2_loss(p), 0.7, 0.3)
    return t.select(*[F.round(c, 6).alias(c) for c in ("loss_head1", "loss_head2", "loss")], "n_valid")


# -- energy -------------------------------------------------------------------------------------

LAYERS = """, calls AS (
  SELECT l_suppkey AS run, 'layer' || l_linenumber AS layer, CASE WHEN l_linenumber <= 4 THEN 'backbone' ELSE 'head' END AS grp,
    CASE WHEN l_linenumber <= 2 THEN 'spiking_conv1d' WHEN l_linenumber <= 4 THEN 'spiking_linear_sparse_input' WHEN l_linenumber = 5 THEN 'spiking_linear_dense_input'
         WHEN l_linenumber = 6 THEN 'dense_linear' ELSE 'other' END AS kind,
    l_partkey % 1000 * CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END AS macs, CAST(l_quantity AS BIGINT) AS nz, CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE 61 END AS numel,
    l_orderkey % 30 AS lif_nz, CASE WHEN l_linenumber = 6 THEN 0 ELSE 30 END AS lif_numel FROM lineitem),
lay AS (SELECT run, layer, grp, kind, sum(macs)::DOUBLE AS macs, sum(CASE WHEN kind IN ('spiking_conv1d', 'spiking_linear_sparse_input') THEN macs * CASE WHEN numel = 0 THEN 0 ELSE nz / numel END ELSE macs END)::DOUBLE AS sops,
  sum(lif_numel)::DOUBLE AS lif, sum(nz) AS nz, sum(numel) AS numel, sum(lif_nz) AS lif_nz, count(*) AS calls FROM calls GROUP BY ALL),
en AS (SELECT *, CASE WHEN kind IN ('spiking_conv1d', 'spiking_linear_sparse_input') THEN sops * 0.175::DOUBLE + lif * 0.383::DOUBLE WHEN kind = 'spiking_linear_dense_input' THEN macs + lif * 0.383::DOUBLE WHEN kind = 'dense_linear' THEN macs ELSE 0 END AS compute,
  CASE WHEN kind IN ('spiking_conv1d', 'spiking_linear_sparse_input') THEN sops * (0.107::DOUBLE + 1.712::DOUBLE) ELSE 0 END AS data FROM lay)"""


def layers(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    kind = (
        F.when(n <= 2, "spiking_conv1d").when(n <= 4, "spiking_linear_sparse_input").when(n == 5, "spiking_linear_dense_input")
        .when(n == 6, "dense_linear").otherwise("other")
    )
    calls = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("run"), F.concat(F.lit("layer"), n).alias("layer"), F.when(n <= 4, "backbone").otherwise("head").alias("group"),
        kind.alias("kind"), (F.col("l_partkey") % 1000 * F.when(n == 7, 0).otherwise(1)).alias("macs"),
        F.col("l_quantity").cast("bigint").alias("input_nonzero"), F.when(F.col("l_partkey") % 50 == 0, 0).otherwise(61).alias("input_numel"),
        (F.col("l_orderkey") % 30).alias("lif_nonzero"), F.when(n == 6, 0).otherwise(30).alias("lif_numel"),
    )
    return energy.with_energy(energy.layer_totals(calls))


def run_samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("run"), (F.col("s_suppkey") % 7 * 9).alias("n_samples"))


@query(
    "a22_layer_energy",
    with_("x AS (SELECT 1)")
    + LAYERS
    + "SELECT run, layer, kind, calls, round(macs, 4) AS dense_macs, round(sops, 4) AS effective_sops, round(lif, 4) AS lif_ops, round(compute, 4) AS energy_compute, round(data, 4) AS energy_data FROM en",
)
def a22_layer_energy(spark: SparkSession, sf: str) -> DataFrame:
    num = ("dense_macs", "effective_sops", "lif_ops", "energy_compute", "energy_data")
    return layers(spark, sf).select("run", "layer", "kind", "calls", *[F.round(c, 4).alias(c) for c in num])


REPORT = """, t AS (SELECT run, grp, layer, grouping(grp) AS g1, grouping(layer) AS g2, sum(macs) AS macs, sum(compute) AS compute, sum(compute + data) AS total FROM en GROUP BY GROUPING SETS ((run, grp, layer), (run, grp), (run))),
rep AS (SELECT run, grp, layer, CASE WHEN g2 = 0 THEN 'layer' WHEN g1 = 0 THEN 'group' ELSE 'run' END AS level, greatest(s_suppkey % 7 * 9, 1) AS n, macs, compute, total FROM t JOIN supplier ON s_suppkey = run)"""


@query(
    "a23_energy_report",
    with_("x AS (SELECT 1)")
    + LAYERS
    + REPORT
    + """SELECT run, grp AS "group", layer, level, n AS n_samples, round(compute / n, 4) AS energy_compute_per_sample, round(total / n, 4) AS energy_total_per_sample,
  CASE WHEN macs > 0 THEN round(1 - compute / macs, 6) ELSE 'nan'::DOUBLE END AS energy_compute_reduction FROM rep""",
)
def a23_energy_report(spark: SparkSession, sf: str) -> DataFrame:
    r = energy.energy_report(layers(spark, sf), run_samples(spark, sf))
    return r.select(
        "run", "group", "layer", "level", "n_samples", F.round("energy_compute_per_sample", 4).alias("energy_compute_per_sample"),
        F.round("energy_total_per_sample", 4).alias("energy_total_per_sample"), F.round("energy_compute_reduction", 6).alias("energy_compute_reduction"),
    )


@query(
    "a24_activation_rates",
    with_("x AS (SELECT 1)")
    + LAYERS
    + """SELECT run, layer, CASE WHEN numel = 0 THEN 'nan'::DOUBLE ELSE round(nz / numel, 9) END AS input_rate,
  CASE WHEN sum(lif)::BIGINT = 0 THEN 'nan'::DOUBLE ELSE round(sum(lif_nz) / sum(lif), 9) END AS lif_output_rate FROM en GROUP BY run, layer, numel, nz""",
)
def a24_activation_rates(spark: SparkSession, sf: str) -> DataFrame:
    return layers(spark, sf).select("run", "layer", F.round("input_rate", 9).alias("input_rate"), F.round("lif_output_rate", 9).alias("lif_output_rate"))


@query(
    "t3_ranked_runs",
    with_("x AS (SELECT 1)")
    + LAYERS
    + REPORT
    + "SELECT run, round(compute / n, 4) AS energy, row_number() OVER (ORDER BY compute / n NULLS LAST, run) AS place FROM rep WHERE level = 'run'",
)
def t3_ranked_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = energy.energy_report(layers(spark, sf), run_samples(spark, sf)).filter("level = 'run'")
    out = energy.ranked_runs(r.select("run", "energy_compute_per_sample"))
    return out.select("run", F.round("energy_compute_per_sample", 4).alias("energy"), "place")


HISTORY = """, lg AS (SELECT rec_id AS run, idx AS epoch, value AS val_loss FROM ev),
h AS (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM lg),
i AS (SELECT *, prev IS NULL OR val_loss < prev AS improved, coalesce(least(prev, val_loss), val_loss) AS best FROM h),
b AS (SELECT *, last_value(CASE WHEN improved THEN epoch END IGNORE NULLS) OVER (PARTITION BY run ORDER BY epoch) AS best_epoch FROM i),
s AS (SELECT *, min(CASE WHEN epoch - best_epoch >= 6 THEN epoch END) OVER (PARTITION BY run) AS stop FROM b)"""


@query(
    "t4_best_epoch",
    with_(EV) + HISTORY + "SELECT run, epoch, improved, best, best_epoch, epoch - best_epoch AS bad_epochs, stop FROM s WHERE stop IS NULL OR epoch <= stop",
)
def t4_best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    log = ev(spark, sf).select(F.col("rec_id").alias("run"), F.col("idx").alias("epoch"), F.col("value").alias("val_loss"))
    return metrics.training_history(stage(log, "log"), "run", "epoch", "val_loss", 6).drop("val_loss")


@query("t5_argmax_label", with_(PR) + "SELECT event_id, list_position(logits, list_max(logits)) - 1 AS label FROM pr")
def t5_argmax_label(spark: SparkSession, sf: str) -> DataFrame:
    return pr(spark, sf).select("event_id", S.argmax_label(F.col("logits")).cast("bigint").alias("label"))


@query(
    "a29_run_comparison",
    with_(PR)
    + LAYERS
    + REPORT
    + """, acc AS (SELECT user_id AS run, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM pr GROUP BY user_id)
SELECT n_nationkey AS run, n_nationkey AS seed, '[' || n_regionkey || ',' || n_nationkey || ']' AS theta, round(a, 6) AS test_acc, rep.n AS n_samples,
  round(rep.compute / rep.n, 4) AS energy_compute_per_sample, round(b.compute / b.n, 4) AS backbone_compute, round(h.total / h.n, 4) AS head_total
FROM nation LEFT JOIN acc ON acc.run = n_nationkey LEFT JOIN rep ON rep.run = n_nationkey AND rep.level = 'run'
LEFT JOIN (SELECT run, n, compute FROM rep WHERE level = 'group' AND grp = 'backbone') b ON b.run = n_nationkey
LEFT JOIN (SELECT run, n, total FROM rep WHERE level = 'group' AND grp = 'head') h ON h.run = n_nationkey""",
)
def a29_run_comparison(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "runs")
    write_runs(spark, sf, root)
    number = F.regexp_extract("run_name", r"(\d+)$", 1).cast("bigint")
    config = store.find_runs(spark, root).withColumn("run", number)
    report = stage(energy.energy_report(layers(spark, sf), run_samples(spark, sf)), "report")
    test = pr(spark, sf).groupBy(F.col("user_id").alias("run")).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("acc"))
    c = energy.run_comparison(report, config, test, ["seed", "theta"])
    return c.select(
        "run", "seed", "theta", F.round("test_acc", 6).alias("test_acc"), "n_samples",
        *[F.round(v, 4).alias(v) for v in ("energy_compute_per_sample", "backbone_compute", "head_total")],
    )
