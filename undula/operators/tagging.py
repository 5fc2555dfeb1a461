"""Automatic three-state tags: model fit, scoring, smoothing, hysteresis, decision, evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.operators.features import column_moments, standardise
from undula.operators.sequence import Run, framed, prefixes


@dataclass(frozen=True)
class TagRules:
    """Decision thresholds (defaults are fixed values)."""

    smooth_k: int = 3
    th_pt: float = 0.60
    th_sp: float = 0.60
    margin: float = 0.15
    amb_ceil: float = 0.55
    use_hysteresis: bool = True
    pt_on: float = 0.60
    pt_off: float = 0.40
    sp_on: float = 0.60
    sp_off: float = 0.40


def moving_averages(df: DataFrame, keys: Sequence[str], number: str, values: dict[str, str], k: int) -> DataFrame:
    """Centred mean over ``k`` rows, zero beyond the ends, divisor always ``k``; ``values`` maps name -> column."""
    if k <= 1:
        return df.withColumns({n: F.col(v) for n, v in values.items()})
    back, ahead = k // 2, (k - 1) // 2
    exprs = {n: (lambda w, v=v: F.sum(v).over(w.rowsBetween(-back, ahead)) / k) for n, v in values.items()}
    return framed(df, keys, number, exprs, before=back, after=ahead)


def moving_average(df: DataFrame, keys: Sequence[str], number: str, value: str, k: int, name: str) -> DataFrame:
    return moving_averages(df, keys, number, {name: value}, k)


def hysteresis_states(
    df: DataFrame, keys: Sequence[str], number: str, rules: dict[str, tuple[str, float, float]], width: int = 100_000
) -> DataFrame:
    """0/1 states that turn on at ``value >= on`` and off at ``value <= off`` and start off.

    ``rules`` maps name -> (value column, on, off). Since on > off, the state is the last of the two
    events seen so far.
    """
    runs = {}
    for name, (value, on, off) in rules.items():
        if on <= off:
            raise ValueError("on must be above off")
        runs[name] = Run("last", F.when(F.col(value) >= on, 1).when(F.col(value) <= off, 0))
    return prefixes(df, keys, [number], F.floor(F.col(number) / width), runs).fillna(0, subset=list(rules))


def hysteresis(
    df: DataFrame, keys: Sequence[str], number: str, value: str, on: float, off: float, name: str, width: int = 100_000
) -> DataFrame:
    return hysteresis_states(df, keys, number, {name: (value, on, off)}, width)


def decide(p_pt: Column, p_sp: Column, h_pt: Column, h_sp: Column, r: TagRules) -> Column:
    """Three-state tag: 1 transition, 0 stable, 0.5 undecided."""

    def picked(p, other, own, rival, th):
        gap = p - other
        return ((p >= th) & (gap >= r.margin)) | ((own > 0) & (rival == 0) & (gap >= 0.05))

    pt = picked(p_pt, p_sp, h_pt, h_sp, r.th_pt)
    sp = picked(p_sp, p_pt, h_sp, h_pt, r.th_sp)
    return (
        F.when((p_pt <= r.amb_ceil) & (p_sp <= r.amb_ceil), 0.5)
        .when(pt & ~sp, 1.0)
        .when(sp & ~pt, 0.0)
        .otherwise(0.5)
    )


def tag_windows(scored: DataFrame, keys: Sequence[str], number: str, rules: TagRules = TagRules()) -> DataFrame:
    """From raw ``p_pt``/``p_sp`` per window to smoothed probabilities, states ``h_*`` and ``y_win``."""
    smooth = moving_averages(scored, keys, number, {"__pt": "p_pt", "__sp": "p_sp"}, rules.smooth_k)
    out = smooth.drop("p_pt", "p_sp").withColumnsRenamed({"__pt": "p_pt", "__sp": "p_sp"})
    if rules.use_hysteresis:
        states = {"h_pt": ("p_pt", rules.pt_on, rules.pt_off), "h_sp": ("p_sp", rules.sp_on, rules.sp_off)}
        out = hysteresis_states(out, keys, number, states)
    else:
        out = out.withColumns(
            {"h_pt": (F.col("p_pt") >= rules.th_pt).cast("int"), "h_sp": (F.col("p_sp") >= rules.th_sp).cast("int")}
        )
    return out.withColumn("y_win", decide(F.col("p_pt"), F.col("p_sp"), F.col("h_pt"), F.col("h_sp"), rules))


def fit_weighted_logistic(train: DataFrame, label: str, l2: float, steps: int, features: str = "features"):
    """Logistic model with positive weight neg/pos and an L2 penalty that leaves the bias free.

    The penalised loss is divided by the row count, so the regulariser is rescaled to Spark's
    division by the weight sum.
    """
    n, pos = train.agg(F.count(F.lit(1)), F.sum(label)).first()
    if not n or pos in (0, n):
        raise ValueError(f"training rows of both classes are needed for {label}; {n} rows, {pos or 0} of them positive")
    cw = (n - pos) / (pos + 1e-6)
    weight_sum = (n - pos) + cw * pos
    weighted = train.withColumn("__w", 1.0 + (cw - 1.0) * F.col(label))
    return LogisticRegression(
        featuresCol=features, labelCol=label, weightCol="__w", standardization=False,
        elasticNetParam=0.0, regParam=l2 * n / weight_sum, maxIter=steps, tol=1e-9,
    ).fit(weighted)


@dataclass
class TagModel:
    mu: list[float]
    sd: list[float]
    pca: object | None
    pt: object
    sp: object
    training_windows: int

    def features(self, df: DataFrame) -> DataFrame:
        z = standardise(df, self.mu, self.sd).withColumn("z", array_to_vector("z"))
        if self.pca is None:
            return z.withColumnRenamed("z", "features")
        z = self.pca.transform(z)
        both = F.concat(vector_to_array("z"), vector_to_array("__proj"))
        return z.withColumn("features", array_to_vector(both)).drop("z", "__proj")

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``p_pt`` and ``p_sp`` (raw probabilities)."""
        out = self.features(df)
        for name, m in (("p_pt", self.pt), ("p_sp", self.sp)):
            m = m.copy().setProbabilityCol("__prob").setRawPredictionCol("__raw").setPredictionCol("__pred")
            out = m.transform(out).withColumn(name, vector_to_array("__prob")[1]).drop("__prob", "__raw", "__pred")
        return out.drop("features")


def fit_tag_model(train: DataFrame, pca_k: int = 16, l2: float = 2e-3, steps: int = 2500) -> TagModel:
    """Fit both one-vs-rest models on rows with ``f`` (array), ``y_pt`` and ``y_sp`` (0/1 doubles)."""
    moments = column_moments(train).orderBy("feature").collect()  # one row per feature
    if not moments:
        raise ValueError("no clear windows to train on")
    mu, sd = [r["mu"] for r in moments], [r["sd"] for r in moments]
    z = standardise(train, mu, sd).withColumn("z", array_to_vector("z"))
    k = min(pca_k, len(mu))
    pca = PCA(k=k, inputCol="z", outputCol="__proj").fit(z) if k > 0 else None
    model = TagModel(mu, sd, pca, None, None, train.count())
    ready = model.features(train).persist()
    model.pt = fit_weighted_logistic(ready, "y_pt", l2, steps)
    model.sp = fit_weighted_logistic(ready, "y_sp", l2, steps)
    ready.unpersist()
    return model


def binary_evaluation(df: DataFrame, truth: Column, pred: Column, tag: Column, p_pt: Column, p_sp: Column) -> DataFrame:
    """Counts and guarded ratios in one pass; all zero when there are no rows."""
    c = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((pred == 1) & (truth == 1)).alias("tp"),
        F.count_if((pred == 0) & (truth == 0)).alias("tn"),
        F.count_if((pred == 1) & (truth == 0)).alias("fp"),
        F.count_if((pred == 0) & (truth == 1)).alias("fn"),
        F.count_if(F.abs(tag - 0.5) <= 1e-8 + 1e-5 * 0.5).alias("ambiguous_on_clear"),
        F.coalesce(F.avg(p_pt), F.lit(0.0)).alias("p_pt_mean"),
        F.coalesce(F.avg(p_sp), F.lit(0.0)).alias("p_sp_mean"),
    )
    one = F.lit(1)
    return (
        c.withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.greatest(one, F.col("n")))
        .withColumn("precision", F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp")))
        .withColumn("recall", F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn")))
        .withColumn(
            "f1",
            2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-12), F.col("precision") + F.col("recall")),
        )
    )


def tag_summary(tags: DataFrame, key: str = "rec_id", tag: str = "y_win") -> DataFrame:
    """Files, windows and windows per state."""
    near = lambda v: F.count_if(F.abs(F.col(tag) - v) <= 1e-8 + 1e-5 * v)
    return tags.agg(
        F.countDistinct(key).alias("files"),
        F.count(F.lit(1)).alias("windows"),
        near(0.0).alias("stable_posture"),
        near(1.0).alias("postural_transition"),
        near(0.5).alias("ambiguous"),
    )
