"""Annotated time intervals: merging, window coverage and Gaussian window scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.operators.sequence import Run, explode_range, prefixes

MODES = ("mean", "center", "max", "q")


def sample_ranges(intervals: DataFrame, fs: float) -> DataFrame:
    """Adds the half-open sample range [a, b): a = max(0, floor(t0*fs)), b = ceil(t1*fs)."""
    return (
        intervals.withColumn("a", F.greatest(F.lit(0), F.floor(F.col("t0") * fs)).cast("bigint"))
        .withColumn("b", F.ceil(F.col("t1") * fs).cast("bigint"))
        .filter("b > a")
    )


def _with_reach(ranges: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Distinct starts with their furthest end ``b`` and ``__reach``, the furthest end of earlier starts."""
    r = ranges.select(*keys, "a", "b").groupBy(*keys, "a").agg(F.max("b").alias("b"))
    return prefixes(r, keys, ["a"], F.floor(F.col("a") / width), {"__reach": Run("max", F.col("b"), inclusive=False)})


def disjoint_ranges(ranges: DataFrame, keys: Sequence[str], width: int = 1_000_000) -> DataFrame:
    """Disjoint pieces with the same union per key: each range gives what earlier ones left uncovered."""
    r = _with_reach(ranges, keys, width)
    return r.withColumn("a", F.greatest("a", "__reach")).drop("__reach").filter("b > a")


def merge_ranges(ranges: DataFrame, keys: Sequence[str], width: int = 1_000_000) -> DataFrame:
    """Union of overlapping or touching ranges per key: disjoint, maximal (keys, a, b)."""
    r = _with_reach(ranges, keys, width)
    opens = F.when(F.col("__reach").isNull() | (F.col("a") > F.col("__reach")), F.col("a"))
    r = prefixes(r, keys, ["a"], F.floor(F.col("a") / width), {"__island": Run("last", opens)})
    return r.groupBy(*keys, "__island").agg(F.max("b").alias("b")).withColumnRenamed("__island", "a")


def _on_grid(windows: DataFrame, hop: int) -> DataFrame:
    """``windows`` as they are; a start that is no multiple of ``hop`` stops the job instead of scoring 0."""
    wrong = F.raise_error(F.format_string("window start %s is no multiple of %s", F.col("start"), F.lit(hop)))
    return windows.withColumn("start", F.when(F.col("start") % hop == 0, F.col("start")).otherwise(wrong.cast("bigint")))


def _windows_touching(df: DataFrame, a: Column, b: Column, win: int, hop: int) -> DataFrame:
    """One row per window [k*hop, k*hop + win) that shares a sample with [a, b): adds ``start``."""
    first = F.greatest(F.floor((a - win) / hop) + 1, F.lit(0))
    return (
        explode_range(df, first, F.ceil(b / hop) - 1, "__k")
        .withColumn("start", (F.col("__k") * hop).cast("bigint"))
        .drop("__k")
    )


def window_coverage(
    windows: DataFrame, ranges: DataFrame, keys: Sequence[str], win: int, hop: int, kinds: Sequence[str]
) -> DataFrame:
    """Adds ``ones_<kind>`` (covered samples, overlaps counted once) and ``mid_<kind>`` (centre sample
    covered, 0/1) to windows that start at multiples of ``hop``.

    A range is sent straight to the windows it touches and joined on (keys, start): no pair of
    range and window is formed that does not overlap.
    """
    keys = list(keys)
    windows = _on_grid(windows, hop)
    hits = _windows_touching(disjoint_ranges(ranges, [*keys, "kind"]), F.col("a"), F.col("b"), win, hop)
    ones = F.least(F.col("b"), F.col("start") + win) - F.greatest(F.col("a"), F.col("start"))
    mid = F.col("start") + win // 2
    covered = ((F.col("a") <= mid) & (mid < F.col("b"))).cast("int")
    aggs = []
    for k in kinds:
        aggs.append(F.sum(F.when(F.col("kind") == k, ones)).alias(f"ones_{k}"))
        aggs.append(F.max(F.when(F.col("kind") == k, covered)).alias(f"mid_{k}"))
    per = hits.groupBy(*keys, "start").agg(*aggs)
    names = [f"{p}_{k}" for k in kinds for p in ("ones", "mid")]
    return windows.join(per, [*keys, "start"], "left").fillna(0, subset=names)


def coverage_score(kind: str, win: int, mode: str, q: float = 0.8) -> Column:
    """Window score of a 0/1 coverage: mean, center, max, or linear quantile ``q`` in closed form."""
    m = F.col(f"ones_{kind}")
    if mode == "center":
        return F.col(f"mid_{kind}").cast("double")
    if mode == "max":
        return (m > 0).cast("int").cast("double")
    if mode == "q":
        h = min(max(q, 0.0), 1.0) * (win - 1)
        lo = int(h)
        at = [F.when(F.lit(i) >= win - m, 1.0).otherwise(0.0) for i in (lo, min(lo + 1, win - 1))]
        return at[0] + (h - lo) * (at[1] - at[0])
    return m.cast("double") / win


def gaussian_scores(
    windows: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    fs: float,
    win: int,
    hop: int,
    modes: dict[str, str],
    sigma_frac: float = 0.4,
    q: float = 0.8,
) -> DataFrame:
    """Adds one column per entry of ``modes`` (name -> mode) to windows at multiples of ``hop``.

    Every sample inside an interval gets exp(-((t - centre)/s)^2 / 2), s = max(length*sigma_frac,
    1/fs); overlapping intervals keep the larger value, all other samples are 0. Samples behind the last
    window of a key are not looked at, however long an interval is.
    """
    keys = list(keys)
    windows = _on_grid(windows, hop)
    ends = windows.groupBy(*keys).agg((F.max("start") + win - 1).alias("__end"))
    iv = (
        intervals.filter("t1 > t0")
        .select(*keys, "t0", "t1")
        .withColumn("__c", (F.col("t0") + F.col("t1")) * 0.5)
        .withColumn("__s", F.greatest((F.col("t1") - F.col("t0")) * sigma_frac, F.lit(1.0 / fs)))
        .join(ends, keys)
    )
    t = F.col("__j") / F.lit(float(fs))
    per_sample = (
        explode_range(iv, F.greatest(F.floor(F.col("t0") * fs), F.lit(0)), F.least(F.ceil(F.col("t1") * fs), F.col("__end")), "__j")
        .filter((t >= F.col("t0")) & (t <= F.col("t1")))
        .groupBy(*keys, "__j")
        .agg(F.max(F.exp(-0.5 * F.pow((t - F.col("__c")) / F.col("__s"), 2))).alias("__g"))
    )
    hits = _windows_touching(per_sample, F.col("__j"), F.col("__j") + 1, win, hop)
    aggs = [
        F.sum("__g").alias("__sum"),
        F.max("__g").alias("__max"),
        F.max(F.when(F.col("__j") == F.col("start") + win // 2, F.col("__g"))).alias("__mid"),
    ]
    if "q" in modes.values():
        aggs.append(F.sort_array(F.collect_list("__g")).alias("__all"))  # at most ``win`` values
    per = hits.groupBy(*keys, "start").agg(*aggs)

    h = min(max(q, 0.0), 1.0) * (win - 1)
    lo = int(h)

    def sorted_at(i: int) -> Column:
        zeros = win - F.size("__all")
        return F.when(F.lit(i) < zeros, 0.0).otherwise(F.try_element_at("__all", F.lit(i) - zeros + 1))

    def score(mode: str) -> Column:
        if mode == "center":
            return F.col("__mid")
        if mode == "max":
            return F.col("__max")
        if mode == "q":
            v0, v1 = sorted_at(lo), sorted_at(min(lo + 1, win - 1))
            return v0 + (h - lo) * (v1 - v0)
        return F.col("__sum") / win

    per = per.select(*keys, "start", *[score(m).alias(n) for n, m in modes.items()])
    return windows.join(per, [*keys, "start"], "left").fillna(0.0, subset=list(modes))


def manual_labels(scored: DataFrame, name: str = "y_win") -> DataFrame:
    """Manual window label from ``pt``, ``sp`` and ``amb``: 1 transition, 0 stable, else 0.5."""
    return scored.withColumn(
        name,
        F.when(F.col("pt") >= 0.5, 1.0).when((F.col("sp") >= 0.6) & (F.col("amb") < 0.25), 0.0).otherwise(0.5),
    )


def clear_windows(pt: Column, sp: Column, amb: Column) -> tuple[Column, Column]:
    """Predicates (clear transition, clear stable) used for training and evaluation."""
    calm = amb <= 0.10
    return (pt >= 0.5) & (sp <= 0.05) & calm, (sp >= 0.6) & (pt <= 0.05) & calm


def match_labels(recordings: DataFrame, labels: DataFrame, win: int, on: str = "file", static: int = 2) -> DataFrame:
    """Annotated files with the reason they cannot be used: not_found, non_static, too_short or null."""
    reason = (
        F.when(F.col("n").isNull(), "not_found")
        .when(F.col("y") != static, "non_static")
        .when(F.col("n") < win, "too_short")
    )
    return labels.join(recordings, on, "left").withColumn("reject", reason)
