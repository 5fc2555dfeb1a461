"""End-to-end jobs: tagging, event datasets, threshold search."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.operators import encode, features, fusion, intervals, search, segment, splits, tagging
from undula.operators.intervals import clear_windows, coverage_score
from undula.session import stage

KINDS = ("transition", "no_transition", "ambiguous")


@dataclass(frozen=True)
class TagWindows:
    """Window and model settings of the tagging job (defaults are fixed values)."""

    fs: float = 200.0
    win: int = 410
    hop: int = 205
    pad_hop: int = 205
    pad_rep: int = 2
    pca_k: int = 16
    tilt_every: int = 16
    l2: float = 2e-3
    steps: int = 2500
    mode: str = "q"
    q: float = 0.8
    sigma_frac: float = 0.40


@dataclass
class TagResult:
    tags: DataFrame
    model: tagging.TagModel
    evaluation: DataFrame
    summary: DataFrame


def context_features(
    samples: DataFrame, keys: Sequence[str], channels: Sequence[str], s: TagWindows, label: str | None = None
) -> DataFrame:
    """Windows inside each recording with ``f`` = 70 context features, ``start`` and window number ``k``.

    All padded windows take part in the scaling. Recording lengths and base features are written once,
    because later steps read them several times; pass ``samples`` staged for the same reason.
    """
    keys = list(keys)
    carry = [label] if label else []
    rec = segment.recording_lengths(samples, keys, *carry)
    rec = stage(segment.long_enough(rec, max(s.win, s.pad_hop)).withColumnRenamed("n", "n0"), "recordings")
    lengths = rec.withColumnRenamed("n0", "n")
    windows = segment.padded_windows(samples, lengths, keys, channels, s.win, s.hop, s.pad_hop, s.pad_rep, carry)
    windows = windows.withColumn("k", F.expr(f"start div {s.hop}"))
    base = features.tilt_step(features.window_features(windows, s.fs, s.tilt_every), keys).join(rec.select(*keys, "n0"), keys)
    base = stage(base.select(*keys, *carry, "start", "k", "n0", F.array(*features.BASE).alias("f")), "base_features")
    scaled = features.robust_scale(base, keys)
    ctx = features.neighbour_context(scaled, keys).withColumn("start", F.col("start") - s.pad_hop * s.pad_rep)
    return segment.inside_signal(ctx, s.win, F.col("n0"))


def clear_rows(covered: DataFrame, win: int, mode: str, q: float = 0.8) -> DataFrame:
    """Rows whose coverage is clearly transition or clearly stable (``clear_pt``, ``clear_sp``)."""
    pt, sp = coverage_score("transition", win, mode, q), coverage_score("no_transition", win, mode, q)
    a, b = clear_windows(pt, sp, coverage_score("ambiguous", win, "mean"))
    return covered.withColumn("clear_pt", a).withColumn("clear_sp", b).filter("clear_pt OR clear_sp")


def manual_tags(
    windows: DataFrame, spans: DataFrame, keys: Sequence[str], fs: float, win: int, hop: int, mode: str = "q", q: float = 0.8, sigma_frac: float = 0.4
) -> DataFrame:
    """Manual window tags: Gaussian transition scores, stable and ambiguous coverage, ``y_win``."""
    tr = spans.filter("kind = 'transition'")
    out = intervals.gaussian_scores(windows, tr, keys, fs, win, hop, {"pt": mode, "pt_max": "max"}, sigma_frac, q)
    out = intervals.window_coverage(out, intervals.sample_ranges(spans, fs), keys, win, hop, KINDS)
    out = out.withColumn("sp", coverage_score("no_transition", win, "mean")).withColumn("amb", coverage_score("ambiguous", win, "mean"))
    return intervals.manual_labels(out)


def tag_recordings(
    samples: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    s: TagWindows = TagWindows(),
    label: str = "y",
    rules: tagging.TagRules = tagging.TagRules(),
) -> TagResult:
    """Features, clear training rows, two models, scores, tags of static recordings, evaluation.

    ``samples`` are read several times: pass a table (or ``stage`` it first), not a long lineage.
    """
    keys = list(keys)
    spans = stage(spans, "spans")  # read four times below
    f = stage(context_features(samples, keys, channels, s, label), "context")
    ranges = intervals.sample_ranges(spans, s.fs)
    labelled = f.join(spans.select(*keys).distinct(), keys, "left_semi")
    covered = intervals.window_coverage(labelled, ranges, keys, s.win, s.hop, KINDS)
    train = clear_rows(covered, s.win, s.mode, s.q).select(
        "f", F.col("clear_pt").cast("double").alias("y_pt"), F.col("clear_sp").cast("double").alias("y_sp")
    )
    model = tagging.fit_tag_model(stage(train, "clear_rows"), s.pca_k, s.l2, s.steps)
    static = f.filter(F.col(label) == segment.STATIC)
    scored = stage(model.score(static).select(*keys, "start", "k", "p_pt", "p_sp"), "scores")
    tags = stage(tagging.tag_windows(scored, keys, "k", rules), "tags")
    seen = tags.join(spans.select(*keys).distinct(), keys, "left_semi")
    judged = clear_rows(intervals.window_coverage(seen, ranges, keys, s.win, s.hop, KINDS), s.win, "mean")
    pred = (F.abs(F.col("y_win") - 1.0) <= 1e-5).cast("int")
    evaluation = tagging.binary_evaluation(judged, F.col("clear_pt").cast("int"), pred, F.col("y_win"), F.col("p_pt"), F.col("p_sp"))
    return TagResult(tags, model, evaluation, tagging.tag_summary(tags, keys[0]))


@dataclass(frozen=True)
class EventSettings:
    """Settings of the dual-label event dataset (defaults are fixed values)."""

    theta: tuple = (61.000, 47.838, 51.000, 324.290, 201.000, 157.838)
    dead_zone: float = 0.5
    win: int = 410
    out_len: int = 2048
    fall_policy: str = "contain_global_max"
    init: str = "x0"
    manual_weight: float = 1.0
    auto_weight: float = 0.4
    ambiguous_weight: float = 0.0
    ignore_ambiguous: bool = True


def event_starts(samples: DataFrame, keys: Sequence[str], channels: Sequence[str], label: str, win: int, policy: str) -> DataFrame:
    """Window starts with the class stride; fall windows follow the fall policy."""
    if policy not in ("contain_global_max", "all"):
        raise ValueError("fall_policy must be contain_global_max or all")
    stride = segment.class_stride(F.col(label), segment.DEFAULT_STRIDES)
    rec = segment.recording_lengths(samples, keys, label)
    if policy == "all":
        return segment.window_starts(rec, keys, win, stride)
    fall: Column = F.col(label) == segment.FALL
    plain = segment.window_starts(rec.filter(~fall), keys, win, stride)
    peaks = segment.global_peak_starts(samples.filter(fall), rec.filter(fall), keys, channels, win, stride, segment.peak_grid(win))
    return plain.unionByName(peaks)


def dual_label_events(
    samples: DataFrame, tags: DataFrame, keys: Sequence[str], channels: Sequence[str], s: EventSettings = EventSettings(), label: str = "y",
    parts: DataFrame | None = None,
) -> DataFrame:
    """Segment, resample, encode and label. ``tags`` come from ``fusion.merge_tags``.

    ``parts`` (keys, split) gives each window the split of its recording.
    """
    keys = list(keys)
    if len(s.theta) != len(channels):
        raise ValueError("theta needs one value per channel")
    starts = event_starts(samples, keys, channels, label, s.win, s.fall_policy).drop("n").withColumnRenamed(label, "y_h1")
    if parts is not None:
        starts = starts.join(parts, keys)
    starts = fusion.window_targets(starts, tags, keys, s.manual_weight, s.auto_weight, s.ambiguous_weight, s.ignore_ambiguous)
    windows = segment.materialise(samples, starts, keys, channels, s.win)
    return encode.encode_windows(windows, s.theta, s.dead_zone, s.init, resample=(s.win, s.out_len, "linear"))


@dataclass(frozen=True)
class SearchData:
    train_per_class: int = 512
    val_per_class: int = 160
    test_per_class: int = 160
    final_test_all: bool = True
    seed: int = 0
    case: str = "official"


def search_data(windows: DataFrame, d: SearchData, length: int) -> DataFrame:
    """Balanced parts for the search: train, val, test_sampled and test_full in ``part``.

    Windows of another length stop the job.
    """
    size = F.size(F.col("x")[0])
    ok = F.when(size == length, True).otherwise(F.raise_error(F.lit("unexpected window length")).cast("boolean"))
    return balanced_parts(splits.prepare_case(windows.filter(ok), d.case, seed=d.seed), d)


def balanced_parts(w: DataFrame, d: SearchData) -> DataFrame:
    """Balanced samples of windows that carry their final ``split``."""
    part = lambda s: w.filter(F.col("split") == s)
    sample = lambda s, n, k: splits.balanced_sample(part(s), "y", "win_id", n, d.seed + k)
    test = sample("test", d.test_per_class, 333)
    parts = {
        "train": sample("train", d.train_per_class, 111),
        "val": sample("val", d.val_per_class, 222),
        "test_sampled": test,
        "test_full": part("test") if d.final_test_all else test,
    }
    out = None
    for name, p in parts.items():
        p = p.withColumn("part", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


def recording_search_data(
    samples: DataFrame, keys: Sequence[str], channels: Sequence[str], d: SearchData, win: int = 410, stride: int = 205,
    fall_policy: str = "contain_peak", label: str = "y",
) -> DataFrame:
    """The same parts from recordings: split the recordings, cut windows, then balance each part."""
    keys = list(keys)
    rec = segment.recording_lengths(samples, keys, label)
    if fall_policy == "contain_peak":
        fall = F.col(label) == segment.FALL
        starts = segment.window_starts(rec.filter(~fall), keys, win, F.lit(stride)).unionByName(
            segment.first_peak_starts(samples.filter(fall), rec.filter(fall), keys, channels[:3], win, F.lit(stride))
        )
    else:
        starts = segment.window_starts(rec, keys, win, F.lit(stride))
    starts = starts.drop("n").withColumn("win_id", F.concat_ws(":", *keys, "start"))
    parted = splits.by_recording_split(rec, starts.drop(label), keys[0], label, seed=d.seed).join(rec.select(*keys, label), keys)
    pick = lambda s, n, k: splits.balanced_sample(parted.filter(F.col("split") == s), label, "win_id", n, d.seed + k)
    test = pick("test", d.test_per_class, 303)
    chosen = {
        "train": pick("train", d.train_per_class, 101),
        "val": pick("val", d.val_per_class, 202),
        "test_sampled": test,
        "test_full": parted.filter("split = 'test'") if d.final_test_all else test,
    }
    out = None
    for name, p in chosen.items():
        p = p.withColumn("part", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return segment.materialise(samples, out, keys, channels, win)


def run_search(
    data: DataFrame, s: search.SearchSettings, names: dict[int, str] | None = None, state: dict | None = None, save: Callable[[dict], None] | None = None
) -> dict:
    """Search on the parts ``train`` and ``val`` and score the best thresholds on all four parts.

    ``data`` has ``part``, ``y`` and ``x``; it is read by every search job, so pass a table. ``state`` and ``save``: see
    ``ThetaSearch.run``.
    """
    part = lambda n: data.filter(F.col("part") == n).select("y", "x")
    result = search.ThetaSearch(part("train"), part("val"), s).run(state, save)
    grid = {c: [t] for c, t in enumerate(result["theta"])}
    result |= {"scores": {}, "rel_err": {}, "n_windows": {}, "event_stats": {}}
    for name in ("train", "val", "test_sampled", "test_full"):
        g = search.grid_errors(part(name), grid, s.in_len, s.out_len, s.dead_zone, s.method, s.init)
        whole = g.groupBy("y").agg(F.sum("err").alias("err"), F.sum("eng").alias("eng"), F.max("n").alias("n")).persist()
        result["scores"][name] = search.objective(whole, s.alpha).first()["score"]
        rows = whole.orderBy("y").collect()  # one row per class
        whole.unpersist()
        result["rel_err"][name] = {r.y: r.err / max(r.eng, 1e-12) for r in rows}
        result["n_windows"][name] = {r.y: r.n for r in rows}
        labels = names or {r.y: str(r.y) for r in rows}
        coded = encode.encode_windows(part(name), result["theta"], s.dead_zone, s.init, resample=(s.in_len, s.out_len, s.method))
        stats = search.event_statistics(coded.select("y", "n_events"), labels)
        result["event_stats"][name] = {r.name: {"mean": r.mean, "std": r.std, "n": r.n} for r in stats.collect()}
    return result


def search_thresholds(windows: DataFrame, d: SearchData, theta0: Sequence[float], in_len: int, out_len: int, **settings) -> dict:
    """Prepare the parts of a window table and run the search."""
    data = stage(search_data(windows, d, in_len), "search_data")
    settings.setdefault("theta_max", [10.0 * t for t in theta0])
    return run_search(data, search.SearchSettings(theta0=theta0, in_len=in_len, out_len=out_len, **settings))
