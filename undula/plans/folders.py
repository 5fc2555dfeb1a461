"""Jobs from input folders to output folders, with reuse of results of the same configuration."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.operators import encode, energy, fusion, intervals, search, segment, splits, tagging, weights
from undula.plans import jobs
from undula.session import stage
from undula.sources import annotations, store, text

# Default encoder steps of the phone windows, and the search defaults per data kind.
PHONE_THETA = (0.151215, 0.297011, 0.135961, 0.091156, 0.067695, 0.066330)
SEARCH_DEFAULTS = {
    "recordings": dict(
        in_len=410, theta0=(41.000, 47.838, 51.000, 274.290, 161.000, 157.838), init_step=10.0, min_step=9e-4, decimals=3,
        max_scale=0.5, train_per_class=682, val_per_class=170, test_per_class=170, max_epochs=200, patience_global=20, patience_step=5,
    ),
    "windows": dict(
        in_len=128, theta0=(0.381, 0.4185323, 0.2887801, 0.281, 0.180, 0.154), init_step=0.020, min_step=5e-4, decimals=4,
        max_scale=1.25, train_per_class=512, val_per_class=160, test_per_class=160, max_epochs=120, patience_global=18, patience_step=4,
    ),
}
SEARCH_SHARED = dict(alpha=0.5, theta_min=1e-3, max_pct=95.0, max_floor=0.02, max_margin=1.75)
# Configuration keys shown in the run comparison.
CONFIG_KEYS = (
    "model_name", "head_mode", "spiking_heads", "n_ch", "n_classes", "conv_ch", "kernels", "strides", "pool_kernels", "pool_strides",
    "pool_paddings", "tau", "thresh", "hard_reset", "p_drop", "merge_polarities", "offset_hidden", "head_rate_scale", "batch_size",
    "case", "target_domain", "ups", "raw_win", "out_win", "dead_zone", "theta", "cache_name", "single_ambiguous",
)


# Configuration keys accepted under another name.
ALIASES = {
    "ds_grav": "tilt_every", "ywin_mode": "mode", "ywin_q": "q", "use_hyst": "use_hysteresis", "th_pt_on": "pt_on", "th_pt_off": "pt_off",
    "th_sp_on": "sp_on", "th_sp_off": "sp_off", "theta_sd": "theta", "sd_init": "init", "interp_method": "method",
    "autotag_weight": "auto_weight", "window_stride": "stride", "acc_sensor": "acc",
}


def resolve(defaults: Any, config: dict, section: str | None = None, given: dict | None = None) -> Any:
    """Settings object with values from, in rising order: defaults, JSON root, JSON section, arguments."""
    names = {f.name for f in dataclasses.fields(defaults)}
    layers = [config, config.get(section, {}) if section else {}, {k: v for k, v in (given or {}).items() if v is not None}]
    values = {}
    for layer in layers:
        for k, v in layer.items():
            k = k if k in names else ALIASES.get(k, k)
            if k in names:
                values[k] = tuple(v) if isinstance(v, list) else v
    return dataclasses.replace(defaults, **values)


def one_row(df: DataFrame) -> dict:
    return df.first().asDict()


def tag_folder(
    spark: SparkSession, data: str, labels: str, out: str, windows: jobs.TagWindows = jobs.TagWindows(),
    rules: tagging.TagRules = tagging.TagRules(), acc: str = "ADXL345", refresh: bool = False,
) -> dict:
    """Tag recordings below ``data`` with the annotations in ``labels``.

    Writes automatic and manual tags (``kind`` = auto/manual), the model and a summary; returns the
    summary. A result of the same configuration is reused.
    """
    config = {"windows": windows, "rules": rules, "acc": acc, "data": data, "labels": labels}
    if not refresh and store.is_current(spark, out, config, ("auto",)):
        return store.read_json(spark, f"{out}/summary")
    # a recording is its path; annotations name files, and go to every recording of that name
    keys = ["path"]
    report = stage(text.file_report(spark, data), "files")
    samples = stage(text.read_recordings(spark, data, acc, report), "samples")
    docs = stage(annotations.read_annotations(spark, labels), "labels")
    rec = stage(segment.recording_lengths(samples, keys, "file", "code", "subject", "trial", "y"), "recordings")
    spans = stage(annotations.intervals(docs).join(rec.select("path", "file"), "file").drop("file"), "spans")
    result = jobs.tag_recordings(samples, spans, keys, text.CHANNELS, windows, "y", rules)

    matched = intervals.match_labels(rec, docs.select("file"), windows.win, static=segment.STATIC)
    used = matched.filter("reject IS NULL").select("path", "n")
    grid = segment.window_starts(used, keys, windows.win, F.lit(windows.hop)).drop("n")
    manual = jobs.manual_tags(grid, spans, keys, windows.fs, windows.win, windows.hop, windows.mode, windows.q, windows.sigma_frac)
    manual = stage(manual.select("path", "start", "pt", "pt_max", "sp", "amb", "y_win"), "manual")

    both = result.tags.withColumn("kind", F.lit("auto")).unionByName(manual.withColumn("kind", F.lit("manual")), allowMissingColumns=True)
    named = both.join(rec.select("path", "file", "code", "subject", "trial"), "path")
    rejects = text.reject_counts(report)
    reasons = matched.filter("reject IS NOT NULL").groupBy("reject").agg(F.count(F.lit(1)).alias("n"))
    summary = {
        "config_id": store.config_id(config),
        "raw_data": {"recordings": rec.count(), "rejected": {r.reject: r.n for r in rejects.collect()}},
        "manual_annotations": {"files": docs.count(), "skipped": {r.reject: r.n for r in reasons.collect()}},
        "manual_records": one_row(tagging.tag_summary(manual, "path")),
        "autotagged_records": one_row(result.summary),
        "training_windows": result.model.training_windows,
        "evaluation": one_row(result.evaluation),
        "config": config,
    }
    m = result.model
    model = {"mu": m.mu, "sd": m.sd, "projection": None if m.pca is None else m.pca.pc.toArray()}
    for name, fit in (("transition", m.pt), ("stable", m.sp)):
        model[name] = {"weights": fit.coefficients.toArray(), "bias": fit.intercept}
    store.write_json(spark, model, f"{out}/model")
    store.write_json(spark, summary, f"{out}/summary")
    store.save_splits(named, out, config, by="kind")
    return store.read_json(spark, f"{out}/summary")


def recording_events_folder(
    spark: SparkSession, data: str, tags: str, out: str, settings: jobs.EventSettings = jobs.EventSettings(),
    fractions: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 0, acc: str = "ADXL345", refresh: bool = False,
) -> DataFrame:
    """Dual-label event dataset of recordings; ``tags`` is an output folder of ``tag_folder``."""
    config = {"events": settings, "fractions": fractions, "seed": seed, "acc": acc, "data": data, "tags": tags}

    def build() -> DataFrame:
        samples = stage(text.read_recordings(spark, data, acc, text.file_report(spark, data)), "samples")
        seen = store.load_splits(spark, tags).select("path", "start", "y_win", "kind").withColumn("seq", F.lit(0))
        kind = lambda k: seen.filter(F.col("kind") == k).drop("kind")
        merged = fusion.merge_tags(kind("auto"), kind("manual"), ["path"])
        rec = stage(segment.recording_lengths(samples, ["path"], "file", "y"), "recordings")
        parts = stage(splits.stratified_split(rec.select("path", "y"), "y", "path", fractions, seed).select("path", "split"), "parts")
        out = jobs.dual_label_events(samples, merged, ["path"], text.CHANNELS, settings, "y", parts)
        return out.join(rec.select("path", "file"), "path")

    return store.load_or_build(spark, out, config, splits.PARTS, build, refresh)


@dataclass(frozen=True)
class WindowEvents:
    """Settings of the fixed-window event dataset (defaults are fixed values)."""

    case: str = "random"
    target_domain: int = 0
    split: tuple = (0.8, 0.1, 0.1)
    val_ratio: float = 0.1
    seed: int = 0
    raw_win: int = 128
    ups: float = 5.0
    out_win: int | None = None
    method: str = "linear"
    theta: tuple = PHONE_THETA
    dead_zone: float = 0.5
    init: str = "x0"

    @property
    def steps(self) -> int:
        return self.out_win or scaled_length(self.raw_win, self.ups)


def scaled_length(in_len: int, factor: float, min_len: int = 2) -> int:
    """Output length as a plain number (half to even)."""
    if factor <= 0:
        raise ValueError("factor must be positive")
    return max(round(in_len * factor), min_len)


def prepare_windows_folder(spark: SparkSession, root: str, out: str, s: WindowEvents = WindowEvents(), refresh: bool = False) -> DataFrame:
    """Prepared splits of a window set without encoding."""

    def build() -> DataFrame:
        w = stage(text.read_official(spark, root, length=s.raw_win), "windows")
        return splits.prepare_case(w, s.case, "y", "win_id", s.target_domain, s.split, s.val_ratio, s.seed)

    return store.load_or_build(spark, out, {"prepare": s, "root": root}, ("train", "val", "test"), build, refresh)


def window_events_folder(spark: SparkSession, root: str, out: str, s: WindowEvents = WindowEvents(), refresh: bool = False) -> DataFrame:
    """Single-task event dataset of a window set."""

    def build() -> DataFrame:
        w = stage(text.read_official(spark, root, length=s.raw_win), "windows")
        w = splits.prepare_case(w, s.case, "y", "win_id", s.target_domain, s.split, s.val_ratio, s.seed)
        return encode.encode_windows(w, s.theta, s.dead_zone, s.init, resample=(s.raw_win, s.steps, s.method))

    if len(s.theta) != len(text.SIGNALS):
        raise ValueError("theta needs one value per channel")
    return store.load_or_build(spark, out, {"events": s, "root": root}, ("train", "val", "test"), build, refresh)


@dataclass(frozen=True)
class SearchJob:
    """Parameters of a threshold search; ``None`` takes the default of the data kind."""

    dataset: str
    ups: float
    dead_zone: float
    out_len: int | None = None
    method: str = "linear"
    init: str = "x0"
    theta0: tuple | None = None
    theta_max: tuple | None = None
    stride: int = 205
    fall_policy: str = "contain_peak"
    acc: str = "ADXL345"
    case: str = "random"
    target_domain: int = 0
    split: tuple = (0.8, 0.1, 0.1)
    val_ratio: float = 0.1
    seed: int = 0
    final_test_all: bool = True
    overrides: dict = field(default_factory=dict)  # any entry of SEARCH_DEFAULTS or SEARCH_SHARED

    @property
    def values(self) -> dict:
        return {**SEARCH_SHARED, **SEARCH_DEFAULTS[self.dataset], **{k: v for k, v in self.overrides.items() if v is not None}}

    @property
    def steps(self) -> int:
        if self.out_len:
            return self.out_len
        n = self.values["in_len"]
        pinned = self.dataset == "recordings" and n == 410 and abs(self.ups - 5.0) < 1e-12
        return 2048 if pinned else scaled_length(n, self.ups)


def search_folder(spark: SparkSession, data: str, out: str, job: SearchJob, refresh: bool = False) -> dict:
    """Search encoder thresholds; a finished search of the same parameters is returned as stored."""
    config = {"job": job, "data": data}
    if not refresh and store.exists(spark, f"{out}/result"):
        done = store.read_json(spark, f"{out}/result")
        if done["config_id"] == store.config_id(config):
            return done
    v = job.values
    theta0 = tuple(job.theta0 or v["theta0"])
    if len(theta0) != len(text.CHANNELS):
        raise ValueError("theta needs one value per channel")
    d = jobs.SearchData(v["train_per_class"], v["val_per_class"], v["test_per_class"], job.final_test_all, job.seed, job.case)
    if job.dataset == "recordings":
        samples = stage(text.read_recordings(spark, data, job.acc), "samples")
        parts = jobs.recording_search_data(samples, ["path"], text.CHANNELS, d, v["in_len"], job.stride, job.fall_policy)
    else:
        w = stage(text.read_official(spark, data, length=v["in_len"]), "windows")
        w = splits.prepare_case(w, job.case, "y", "win_id", job.target_domain, job.split, job.val_ratio, job.seed)
        parts = jobs.balanced_parts(w, d)
    parts = stage(parts, "search_data")
    values = search.channel_values(parts.filter("part = 'train'"))
    ceiling = search.theta_ceiling(values, theta0, v["max_scale"], v["max_floor"], v["max_margin"], v["max_pct"], job.theta_max)
    theta_max = [r.theta_max for r in ceiling.orderBy("channel").collect()]  # one row per channel
    names = ("init_step", "min_step", "decimals", "max_epochs", "patience_global", "patience_step", "alpha", "theta_min", "step_shrink", "improve_tol")
    s = search.SearchSettings(
        theta0, theta_max, v["in_len"], job.steps, job.dead_zone, job.method, job.init, **{k: v[k] for k in names if k in v}
    )
    # an unfinished search of the same configuration goes on after its last epoch
    held = store.read_json(spark, f"{out}/state") if not refresh and store.exists(spark, f"{out}/state") else {}
    state = held.get("state") if held.get("config_id") == store.config_id(config) else None
    save = lambda now: store.write_json(spark, {"config_id": store.config_id(config), "state": now}, f"{out}/state")
    result = jobs.run_search(parts, s, state=state, save=save)
    result |= {"config_id": store.config_id(config), "theta_max": theta_max, "out_len": job.steps, "config": config}
    store.write_json(spark, result, f"{out}/result")
    return store.read_json(spark, f"{out}/result")


def energy_folder(
    spark: SparkSession, runs: str, calls: str, out: str, name: str | None = None, data_movement: bool = True, prefix: str = "energy"
) -> DataFrame:
    """Energy report of run folders from their per-call layer counters (Parquet at ``calls``).

    ``calls`` has run, layer, group, kind, macs, input_nonzero, input_numel, lif_nonzero, lif_numel and,
    once per batch, n_samples on rows of layer ''. Writes the layer table and the ranked comparison.
    """
    config = store.find_runs(spark, runs, name).withColumnRenamed("run_name", "run")
    test = store.run_files(spark, runs, "metrics/test_metrics.json").withColumnRenamed("run_name", "run").drop("run_dir")
    c = spark.read.parquet(calls).join(config.select("run"), "run", "left_semi")
    samples = c.filter("layer = ''").groupBy("run").agg(F.sum("n_samples").alias("n_samples"))
    layers = stage(energy.with_energy(energy.layer_totals(c.filter("layer <> ''")), data_movement), "layers")
    report = stage(energy.energy_report(layers, samples), "report")
    comparison = energy.ranked_runs(energy.run_comparison(report, config, test, CONFIG_KEYS, layers=layers))
    comparison = stage(comparison.orderBy("place"), "comparison")
    store.save_csv([layers], f"{out}/{prefix}_layers")
    store.save_csv([comparison], f"{out}/{prefix}_summary")
    store.save_rows_json(comparison, f"{out}/{prefix}_summary_json")
    return comparison


def split_summary(dataset: DataFrame) -> DataFrame:
    """Counts per split of an event dataset of either kind."""
    return weights.dual_split_summary(dataset) if "y_h1" in dataset.columns else weights.window_split_summary(dataset)
