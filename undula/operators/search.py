"""Encoder threshold search.

Channels are encoded independently, so the class errors of a threshold vector are sums of per-channel
errors. One Spark job evaluates every (channel, threshold) that is still unknown; the descent itself
reads only the small table (class, channel, threshold) -> error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.operators import kernels as K
from undula.operators.quantiles import exact_quantiles
from undula.session import ship_package

GRID_SCHEMA = "y int, channel int, theta float, err double, eng double, n bigint, events bigint"


def grid_errors(
    windows: DataFrame,
    grid: dict[int, Sequence[float]],
    in_len: int,
    out_len: int,
    dead_zone: float = 0.5,
    method: str = "linear",
    init: str = "x0",
    label: str = "y",
) -> DataFrame:
    """Reconstruction error, signal energy, windows and events per (class, channel, threshold).

    Every task resamples its windows once, encodes all thresholds of a channel together, reads the
    reconstruction back at the sample times and sums per class; only these sums are shuffled.
    """
    grid = {int(c): np.unique(np.asarray(v, np.float32)) for c, v in grid.items()}
    widest = max(len(v) for v in grid.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = K.make_resampler(in_len, out_len, method)
        back = K.make_back_resampler(in_len, out_len, method)
        for part, x in K.window_slices(batches, "x", 4.0 * widest * out_len / in_len):
            y = part.column("y").to_numpy()
            out = []
            for c, th in grid.items():
                ref = x[:, c]
                dense = up(ref)
                start = dense[:, :1] if init == "x0" else np.zeros((len(ref), 1), np.float32)
                ev, _, tr = K.delta_events(dense[:, None, :], th, np.float32(dead_zone) * th, start, True)
                diff = (ref[:, None, :] - back(tr)).astype(np.float64)
                err = (diff * diff).sum(2)
                eng = (ref.astype(np.float64) ** 2).sum(1)
                n_ev = np.count_nonzero(ev, axis=2)
                for k in np.unique(y):
                    m = y == k
                    for j, t in enumerate(th):
                        out.append((k, c, t, err[m, j].sum(), eng[m].sum(), int(m.sum()), int(n_ev[m, j].sum())))
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(out, columns=["y", "channel", "theta", "err", "eng", "n", "events"]).astype(
                    {"y": "int32", "channel": "int32", "theta": "float32"}
                ),
                preserve_index=False,
            )

    ship_package(windows.sparkSession)
    parts = windows.select(F.col(label).cast("int").alias("y"), "x").mapInArrow(run, GRID_SCHEMA)
    return parts.groupBy("y", "channel", "theta").agg(
        F.sum("err").alias("err"), F.sum("eng").alias("eng"), F.sum("n").alias("n"), F.sum("events").alias("events")
    )


def class_errors(windows: DataFrame, by: str = "y", ref: str = "ref", got: str = "got") -> DataFrame:
    """Objective partials per class from long rows: error and signal energy."""
    d = F.col(ref).cast("double") - F.col(got).cast("double")
    return windows.groupBy(by).agg(
        F.sum(d * d).alias("err"), F.sum(F.col(ref).cast("double") * F.col(ref)).alias("eng"), F.count(F.lit(1)).alias("n")
    )


def objective(partials: DataFrame, alpha: float = 0.0) -> DataFrame:
    """mean + alpha * max over present classes of err / max(eng, 1e-12)."""
    rel = F.col("err") / F.greatest(F.col("eng"), F.lit(1e-12))
    return partials.filter("n > 0").agg((F.avg(rel) + F.lit(float(alpha)) * F.max(rel)).alias("score"))


def event_statistics(per_window: DataFrame, names: dict[int, str], label: str = "y", value: str = "n_events") -> DataFrame:
    """Mean, population deviation and windows per class (0 where absent) and over all (null class)."""
    v = F.col(value).cast("double")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.avg(v * v) - F.avg(v) * F.avg(v)))
    got = (
        per_window.groupingSets([[F.col(label)], []], F.col(label))
        .agg(F.avg(v).alias("mean"), spread.alias("std"), F.count(F.lit(1)).alias("n"))
        .withColumnRenamed(label, "__c")
    )
    vocab = per_window.sparkSession.createDataFrame(
        [(int(k), n) for k, n in sorted(names.items())] + [(None, "global")], f"{label} int, name string"
    )
    return (
        vocab.join(got, F.col(label).eqNullSafe(F.col("__c")), "left").drop("__c").fillna(0, subset=["mean", "std", "n"])
    )


def channel_values(df: DataFrame, channels: Sequence[str] | None = None) -> DataFrame:
    """Long rows (channel, |value|) from sample columns, or from packed windows ``x`` without ``channels``."""
    if channels is not None:
        values = F.array(*[F.abs(F.col(c).cast("double")) for c in channels])
        return df.select(F.posexplode(values).alias("channel", "a"))
    per = df.select(F.posexplode("x").alias("channel", "v"))
    return per.select("channel", F.explode("v").alias("v")).select("channel", F.abs(F.col("v").cast("double")).alias("a"))


def theta_ceiling(
    values: DataFrame, theta0: Sequence[float], scale: float, floor: float = 0.0, margin: float = 1.0, pct: float = 95.0,
    override: Sequence[float] | None = None,
) -> DataFrame:
    """Largest threshold per channel: max(floor, scale * p95(|x|), margin * theta0), or the override.

    ``values`` comes from ``channel_values``. A channel holds a share of all samples, so the quantile is
    found by rank selection.
    """
    if override is not None:
        rows = [(i, float(v)) for i, v in enumerate(override)]
        return values.sparkSession.createDataFrame(rows, "channel int, theta_max double")
    t0 = F.element_at(F.array(*[F.lit(float(t)) for t in theta0]), F.col("channel") + 1)
    amp = exact_quantiles(values, ["channel"], "a", {"amp": pct / 100.0})
    return amp.select("channel", F.greatest(F.lit(float(floor)), scale * F.col("amp"), margin * t0).alias("theta_max"))


def clip_theta(theta: float, lo: float, hi: float, decimals: int) -> float:
    v = np.round(np.clip(np.float32(theta), np.float32(lo), np.float32(hi)), decimals)
    return float(np.clip(v, np.float32(lo), np.float32(hi)).astype(np.float32))


@dataclass
class SearchSettings:
    theta0: Sequence[float]
    theta_max: Sequence[float]
    in_len: int
    out_len: int
    dead_zone: float = 0.5
    method: str = "linear"
    init: str = "x0"
    theta_min: float = 1e-4
    init_step: float = 0.02
    min_step: float = 5e-4
    step_shrink: float = 0.5
    decimals: int = 4
    alpha: float = 0.0
    max_epochs: int = 120
    patience_global: int = 18
    patience_step: int = 4
    improve_tol: float = 1e-7
    look_ahead: int = 2


@dataclass
class ThetaSearch:
    """Coordinate descent over encoder thresholds on the tables ``train`` and ``val`` (``y``, ``x``)."""

    train: DataFrame
    val: DataFrame
    s: SearchSettings
    memo: dict = field(default_factory=dict)
    energy: dict = field(default_factory=dict)
    jobs: int = 0

    def _load(self, split: str, wanted: dict[int, set]) -> None:
        todo = {c: [t for t in v if (split, c, t) not in self.memo] for c, v in wanted.items()}
        todo = {c: v for c, v in todo.items() if v}
        if not todo:
            return
        table = self.train if split == "train" else self.val
        s = self.s
        rows = grid_errors(table, todo, s.in_len, s.out_len, s.dead_zone, s.method, s.init).collect()
        self.jobs += 1
        if not rows:
            raise ValueError(f"split {split} has no windows")
        for r in rows:  # classes x channels x thresholds of one step
            self.memo.setdefault((split, r["channel"], float(np.float32(r["theta"]))), {})[r["y"]] = r["err"]
            self.energy.setdefault((split, r["channel"]), {})[r["y"]] = r["eng"]

    def _score(self, split: str, theta: Sequence[float]) -> float:
        parts = [self.memo[(split, c, t)] for c, t in enumerate(theta)]
        eng = [self.energy[(split, c)] for c in range(len(theta))]
        rel = [sum(p[k] for p in parts) / max(sum(e[k] for e in eng), 1e-12) for k in parts[0]]
        return float(np.mean(rel) + self.s.alpha * np.max(rel))

    def _near(self, theta: Sequence[float], step: float) -> dict[int, set]:
        reach = range(-self.s.look_ahead, self.s.look_ahead + 1)
        return {c: {self._clip(c, t + m * step) for m in reach} | {t} for c, t in enumerate(theta)}

    def _clip(self, c: int, v: float) -> float:
        return clip_theta(v, self.s.theta_min, self.s.theta_max[c], self.s.decimals)

    def run(self, state: dict | None = None, save: Callable[[dict], None] | None = None) -> dict:
        """The best thresholds with their history. ``save`` is given the state after every epoch; a search that goes on
        from such a ``state`` takes the same steps as one that never stopped."""
        s = self.s
        n = len(s.theta0)
        if state is None:
            theta = [self._clip(c, t) for c, t in enumerate(s.theta0)]
            step = float(np.round(s.init_step, s.decimals))
            self._load("train", self._near(theta, step))
            self._load("val", {c: {t} for c, t in enumerate(theta)})
            train, val = self._score("train", theta), self._score("val", theta)
            best = {"theta": list(theta), "val": val, "epoch": 0, "train": train}
            history = [(0, step, list(theta), train, val, val, "initial")]
            state = {"epoch": 0, "theta": theta, "step": step, "train": train, "best": best, "history": history, "stale": 0, "stale_step": 0, "done": False}
        elif not state["done"]:
            self._load("train", self._near(state["theta"], state["step"]))
        state = {**state, "theta": list(state["theta"]), "history": [tuple(h) for h in state["history"]]}
        while not state["done"] and state["epoch"] < s.max_epochs:
            state = self._epoch(state, n)
            if save is not None:
                save(state)
            if not state["done"] and state["epoch"] < s.max_epochs:
                self._load("train", self._near(state["theta"], state["step"]))
        return {**state["best"], "history": state["history"], "jobs": self.jobs}

    def _epoch(self, state: dict, n: int) -> dict:
        """One pass over the channels, then the validation score and the rules for step and stop."""
        s, epoch, theta, step, train = self.s, state["epoch"] + 1, list(state["theta"]), state["step"], state["train"]
        before, best, stale, stale_step = train, state["best"], state["stale"], state["stale_step"]
        for c in range(n):
            tries = [self._clip(c, theta[c] - step), self._clip(c, theta[c] + step)]
            self._load("train", {c: set(tries)} if any(("train", c, t) not in self.memo for t in tries) else {})
            pick, low = theta[c], train
            for t in tries:
                cand = self._score("train", [*theta[:c], t, *theta[c + 1 :]])
                if cand + s.improve_tol < low:
                    pick, low = t, cand
            if low < train:
                theta[c], train = pick, low
        self._load("val", {c: {t} for c, t in enumerate(theta)})
        val = self._score("val", theta)
        if val + s.improve_tol < best["val"]:
            best = {"theta": list(theta), "val": val, "epoch": epoch, "train": train}
            stale = stale_step = 0
            status = "improved"
        else:
            stale, stale_step, status = stale + 1, stale_step + 1, "no_improvement"
            if stale_step >= s.patience_step:
                step, stale_step = max(s.min_step, float(np.round(step * s.step_shrink, s.decimals))), 0
        history = [*state["history"], (epoch, step, list(theta), train, val, best["val"], status)]
        done = stale >= s.patience_global or (step <= s.min_step and train >= before)
        return {"epoch": epoch, "theta": theta, "step": step, "train": train, "best": best, "history": history, "stale": stale, "stale_step": stale_step, "done": done}
