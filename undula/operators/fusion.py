"""Label fusion: manual and automatic tags, window targets, four-class remap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.functions.scalar import isclose, three_state
from undula.operators.segment import DYNAMIC, FALL, STATIC

AUTO, MANUAL = 0, 1


def merge_tags(auto: DataFrame, manual: DataFrame | None, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """One tag per (keys, start): the first manual one, else the last automatic one.

    ``seq`` orders tags of one source. Duplicates fold with a max aggregate (map-side), so any
    number of copies of one window stays cheap.
    """
    keys = list(keys)
    tags = auto.select(*keys, "start", "y_win", seq, F.lit(AUTO).alias("src"))
    if manual is not None:
        tags = tags.unionByName(manual.select(*keys, "start", "y_win", seq, F.lit(MANUAL).alias("src")))
    rank = F.struct("src", F.when(F.col("src") == MANUAL, -F.col(seq)).otherwise(F.col(seq)).alias("o"), "y_win")
    best = tags.groupBy(*keys, "start").agg(F.max(rank).alias("b"))
    return best.select(*keys, "start", three_state(F.col("b.y_win")).alias("y_h2"), F.col("b.src").alias("src_h2"))


def window_targets(
    windows: DataFrame,
    tags: DataFrame,
    keys: Sequence[str],
    manual_weight: float = 1.0,
    auto_weight: float = 0.4,
    ambiguous_weight: float = 0.0,
    ignore_ambiguous: bool = True,
) -> DataFrame:
    """Adds ``y_h2``, ``src_h2`` and ``w_h2`` to windows with class ``y_h1``."""
    amb = F.lit(0.0 if ignore_ambiguous else float(ambiguous_weight))
    found = windows.join(tags, [*keys, "start"], "left")
    use = (F.col("y_h1") == STATIC) & F.col("y_h2").isNotNull()
    y2 = F.when(use, F.col("y_h2")).otherwise(0.5)
    src = F.when(use, F.col("src_h2")).otherwise(AUTO)
    by_source = F.when(src == MANUAL, float(manual_weight)).otherwise(float(auto_weight))
    w2 = F.when(use & ~isclose(F.col("y_h2"), 0.5), by_source).otherwise(amb)
    return found.withColumns({"y_h2": y2, "src_h2": src, "w_h2": w2})


def four_classes(
    df: DataFrame, ambiguous: str = "drop", ambiguous_weight: float = 0.0, check: bool = True
) -> DataFrame:
    """Dual labels to fall 0, dynamic 1, stable 2, transition 3, with a sample ``weight``.

    Undecided static rows are dropped or counted as ``stable``/``transition`` with their own weight.
    """
    if ambiguous not in ("drop", "stable", "transition"):
        raise ValueError("ambiguous must be drop, stable or transition")
    y1, y2 = F.col("y_h1"), F.col("y_h2")
    static = y1 == STATIC
    decided = static & (isclose(y2, 0.0) | isclose(y2, 1.0))
    other = {"drop": -1, "stable": 2, "transition": 3}[ambiguous]
    y = (
        F.when(y1 == FALL, 0)
        .when(y1 == DYNAMIC, 1)
        .when(static & isclose(y2, 0.0), 2)
        .when(static & isclose(y2, 1.0), 3)
        .when(static, other)
        .otherwise(-1)
    )
    weight = (
        F.when(decided & (F.col("w_h2") > 0), F.col("w_h2"))
        .when(static & ~decided, F.lit(max(float(ambiguous_weight), 0.0)))
        .otherwise(1.0)
    )
    out = df.withColumn("y", y).withColumn("weight", weight).filter("y >= 0")
    if check and out.isEmpty():
        raise ValueError("the remap removed all rows")
    return out


def matching_predictions(
    predictions: DataFrame, recordings: DataFrame, labels: DataFrame
) -> DataFrame:
    """Predictions of annotated recordings: joined on (file, code, subject, trial), ignoring case of the
    last three."""
    up: list[Column] = [F.upper(c).alias(c) for c in ("code", "subject", "trial")]
    files = recordings.join(labels.select("file").distinct(), "file").select("file", "n", *up)
    keyed = predictions.select(*[c for c in predictions.columns if c not in ("code", "subject", "trial")], *up)
    return keyed.join(files, ["file", "code", "subject", "trial"])
