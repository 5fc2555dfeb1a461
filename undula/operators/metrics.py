"""Evaluation over scored tables and training logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.functions.scalar import argmax_label, isclose
from undula.operators.segment import STATIC
from undula.operators.sequence import Run, prefixes
from undula.session import stage


def confusion_counts(df: DataFrame, labels: Sequence[int], truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """All cells of the confusion table over ``labels``: y_true, y_pred, n, share of the true class."""
    grid = df.sparkSession.createDataFrame([(int(t), int(p)) for t in labels for p in labels], "y_true int, y_pred int")
    got = df.groupBy(F.col(truth).cast("int").alias("y_true"), F.col(pred).cast("int").alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )
    got = stage(grid.join(got, ["y_true", "y_pred"], "left").fillna(0, subset=["n"]), "confusion")
    rows = got.groupBy("y_true").agg(F.sum("n").alias("__r"))
    share = F.when(F.col("__r") == 0, 0.0).otherwise(F.col("n") / F.col("__r"))
    return got.join(rows, "y_true").select("y_true", "y_pred", "n", share.alias("share"))


def confusion_matrix(cells: DataFrame, labels: Sequence[int], value: str = "n") -> DataFrame:
    """Matrix form of ``confusion_counts``: one row per true label, one column per predicted label."""
    return cells.groupBy("y_true").pivot("y_pred", [int(v) for v in labels]).agg(F.first(value))


def classification_report(
    df: DataFrame, names: dict[int, str], truth: str = "y_true", pred: str = "y_pred"
) -> DataFrame:
    """Per-class precision, recall, F1 and support; accuracy; macro and weighted averages.

    Undefined ratios are 0. The input is reduced to its confusion counts first.
    """
    cells = stage(
        df.groupBy(F.col(truth).cast("int").alias("t"), F.col(pred).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")),
        "report",
    )
    vocab = df.sparkSession.createDataFrame([(int(k), v) for k, v in sorted(names.items())], "label int, name string")
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("label"), F.col("n").alias("support"), zero.alias("np"), hit.cast("bigint").alias("tp")),
                F.struct(F.col("p").alias("label"), zero.alias("support"), F.col("n").alias("np"), zero.alias("tp")),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "np", "tp")])
    per = (
        vocab.join(sums, "label", "left")
        .fillna(0, subset=["support", "np", "tp"])
        .select(
            "name",
            ratio(F.col("tp"), F.col("np")).alias("precision"),
            ratio(F.col("tp"), F.col("support")).alias("recall"),
            ratio(2 * F.col("tp"), F.col("np") + F.col("support")).alias("f1"),
            "support",
        )
    )
    score = ["precision", "recall", "f1"]
    total = F.sum("support")
    macro = per.agg(*[F.avg(c).alias(c) for c in score], total.alias("support"))
    weighted = per.agg(*[ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in score], total.alias("support"))
    acc = cells.filter(F.col("t").isin([int(k) for k in names])).agg(F.sum(hit).alias("h"), F.sum("n").alias("support"))
    a = ratio(F.col("h"), F.col("support"))
    return (
        per.unionByName(acc.select(F.lit("accuracy").alias("name"), *[a.alias(c) for c in score], "support"))
        .unionByName(macro.select(F.lit("macro avg").alias("name"), *score, "support"))
        .unionByName(weighted.select(F.lit("weighted avg").alias("name"), *score, "support"))
    )


def epoch_metrics(batches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Epoch figures from per-batch rows (loss, loss_h1, loss_h2, n, h1_correct, h2_correct, n_h2)."""
    n = F.greatest(F.sum("n"), F.lit(1))
    h2 = F.sum("n_h2")
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / n).alias(c)
    return batches.groupBy(*by).agg(
        mean("loss"),
        mean("loss_h1"),
        mean("loss_h2"),
        (F.sum("h1_correct") / n).alias("acc_h1"),
        F.when(h2 > 0, F.sum("h2_correct") / F.greatest(h2, F.lit(1))).otherwise(F.lit(float("nan"))).alias("acc_h2"),
        F.sum("n").alias("total"),
        h2.alias("total_h2"),
    )


def dual_head_counts(df: DataFrame, logits: str = "logits", z: str = "z", by: Sequence[str] = ()) -> DataFrame:
    """Correct counts of both heads; head 2 counts static rows with a decided, weighted label."""
    valid = (F.col("y_h1") == STATIC) & ~isclose(F.col("y_h2"), 0.5) & (F.col("w_h2") > 0)
    pred = F.when(F.col(z) >= 0, 1.0).otherwise(0.0)  # sigmoid(z) >= 0.5
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(argmax_label(F.col(logits)) == F.col("y_h1")).alias("h1_correct"),
        F.count_if(valid & (pred == F.col("y_h2"))).alias("h2_correct"),
        F.count_if(valid).alias("n_h2"),
    )


def training_history(log: DataFrame, run: str, epoch: str, loss: str, patience: int, width: int = 100_000) -> DataFrame:
    """Adds ``best`` (lowest loss so far), ``improved``, ``bad_epochs`` and ``stop`` (first epoch at which
    ``patience`` logged epochs in a row brought nothing) and drops the epochs after it.

    A loss that is NaN or null never improves; before the first real loss ``best`` is null. Epochs are
    counted as rows, so a log with gaps counts what it holds.
    """
    real = F.when(F.col(loss).isNotNull() & ~F.isnan(F.col(loss).cast("double")), F.struct(F.col(loss).alias("loss"), F.col(epoch).alias("epoch")))
    bucket = F.floor(F.col(epoch) / width)
    h = prefixes(log, [run], [epoch], bucket, {"__b": Run("min", real), "__n": Run("sum", F.lit(1))})
    h = h.withColumns({"best": F.col("__b.loss"), "best_epoch": F.col("__b.epoch")}).drop("__b")
    h = h.withColumn("improved", F.coalesce(F.col("best_epoch") == F.col(epoch), F.lit(False)))
    at = Run("max", F.when(F.col("improved"), F.col("__n")))
    h = prefixes(h, [run], [epoch], bucket, {"__at": at})
    h = h.withColumn("bad_epochs", (F.col("__n") - F.coalesce("__at", F.lit(0))).cast(log.schema[epoch].dataType)).drop("__n", "__at")
    stops = h.filter(F.col("bad_epochs") >= patience).groupBy(run).agg(F.min(epoch).alias("stop"))
    return h.join(stops, run, "left").filter(F.col("stop").isNull() | (F.col(epoch) <= F.col("stop")))

