"""Losses of a scored table as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.functions.scalar import isclose
from undula.operators.segment import STATIC


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def cross_entropy(logits: Column, y: Column, class_weight: Sequence[float] | None = None, smoothing: float = 0.0) -> Column:
    """Per-row cross-entropy from logits by log-sum-exp, with class weights and label smoothing."""
    top = F.array_max(logits)
    lse = top + F.log(_total(F.transform(logits, lambda v: F.exp(v - top))))
    cw = None if class_weight is None else F.array(*[F.lit(float(w)) for w in class_weight])
    at = y.cast("int") + 1
    loss = lse - F.element_at(logits, at)
    if cw is not None:
        loss = loss * F.element_at(cw, at)
    if smoothing <= 0:
        return loss
    each = F.transform(logits, lambda v: lse - v)
    if cw is not None:
        each = F.zip_with(each, cw, lambda e, w: e * w)
    return (1.0 - smoothing) * loss + _total(each) * smoothing / F.size(logits)


def head1_loss(df: DataFrame, logits: str, y: str, class_weight: Sequence[float] | None = None, smoothing: float = 0.0) -> DataFrame:
    """Mean loss of head 1; with class weights the divisor is the sum of the weights met."""
    ce = F.sum(cross_entropy(F.col(logits), F.col(y), class_weight, smoothing))
    if class_weight is None:
        return df.agg((ce / F.count(F.lit(1))).alias("loss"))
    cw = F.array(*[F.lit(float(w)) for w in class_weight])
    return df.agg((ce / F.sum(F.element_at(cw, F.col(y).cast("int") + 1))).alias("loss"))


def weighted_cross_entropy(
    df: DataFrame, logits: str, y: str, weight: str | None = None, class_weight: Sequence[float] | None = None, smoothing: float = 0.0
) -> DataFrame:
    """sum(loss * weight) / max(sum(weight), 1e-8); the plain mean of the losses without weights."""
    ce = cross_entropy(F.col(logits), F.col(y), class_weight, smoothing)
    if weight is None:
        return df.agg(F.avg(ce).alias("loss"))
    return df.agg((F.sum(ce * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1e-8))).alias("loss"))


def head2_loss(
    df: DataFrame,
    z: str = "z",
    y2: str = "y_h2",
    y1: str | None = "y_h1",
    ambiguous_value: float = 0.5,
    ignore_ambiguous: bool = True,
    ambiguous_weight: float = 0.0,
    sample_weight: str | None = None,
    source: str | None = None,
    gold_weight: float = 1.0,
    silver_weight: float = 0.6,
    pos_weight: float | None = None,
) -> DataFrame:
    """Masked, weighted binary cross-entropy from logits with its counts; 0 when no row is valid.

    A sample weight takes the place of the source weight. ``y1`` limits the loss to static rows.
    """
    zc, raw = F.col(z), F.col(y2)
    target = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    static = F.col(y1) == STATIC if y1 else F.lit(True)
    amb = isclose(raw, ambiguous_value)
    valid = static & (~amb if ignore_ambiguous else F.lit(True))
    softplus = F.log1p(F.exp(-F.abs(zc))) + F.greatest(-zc, F.lit(0.0))  # log(1 + exp(-z))
    pw = 1.0 if pos_weight is None else float(pos_weight)
    loss = (1.0 - target) * zc + (1.0 + (pw - 1.0) * target) * softplus
    if sample_weight:
        w = F.col(sample_weight)
    elif source:
        w = F.when(F.col(source).cast("boolean"), float(gold_weight)).otherwise(float(silver_weight))
    else:
        w = F.lit(1.0)
    if not ignore_ambiguous and ambiguous_weight != 1.0:
        w = w * F.when(amb, float(ambiguous_weight)).otherwise(1.0)
    n_valid, w_sum = F.count_if(valid), F.sum(F.when(valid, w).otherwise(0.0))
    total = F.sum(F.when(valid, loss * w).otherwise(0.0))
    return df.agg(
        F.when(n_valid == 0, 0.0).otherwise(total / F.greatest(w_sum, F.lit(1e-8))).alias("loss"),
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(static).alias("n_static"),
        F.count_if(static & amb).alias("n_ambiguous"),
        n_valid.alias("n_valid"),
        F.count_if(valid & (target > 0.5)).alias("n_pos_valid"),
        w_sum.alias("weight_sum"),
    )


def dual_loss(head1: DataFrame, head2: DataFrame, lambda1: float = 1.0, lambda2: float = 1.0) -> DataFrame:
    """lambda1 * loss 1 + lambda2 * loss 2 from the two one-row results."""
    one = head1.select(F.lit(1).alias("__j"), F.col("loss").alias("loss_head1"))
    two = head2.select(F.lit(1).alias("__j"), F.col("loss").alias("loss_head2"), *[c for c in head2.columns if c != "loss"])
    return one.join(two, "__j").drop("__j").withColumn(
        "loss", lambda1 * F.col("loss_head1") + lambda2 * F.col("loss_head2")
    )
