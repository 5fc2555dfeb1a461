"""Class counts and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.functions.scalar import isclose
from undula.operators.segment import STATIC
from undula.session import stage


def vocabulary(df: DataFrame, names: dict[int, str], label: str = "y") -> DataFrame:
    rows = [(int(k), v) for k, v in sorted(names.items())]
    return df.sparkSession.createDataFrame(rows, f"{label} int, name string")


def class_counts(df: DataFrame, label: str, names: dict[int, str] | None = None) -> DataFrame:
    """Rows per class; with ``names`` one row per name (0 where absent)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if names is None:
        return counts
    return vocabulary(df, names, label).join(counts, label, "left").fillna(0, subset=["n"])


def _counts_to_largest(df: DataFrame, label: str, n_classes: int = 0) -> DataFrame:
    """Rows for every id from 0 to the largest label (at least n_classes - 1), 0 where absent."""
    counts = stage(class_counts(df, label), "class_counts")
    top = F.greatest(F.max(label).cast("int"), F.lit(n_classes - 1))
    ids = counts.agg(top.alias("m")).filter("m >= 0").select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias(label))
    return ids.join(counts, label, "left").fillna(0, subset=["n"])


def balanced_class_weights(df: DataFrame, label: str, n_classes: int) -> DataFrame:
    """N / (n_classes * n_c) per class id; an empty class is an error."""
    counts = stage(_counts_to_largest(df, label, n_classes), "class_counts")
    total, empty = counts.agg(F.sum("n"), F.count_if(F.col("n") == 0)).first()
    if empty:
        raise ValueError("cannot weight empty classes")
    return counts.withColumn("weight", (F.lit(float(total)) / (n_classes * F.col("n"))).cast("float"))


def inverse_frequency_weights(df: DataFrame, label: str, scale: float = 100.0) -> DataFrame:
    """scale / n_c for every id up to the largest label; ids without rows get 0."""
    weight = F.when(F.col("n") > 0, F.lit(float(scale)) / F.nullif(F.col("n"), F.lit(0))).otherwise(0.0)
    return _counts_to_largest(df, label).select(label, weight.alias("weight"))


def sample_weights(df: DataFrame, label: str, weights: DataFrame) -> DataFrame:
    """Look up the class weight of every row. Pass a staged table: its file size then decides
    whether Spark broadcasts it."""
    return df.join(weights.select(label, "weight"), label)


def positive_weight(y_h1: Column, y_h2: Column) -> Column:
    """Aggregate: negatives / positives over static windows with a 0/1 label, 1 where undefined."""
    static = y_h1 == STATIC
    pos = F.count_if(static & isclose(y_h2, 1.0))
    neg = F.count_if(static & isclose(y_h2, 0.0))
    return F.when(pos == 0, 1.0).otherwise(neg / F.greatest(pos, F.lit(1)))


def dual_split_summary(df: DataFrame, by: str = "split") -> DataFrame:
    """Counts of a dual-label split: head 1 by class, head 2 over static windows."""
    y1, y2, src = F.col("y_h1"), F.col("y_h2"), F.col("src_h2")
    static = y1 == STATIC
    valid = static & ~isclose(y2, 0.5)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y1 == 0).alias("fall"),
        F.count_if(y1 == 1).alias("normal_dynamic"),
        F.count_if(static).alias("normal_static"),
        F.count_if(valid).alias("valid"),
        F.count_if(static & isclose(y2, 0.0)).alias("stable_posture"),
        F.count_if(static & isclose(y2, 1.0)).alias("postural_transition"),
        F.count_if(static & isclose(y2, 0.5)).alias("ambiguous"),
        F.count_if(valid & (src == 1)).alias("manual"),
        F.count_if(valid & (src == 0)).alias("autotag"),
    )


def window_split_summary(df: DataFrame, by: str = "split", label: str = "y", domain: str = "domain") -> DataFrame:
    """Rows, distinct subjects and a map class -> rows per split."""
    per = df.groupBy(by, label, domain).agg(F.count(F.lit(1)).alias("c"))
    classes = per.groupBy(by, label).agg(F.sum("c").alias("c"))
    as_map = classes.groupBy(by).agg(
        F.sum("c").alias("n"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "c")))).alias("class_counts"),
    )
    return as_map.join(per.groupBy(by).agg(F.countDistinct(domain).alias("domain_count")), by)
