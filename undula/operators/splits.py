"""Splits, balanced samples and label checks.

Random order is the MD5 text of (key, seed): reproducible on any cluster layout. Classes are few and
large, so nothing here puts a class in one task; ranks come from ``sequence_number`` over the leading
hex digits of the hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.functions.scalar import hash_text, hash_uniform
from undula.operators.sequence import sequence_number
from undula.session import stage

PARTS = ("train", "val", "test")
SMALL_POOL, ALL_POOL = range(5), range(30)  # fixed values: subject pools of the two subject cases


def normalise_fractions(fractions: Sequence[float]) -> list[float]:
    v = [float(f) for f in fractions]
    if len(v) != 3 or min(v) < 0 or sum(v) <= 0:
        raise ValueError("need three non-negative fractions with a positive sum")
    return [f / sum(v) for f in v]


def split_sizes(n: Column, fractions: Sequence[float]) -> list[Column]:
    """Integer sizes of the three parts: floors, then one more for the largest remainders.

    Equal remainders favour the later part.
    """
    raw = [F.lit(f) * n for f in normalise_fractions(fractions)]
    base = [F.floor(r).cast("bigint") for r in raw]
    rest = [r - b for r, b in zip(raw, base)]
    spare = n - base[0] - base[1] - base[2]
    out = []
    for i in range(3):
        ahead = F.lit(0)
        for j in range(3):
            if j != i:
                wins = rest[j] >= rest[i] if j > i else rest[j] > rest[i]
                ahead = ahead + wins.cast("int")
        out.append((base[i] + (ahead < spare).cast("bigint")).cast("bigint"))
    return out


def order_in_class(
    df: DataFrame, label: str, key: str, seed: int, name: str = "rn", total: str | None = None
) -> DataFrame:
    """Zero-based position of a row in the random order of its class."""
    h = df.withColumn("__h", hash_text(F.col(key), seed))
    return sequence_number(h, [label], ["__h", key], F.substring("__h", 1, 4), name, total).drop("__h")


def stratified_split(
    df: DataFrame, label: str, key: str, fractions: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 0, name: str = "split"
) -> DataFrame:
    """Adds ``split`` (train/val/test) with exact sizes per class."""
    numbered = order_in_class(df, label, key, seed, "__rn", "__n")
    train, val, _ = split_sizes(F.col("__n"), fractions)
    part = (
        F.when(F.col("__rn") < train, PARTS[0]).when(F.col("__rn") < train + val, PARTS[1]).otherwise(PARTS[2])
    )
    return numbered.withColumn(name, part).drop("__rn", "__n")


def train_val_split(df: DataFrame, label: str, key: str, val_ratio: float = 0.1, seed: int = 0) -> DataFrame:
    if not 0.0 <= val_ratio < 1.0:
        raise ValueError("val_ratio must be in [0, 1)")
    return stratified_split(df, label, key, (1.0 - val_ratio, val_ratio, 0.0), seed)


def balanced_sample(df: DataFrame, label: str, key: str, per_class: int, seed: int = 0) -> DataFrame:
    """At most ``per_class`` rows per class, without replacement, by the parallel row number."""
    return order_in_class(df, label, key, seed, "__rn").filter(F.col("__rn") < per_class).drop("__rn")


def balanced_draws(df: DataFrame, label: str, key: str, seed: int = 0, n_classes: int | None = None) -> DataFrame:
    """As many draws with replacement as rows, each row with probability proportional to 1/n_class.

    That is: a uniform class, then a uniform position inside it. Each input row stands for one draw,
    which becomes an equi join on (class, position). Adds ``draw`` (key of the drawing row). With
    ``n_classes``, a missing class is an error.
    """
    numbered = order_in_class(df, label, key, seed, "__rn")
    w = Window.orderBy(label)
    classes = stage(
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(label, "__n", (F.row_number().over(w) - 1).alias("__ord"), F.count(F.lit(1)).over(Window.partitionBy()).alias("__k")),
        "classes",
    )
    k = classes.agg(F.max("__k")).first()[0]
    if not k or (n_classes is not None and k < n_classes):
        raise ValueError("cannot draw from empty classes")
    draws = (
        df.select(F.col(key).alias("draw"))
        .withColumn("__ord", F.floor(hash_uniform(F.col("draw"), f"{seed}:class") * k).cast("int"))
        .join(classes, "__ord")
        .select("draw", label, F.floor(hash_uniform(F.col("draw"), f"{seed}:row") * F.col("__n")).cast("bigint").alias("__rn"))
    )
    return draws.join(numbered, [label, "__rn"]).drop("__rn")


def rebase_labels(df: DataFrame, label: str) -> DataFrame:
    """Subtract 1 from all labels when they run from 1 to the number of distinct labels."""
    lo, hi, k = df.agg(F.min(label), F.max(label), F.countDistinct(label)).first()
    return df.withColumn(label, F.col(label) - 1) if lo == 1 and hi == k else df


def select_subjects(df: DataFrame, subjects: Sequence[int], column: str = "domain") -> DataFrame:
    """Rows of the given subjects; an empty selection is an error."""
    out = df.filter(F.col(column).isin([int(s) for s in subjects]))
    if not subjects or out.isEmpty():
        raise ValueError("no rows for the selected subjects")
    return out


def prepare_case(
    windows: DataFrame,
    case: str,
    label: str = "y",
    key: str = "win_id",
    target: int = 0,
    fractions: Sequence[float] = (0.8, 0.1, 0.1),
    val_ratio: float = 0.1,
    seed: int = 0,
) -> DataFrame:
    """Final ``split`` of windows that carry an official ``split`` (train/test) and a ``domain``."""
    if case == "official":
        train = train_val_split(windows.filter("split = 'train'").drop("split"), label, key, val_ratio, seed)
        return train.unionByName(windows.filter("split = 'test'"))
    if case == "random":
        return stratified_split(windows.drop("split"), label, key, fractions, seed)
    if case not in ("subject", "subject_large"):
        raise ValueError("case must be official, random, subject or subject_large")
    pool = SMALL_POOL if case == "subject" else ALL_POOL
    if target not in pool:
        raise ValueError("target is not in the subject pool")
    rows = windows.drop("split")
    sources = rows.filter(F.col("domain").isin([s for s in pool if s != target]))
    held_out = select_subjects(rows, [target]).withColumn("split", F.lit("test"))
    return train_val_split(sources, label, key, val_ratio, seed).unionByName(held_out)


def by_recording_split(
    recordings: DataFrame, rows: DataFrame, key: str, label: str, fractions: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 0
) -> DataFrame:
    """Rows take the split of their recording, so no recording is spread over two splits."""
    parts = stratified_split(recordings.select(key, label), label, key, fractions, seed).select(key, "split")
    return rows.join(parts, key)
