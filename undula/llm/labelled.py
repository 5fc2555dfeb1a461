"""Labelled rows for the classifiers: folds, and bounded samples that may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.session import stage

SAMPLE_ROWS = 200_000  # most labelled rows that a classifier's curve is fitted on (16 bytes each when broadcast)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod ``n``; a null id has fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def labelled(labels: DataFrame, label: str, keep: Column, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, y): every labelled id for which ``keep`` holds, as a written table.

    Null ids and labels are left out; of repeated ids the largest label counts.
    """
    d = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & keep)
    return stage(d.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y")), "labelled")


def sample(labels: DataFrame, label: str, keep: Column, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, y): at most about ``rows`` labelled ids for which ``keep`` holds, chosen by a hash of the id.

    Null ids and labels are left out; of repeated ids the largest label counts. The written result is
    counted, so its size is known before it is broadcast.
    """
    d = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & keep)
    d = d.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    d = stage(d.withColumn("__r", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20))), "labelled")
    n = d.count()
    if n > rows:
        d = stage(d.filter(F.col("__r") < int((1 << 20) * 0.95 * rows / n)), "labelled")
        if d.count() > rows:
            raise ValueError("the hash of the ids is too uneven for the sample's bound")
    return d.drop("__r")
