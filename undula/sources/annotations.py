"""Interval annotations from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.functions.scalar import base_name
from undula.sources.text import logical_path

# Kinds and the keys accepted for each, first match wins.
KIND_KEYS = {
    "transition": ("postural_transition", "transition", "transitions"),
    "no_transition": ("stable_posture", "no_transition"),
    "ambiguous": ("ambiguous",),
}
_SPANS = "array<struct<t0:double,t1:double>>"
_BODY = ", ".join(f"{k} {_SPANS}" for keys in KIND_KEYS.values() for k in keys)


def read_annotations(spark: SparkSession, path: str, glob: str = "*.json", bundled: bool = False) -> DataFrame:
    """One row per document: ``file`` (stem + .txt), ``fs`` and one array of intervals per kind.

    A file is one document, or with ``bundled`` many of them, one a line, each with its own name in ``name``.
    """
    schema = f"fs double, labels struct<{_BODY.replace(' array', ':array')}>, {_BODY}" + (", name string" if bundled else "")
    files = spark.read.schema(schema).option("multiLine", not bundled).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path)
    name = F.col("name") if bundled else logical_path(F.col("_metadata.file_path"))
    raw = files.withColumn("file", F.regexp_replace(base_name(name), r"\.json$", ".txt"))
    nested = F.col("labels").isNotNull()
    empty = F.array().cast(_SPANS)

    def kind(keys):
        inner = F.coalesce(*[F.col(f"labels.{k}") for k in keys], empty)
        return F.when(nested, inner).otherwise(F.coalesce(*[F.col(k) for k in keys], empty))

    return raw.select("file", "fs", *[kind(keys).alias(k) for k, keys in KIND_KEYS.items()])


def intervals(annotations: DataFrame) -> DataFrame:
    """Long form: file, kind, t0, t1."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("spans")) for k in KIND_KEYS])
    return (
        annotations.select("file", F.explode(kinds).alias("k"))
        .select("file", "k.kind", F.explode("k.spans").alias("s"))
        .select("file", "kind", "s.t0", "s.t1")
    )
