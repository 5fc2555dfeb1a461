"""Prepared splits, manifests, run folders and reports."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest"


def plain(v: Any) -> Any:
    """Settings objects, tuples, sets and NumPy values as JSON values."""
    if dataclasses.is_dataclass(v) and not isinstance(v, type):
        return plain(dataclasses.asdict(v))
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, (set, frozenset)):
        return [plain(x) for x in sorted(v, key=str)]
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return plain(v.tolist()) if hasattr(v, "tolist") else v


def _comparable(v: Any) -> Any:
    v = plain(v)
    if isinstance(v, dict):
        return {k: _comparable(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_comparable(x) for x in v]
    return v.replace("\\", "/").rstrip("/") if isinstance(v, str) else v


def config_id(config: Any, length: int = 12) -> str:
    """Short id of a configuration: leading hex digits of the SHA-1 of its sorted JSON."""
    return hashlib.sha1(json.dumps(plain(config), sort_keys=True, default=str).encode()).hexdigest()[:length]


def write_json(spark: SparkSession, obj: Any, path: str) -> None:
    """One JSON document; the write is committed as a whole or not at all."""
    spark.createDataFrame([(json.dumps(plain(obj), default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path).first()["value"])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_splits(df: DataFrame, path: str, config: Any, by: str = "split") -> None:
    """Write a split dataset, partitioned by split; the manifest comes last, so a half-written dataset
    never counts as valid."""
    path = path.rstrip("/")
    spark = df.sparkSession
    if exists(spark, f"{path}/{MANIFEST}"):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    df.write.mode("overwrite").partitionBy(by).parquet(f"{path}/data")
    parts = [r[0] for r in spark.read.parquet(f"{path}/data").select(by).distinct().collect()]  # a few splits
    write_json(spark, {"config": config, "by": by, "splits": sorted(parts), "columns": df.columns}, f"{path}/{MANIFEST}")


def load_splits(spark: SparkSession, path: str, split: str | None = None, by: str = "split") -> DataFrame:
    df = spark.read.parquet(f"{path.rstrip('/')}/data")
    return df.filter(F.col(by) == split) if split else df


def is_current(
    spark: SparkSession, path: str, config: Any, splits: Sequence[str], columns: Sequence[str] = (), keys: Sequence[str] = ("config",)
) -> bool:
    """True when the stored configuration equals ``config`` and all parts exist.

    Paths compare with '/' separators and without a trailing one. ``keys`` are the manifest entries
    compared; with more than ``config``, pass a dict that holds all of them.
    """
    path = path.rstrip("/")
    if not exists(spark, f"{path}/{MANIFEST}"):
        return False
    try:
        have = _comparable(read_json(spark, f"{path}/{MANIFEST}"))
    except (ValueError, TypeError):
        return False
    stored = have if tuple(keys) == ("config",) else {**have, **(have["config"] if isinstance(have["config"], dict) else {})}
    want = {"config": _comparable(config)} if tuple(keys) == ("config",) else _comparable(config)
    if any(stored.get(k) != want.get(k) for k in keys):
        return False
    return set(columns) <= set(have["columns"]) and all(
        s in have["splits"] and exists(spark, f"{path}/data/{have['by']}={s}") for s in splits
    )


def load_or_build(spark: SparkSession, path: str, config: Any, splits: Sequence[str], build, refresh: bool = False) -> DataFrame:
    """Reuse a current dataset, else build and write it."""
    if refresh or not is_current(spark, path, config, splits):
        save_splits(build(), path, config)
    return load_splits(spark, path)


def _run_json(spark: SparkSession, root: str, relative: str) -> DataFrame:
    folder, _, name = relative.rpartition("/")
    base = f"{root.rstrip('/')}/*" + (f"/{folder}" if folder else "")
    df = spark.read.option("multiLine", True).json(f"{base}/{{{name},*={name}}}")
    inner = f"/{folder}" if folder else ""
    tail = F.regexp_replace(
        F.col("_metadata.file_path"), rf"{inner}/([^/=]+=)?{name.replace('.', '[.]')}(/part-[^/]*)?$", ""
    )
    return df.withColumn("run_dir", tail).withColumn(
        "run_name", F.regexp_replace(F.element_at(F.split("run_dir", "/"), -1), r"^[^=]+=", "")
    )


def find_runs(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """Config of every run folder below ``root`` that holds one, with ``run_name`` and ``run_dir``."""
    df = _run_json(spark, root, "config.json")
    return df.filter(F.lower("run_name").contains(name.lower())) if name else df


def run_files(spark: SparkSession, root: str, relative: str) -> DataFrame:
    """The JSON file ``relative`` of every run folder, with ``run_name``."""
    return _run_json(spark, root, relative)


def flat_report(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of report tables over all their columns; nested values become JSON text."""
    def flat(df: DataFrame) -> DataFrame:
        nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")}
        return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [flat(p) for p in parts])


def save_csv(parts: Sequence[DataFrame], path: str) -> None:
    flat_report(parts).write.mode("overwrite").option("header", True).csv(path)


def save_rows_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines (committed as a whole)."""
    df.write.mode("overwrite").json(path)
