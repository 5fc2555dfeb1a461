"""Ordered computations per key that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(t)`` puts a whole key in one task. The functions here cut
each key into ordered buckets, work inside a bucket, and carry a small per-bucket summary across
buckets. Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.session import stage

_B, _OFF, _CHUNK = "__bucket", "__offset", "__chunk"


def sequence_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    name: str = "idx",
    total: str | None = None,
) -> DataFrame:
    """Zero-based row number per ``keys`` in ``order``; ``total`` names an optional row count per key.

    ``bucket`` must never decrease along ``order``; one task handles one (keys, bucket).
    """
    keys = list(keys)
    b = df.withColumn(_B, bucket)
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    count = [F.sum("__n").over(Window.partitionBy(*keys)).alias(total)] if total else []
    offsets = (
        b.groupBy(*keys, _B)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, _B, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(_OFF), *count)
    )
    inside = F.row_number().over(Window.partitionBy(*keys, _B).orderBy(*order))
    return (
        b.join(offsets, [*keys, _B])
        .withColumn(name, (inside - 1 + F.col(_OFF)).cast("bigint"))
        .drop(_B, _OFF)
    )


def global_number(df: DataFrame, order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """Zero-based row number of the whole table in ``order``, without a window over the whole table.

    Rows are cut into ranges by sampled splitters and numbered inside their range; the ranges' sizes, one number for
    each shuffle partition, are added up in one row. Rows of equal ``order`` share a range: end it with a unique column.
    The cut is written once, since splitters sampled anew could cut elsewhere.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stage(df.repartitionByRange(n, *order).withColumn(_B, F.spark_partition_id()), "ranges")
    sizes = cut.groupBy(_B).agg(F.count(F.lit(1)).alias("__n"))
    every = sizes.agg(F.sort_array(F.collect_list(F.struct(_B, "__n"))).alias("__all"))
    before = F.aggregate(F.slice("__all", 1, F.col("__i")), F.lit(0).cast("bigint"), lambda s, x: s + x["__n"])
    offsets = every.select("__all", F.posexplode("__all").alias("__i", "__one")).select(F.col("__one")[_B].alias(_B), before.alias(_OFF))
    inside = F.row_number().over(Window.partitionBy(_B).orderBy(*order))
    return cut.join(offsets, _B).withColumn(name, inside - 1 + F.col(_OFF)).drop(_B, _OFF)


@dataclass(frozen=True)
class Run:
    """A running ``sum``, ``max``, ``min`` or ``last`` of ``value``; nulls are ignored.

    ``descending`` runs from the end of the order. ``inclusive=False`` leaves out the current row.
    """

    how: str
    value: Column
    inclusive: bool = True
    descending: bool = False


def prefixes(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, runs: dict[str, Run]) -> DataFrame:
    """Adds one running aggregate along ``order`` per entry of ``runs``. All share one shuffle.

    ``df`` is read twice (bucket summaries and rows): pass a table or a cheap plan.
    """
    keys = list(keys)
    fold = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    combine = {
        "sum": lambda c, v: F.coalesce(c, F.lit(0)) + F.coalesce(v, F.lit(0)),
        "max": lambda c, v: F.greatest(c, v),
        "min": lambda c, v: F.least(c, v),
        "last": lambda c, v: F.coalesce(v, c),
    }
    b = df.withColumn(_B, bucket)
    totals, carries, inside, results = [], [], {}, {}
    for i, (name, r) in enumerate(runs.items()):
        v, c = f"__v{i}", f"__c{i}"
        b = b.withColumn(v, r.value)
        sort = (lambda x: F.col(x).desc()) if r.descending else (lambda x: F.col(x).asc())
        if r.how == "last":
            pick = F.min_by if r.descending else F.max_by
            totals.append(pick(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(c))
        else:
            totals.append(fold[r.how](v).alias(c))
        earlier = Window.partitionBy(*keys).orderBy(sort(_B)).rowsBetween(Window.unboundedPreceding, -1)
        local = Window.partitionBy(*keys, _B).orderBy(*[sort(o) for o in order])
        local = local.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)
        carries.append(fold[r.how](c).over(earlier).alias(c))
        inside[v] = fold[r.how](v).over(local)
        results[name] = combine[r.how](F.col(c), F.col(v))
    carry = b.groupBy(*keys, _B).agg(*totals).select(*keys, _B, *carries)
    out = b.join(carry, [*keys, _B]).withColumns(inside).withColumns(results)
    return out.drop(_B, *inside, *[f"__c{i}" for i in range(len(runs))])


def with_halo(
    df: DataFrame, idx: str | Column, size: int | Column, before: int = 0, after: int = 0
) -> DataFrame:
    """Cut rows into chunks of ``size`` consecutive ``idx``, repeating chunk borders.

    Every chunk also receives the ``before`` rows ahead of it and the ``after`` rows behind it, so a
    frame of that reach is exact inside (keys, ``__chunk``). Rows with ``__own`` belong to the chunk.
    """
    i = F.col(idx) if isinstance(idx, str) else idx
    size = F.lit(size) if isinstance(size, int) else size
    home = F.floor(i / size)
    first = F.greatest(F.floor((i - after) / size), F.lit(0))
    last = F.floor((i + before) / size)
    return (
        df.withColumn("__home", home)
        .withColumn(_CHUNK, F.explode(F.sequence(first, last)))
        .withColumn("__own", F.col(_CHUNK) == F.col("__home"))
        .drop("__home")
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    exprs: dict,
    before: int = 0,
    after: int = 0,
    size: int = 100_000,
) -> DataFrame:
    """Add window expressions of bounded reach. ``exprs`` maps name -> (window -> Column)."""
    w = Window.partitionBy(*keys, _CHUNK).orderBy(idx)
    out = with_halo(df, idx, size, before, after)
    cols = [c for c in df.columns if c not in exprs]
    return out.select(*cols, "__own", *[f(w).alias(n) for n, f in exprs.items()]).filter("__own").drop("__own")


def explode_range(
    df: DataFrame,
    lo: Column,
    hi: Column,
    name: str,
    step: Column | int = 1,
    block: int = 65_536,
    spread: Sequence[str] = (),
) -> DataFrame:
    """One row per value of lo, lo+step, ... <= hi (none when hi < lo).

    Long ranges are first cut into blocks, so no row ever holds more than ``block`` values; ``spread``
    names key columns by which the blocks are redistributed before the second explode.
    """
    step = F.lit(step) if isinstance(step, int) else step
    out = (
        df.withColumn("__lo", lo.cast("bigint"))
        .withColumn("__hi", hi.cast("bigint"))
        .withColumn("__step", step.cast("bigint"))
        .filter("__hi >= __lo")
        .withColumn("__from", F.explode(F.expr(f"sequence(__lo, __hi, __step * {block})")))
    )
    if spread:
        out = out.repartition(*spread, "__from")
    return out.withColumn(
        name,
        F.explode(F.expr(f"sequence(__from, least(__hi, __from + __step * {block - 1}), __step)")),
    ).drop("__lo", "__hi", "__step", "__from")
