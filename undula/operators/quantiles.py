"""Exact linear-interpolation quantiles per group, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.session import stage

BITS = (8, 22, 22)  # bits of the significand that each round of the selection looks at; 52 in all


def value_cells(v: Column, bits: Sequence[int] = BITS) -> list[Column]:
    """Integers that in this order never decrease with ``v``: sign, power of two and ``bits[0]`` bits, then the next
    bits each. The infinities have the end cells and NaN, which sorts above all numbers, the one after them.
    """
    v = v.cast("double")
    a = F.abs(v)
    e = F.floor(F.log2(a))
    sign = F.when(v < 0, -1).otherwise(1)
    steps = 1 << bits[0]
    m = a / F.pow(F.lit(2.0), e) * steps
    end = 4 * steps * 4096
    special = F.when(F.isnan(v), end + 1).when(v == float("inf"), end).when(v == float("-inf"), -end).when(a == 0, 0)
    cells = [special.otherwise(sign * ((e + 1100) * (4 * steps) + F.floor(m))).cast("bigint")]
    for b in bits[1:]:
        m = (m - F.floor(m)) * (1 << b)  # exact: a power of two times the bits that are left
        cells.append(special.otherwise(sign * F.floor(m)).cast("bigint"))
    return cells


def value_cell(v: Column, bits: int = 16) -> Column:
    """One integer that never decreases with ``v`` (see ``value_cells``)."""
    return value_cells(v, (bits,))[0]


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], bits: Sequence[int] = BITS) -> DataFrame:
    """One row per group: ``keys``, ``n`` and one column per entry of ``probs`` (name -> probability).

    Ranks are selected in rounds. A round counts rows per cell with map-side combining and finds the cells that hold
    the ranks; the next one looks at the finer cells inside these only. A cell whose least and greatest value are
    equal is settled, which most are after two rounds; the last round settles all. No task ever holds more of a group
    than the cells of a round. Results are those of the built-in percentile for every value, NaN and infinities
    included. Nulls are ignored. ``df`` is read once a round: pass a table or a cheap plan.
    """
    keys, names = list(keys), [f"__c{i}" for i in range(len(bits))]
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL")
    rows = rows.select(*keys, "__v", *[c.alias(n) for c, n in zip(value_cells(F.col("__v"), bits), names, strict=True)])

    def cells(of: DataFrame, known: list[str], cell: str, *carry: Column) -> DataFrame:
        """Cells with their counts, ends and extremes, numbered within what is ``known``."""
        w = Window.partitionBy(*known)
        upto = w.orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
        counted = of.groupBy(*known, cell).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        counted = counted.withColumns({"__end": F.sum("__n").over(upto), **{f"__{i}": c.over(w) for i, c in enumerate(carry)}})
        return counted.withColumn("__begin", F.col("__end") - F.col("__n"))

    first = cells(rows, keys, names[0], F.sum("__n")).withColumnRenamed("__0", "n")
    ranks = [
        F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), fn(F.lit(float(p)) * (F.col("n") - 1)).cast("bigint").alias("rank"))
        for name, p in probs.items()
        for side, fn in ((0, F.floor), (1, F.ceil))
    ]
    inside = F.filter(F.array(*ranks), lambda s: (s.rank >= F.col("__begin")) & (s.rank < F.col("__end")))
    wanted = first.withColumn("__w", F.explode(inside))
    kept = ["n", "q", "side", "__rank", "__lo", "__hi"]
    wanted = stage(wanted.select(*keys, names[0], "n", "__w.q", "__w.side", (F.col("__w.rank") - F.col("__begin")).alias("__rank"), "__lo", "__hi"), "ranks")
    settled = None
    for i in range(1, len(bits)):
        done = wanted.filter("__lo <=> __hi").select(*keys, *kept)
        settled = done if settled is None else settled.unionByName(done)
        wanted = wanted.filter("NOT (__lo <=> __hi)").drop("__lo", "__hi")
        if wanted.isEmpty():
            break
        known = [*keys, *names[:i]]
        finer = cells(rows.join(wanted.select(*known).distinct(), known), known, names[i])
        found = wanted.join(finer, known).filter("__rank >= __begin AND __rank < __end").withColumn("__rank", F.col("__rank") - F.col("__begin"))
        wanted = stage(found.select(*known, names[i], *kept), "ranks")
    else:
        settled = wanted.select(*keys, *kept) if settled is None else settled.unionByName(wanted.select(*keys, *kept))
    out = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.first("n") - 1)
        v0 = F.max(F.when((F.col("q") == name) & (F.col("side") == 0), F.col("__lo")))
        v1 = F.max(F.when((F.col("q") == name) & (F.col("side") == 1), F.col("__lo")))
        # weights as in the built-in percentile, which never subtracts the two values
        between = (F.ceil(h) - h) * v0 + (h - F.floor(h)) * v1
        out.append(F.when((F.floor(h) == F.ceil(h)) | (v0 == v1), v0).otherwise(between).alias(name))
    return settled.groupBy(*keys).agg(F.first("n").alias("n"), *out)
