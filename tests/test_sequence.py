import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from undula.operators.quantiles import exact_quantiles, value_cells
from undula.operators.sequence import Run, explode_range, framed, global_number, prefixes, sequence_number


@pytest.fixture(scope="module")
def rows(spark):
    """Key 0 holds most rows; values repeat and some are null."""
    rng = random.Random(1)
    data = []
    for k, n in ((0, 3000), (1, 7), (2, 1), (3, 250)):
        data += [(k, i, rng.choice([None, rng.randint(0, 40)]), rng.uniform(-5, 5)) for i in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k int, i bigint, v int, x double").cache()


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_sequence_number(rows):
    got = sequence_number(rows.select("k", "i", "x"), ["k"], ["x", "i"], F.floor("x"), "n", "total")
    w = Window.partitionBy("k")
    want = rows.select("k", "i", "x", (F.row_number().over(w.orderBy("x", "i")) - 1).cast("bigint").alias("n"), F.count("i").over(w).alias("total"))
    same(got.select("k", "i", "n", "total"), want.select("k", "i", "n", "total"))


@pytest.mark.parametrize("how", ["sum", "max", "min", "last"])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("descending", [True, False])
def test_prefix(rows, how, inclusive, descending):
    runs = {"p": Run(how, F.col("v"), inclusive, descending), "q": Run("sum", F.lit(1))}
    got = prefixes(rows, ["k"], ["i"], F.floor(F.col("i") / 64), runs)
    assert got.filter("q <> i + 1").isEmpty()
    order = F.col("i").desc() if descending else F.col("i")
    w = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    fn = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    want = fn("v").over(w)
    want = F.coalesce(want, F.lit(0)) if how == "sum" else want
    same(got.select("k", "i", "p"), rows.select("k", "i", want.alias("p")))


def test_framed_is_the_plain_frame(rows):
    exprs = {"a": lambda w: F.lag("x", 3).over(w), "b": lambda w: F.sum("x").over(w.rowsBetween(-3, 2)), "c": lambda w: F.lead("v").over(w)}
    got = framed(rows, ["k"], "i", exprs, before=3, after=2, size=10).select("k", "i", "a", F.round("b", 9), "c")
    w = Window.partitionBy("k").orderBy("i")
    want = rows.select("k", "i", exprs["a"](w), F.round(exprs["b"](w), 9), exprs["c"](w))
    same(got, want)


@pytest.mark.parametrize("spread", [(), ("k",)])
def test_explode_range(spark, spread):
    df = spark.createDataFrame([(1, 0, 25), (2, 5, 5), (3, 4, 3), (4, -7, 8)], "k int, lo int, hi int")
    got = explode_range(df, F.col("lo"), F.col("hi"), "v", 3, block=2, spread=spread)
    want = [(k, v) for k, lo, hi in ((1, 0, 25), (2, 5, 5), (4, -7, 8)) for v in range(lo, hi + 1, 3)]
    assert sorted((r.k, r.v) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("bits", [(8, 22, 22), (2, 3, 47), (4, 48)])
def test_exact_quantiles(spark, bits):
    rng = np.random.default_rng(0)
    groups = {
        0: rng.normal(size=2001), 1: np.full(50, 3.5), 2: np.array([7.0]), 3: np.array([-1e-300, 0.0, 1e300, -2.0]),
        4: rng.integers(-3, 3, 999).astype(float), 5: np.exp(rng.normal(size=800) * 20), 6: np.array([1.0, 2.0]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, a in groups.items() for v in a] + [(0, None)], "k int, v double")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p1": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, bits).collect()}
    assert set(got) == set(groups)
    for k, a in groups.items():
        assert got[k].n == len(a)
        for name, p in probs.items():
            assert np.isclose(got[k][name], np.quantile(a, p), rtol=1e-12, atol=0), (k, name)


def test_quantiles_of_a_million_values_in_one_cell(spark):
    """All values share sign, exponent and the first bits; no later cell holds more than a round's share of them."""
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), (1 + F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(2.0**52)).alias("v"))
    probs = {"p1": 0.001, "p50": 0.5, "p99": 0.99}
    got = exact_quantiles(df, ["k"], "v", probs).first()
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in probs.values()])).alias("q")).first().q
    assert [got[p] for p in probs] == want and got.n == 1_000_000
    cells = df.select(*[c.alias(f"c{i}") for i, c in enumerate(value_cells(F.col("v")))])
    assert cells.select("c0").distinct().count() == 1
    assert cells.groupBy("c0", "c1").count().agg(F.max("count")).first()[0] < 2000


def test_global_number(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0.0, 1.0, -1.0, float("nan"), rng.random()])) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, v double")
    order = [F.col("v").asc_nulls_last(), F.col("i").asc()]
    out = global_number(df, order)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all("windowspecdefinition(__bucket" in w for w in plan.split("\n") if "Window [" in w)
    got = {r.i: r.place for r in out.collect()}
    want = {r.i: n for n, r in enumerate(df.orderBy(*order).collect())}
    assert got == want
    assert global_number(df.limit(0), order).collect() == []
