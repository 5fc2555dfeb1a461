"""Mixing: targets by the sharing loop, taken words against a plain draw of blocks, skew and odd rows."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from undula.llm import mixing

SCHEMA = "doc_id bigint, source string, text string, size int, taken string"


def shared_out(sizes, weights=(5, 2, 1), cap=3):
    """Targets by the rule itself: share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    target = {s: total * weight[s] / sum(weight.values()) for s in names}
    full = set()
    while True:
        over = {s for s in names if s not in full and target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target
        excess = sum(target[s] - cap * sizes[s] for s in over)
        for s in over:
            target[s] = float(cap * sizes[s])
        full |= over
        rest = [s for s in names if s not in full]
        for s in rest:
            target[s] += excess * weight[s] / sum(weight[x] for x in rest)


def test_mix(spark):
    rows = [(i, f"s{i % 7}" if i % 3 else "hot", "w " * (i % 400), 1, "x") for i in range(900)]
    rows += [(2000, None, "only words of no source " * 9, 1, "x"), (2001, "s1", None, 1, "x"), (2002, "s1", "", 1, "x"), (None, "s2", "a b", 1, "x"), (5, "s3", "dup", 1, "x"), (5, "s3", "dup", 1, "x"), (3000, "s4", "long " * 50_000, 1, "x"), (3001, "é", "x\x0by\tz\x00", 1, "x")]
    d = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in mixing.mixed(d).collect()]
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for i, s, t, *_ in rows:
        sizes[s] += len((t or "").replace("\x00", "0").split())
    target = shared_out(sizes)
    size_of = {s: n for s, n in sizes.items()}
    by_size = {n: s for s, n in size_of.items()}
    taken = defaultdict(int)
    for _, size, source_size, want, n in got:
        s = by_size[source_size]
        assert want == pytest.approx(target[s]) and 0 <= n <= 3 * size
        taken[s] += n
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK
    assert sorted(map(str, got)) == sorted(map(str, [tuple(r) for r in mixing.mixed(d.repartition(7)).collect()]))


def test_slots_are_a_bijection_and_counts_add_up(spark):
    rows = [(i, "abc"[i % 3], "w " * 500, 1, "") for i in range(90)]
    sources = mixing.targets(mixing.sized(spark.createDataFrame(rows, SCHEMA))).cache()
    s = mixing.slots(sources, shard_slots=100).cache()
    n = sources.agg(F.sum("slots")).first()[0]
    assert sorted(r.shard * 100 + r.position for r in s.collect()) == list(range(n))
    want = {r.sidx: (r.slots, r.blocks) for r in sources.collect()}
    for (sidx, epoch), part in s.toPandas().groupby(["sidx", "epoch"]):
        slots, blocks = want[sidx]
        assert part.block.is_unique and part.block.between(0, blocks - 1).all() and len(part) == min(blocks, slots - epoch * blocks)
    counts = mixing.shard_counts(s).groupBy("sidx").agg(F.sum("drawn").alias("n")).collect()
    assert {r.sidx: r.n for r in counts} == {k: v[0] for k, v in want.items()}
    drawn = [r.drawn for r in mixing.shard_counts(s).filter("sidx = 0").collect()]
    assert len(set(drawn)) > 1  # shards differ, as draws do


def test_empty_and_wordless(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.mixed(spark.createDataFrame([(1, "a", "  ", 1, ""), (2, None, None, 1, "")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_lanes_spread_ids_at_any_step(spark):
    rows = [(1024 * i, "s", "w " * (1 + i % 50), 1, "") for i in range(300)] + [(None, "s", "w " * (1 + i % 50), 1, "") for i in range(300)]
    sizes = mixing.sized(spark.createDataFrame(rows, SCHEMA))
    placed = mixing.laid_out(sizes, mixing.targets(sizes)).orderBy("first_word").collect()
    assert [r.first_word for r in placed] == [sum(x.size for x in placed[:i]) for i in range(len(placed))]
    ids = [r.doc_id for r in placed if r.doc_id is not None]
    assert ids != sorted(ids)  # many lanes
    runs = sum((a.doc_id is None) != (b.doc_id is None) for a, b in zip(placed, placed[1:]))
    assert runs > 60  # rows without an id lie in many lanes


def test_columns_are_carried(spark):
    d = spark.createDataFrame([(7, "s", "w " * 30, 1, "long"), (7, "s", "w", 2, "short"), (None, "s", "x y", 3, "none")], SCHEMA).withColumnRenamed("taken", "mark").drop("size")
    got = {r.mark: (r.doc_id, r.size) for r in mixing.mixed(d, carry=["mark"]).collect()}
    assert got == {"long": (7, 30), "short": (7, 1), "none": (None, 2)}
