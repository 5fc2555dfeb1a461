"""SimHash components against brute force; large groups, split buckets and the chain filter."""

import random
import re

import numpy as np
import pytest
import xxhash

from undula.llm import simhash

SCHEMA = "doc_id bigint, text string, fp string, least int, component_id int"


def plain_print(t):
    b = (t or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in b))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(ids, prints):
    fp = np.array(prints, np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    comp = np.array([10**9 if i is None else i for i in ids])
    while True:
        new = np.where(near, comp[None, :], 10**12).min(1)
        if (new == comp).all():
            return comp.tolist()
        comp = new


def test_texts(spark):
    r = random.Random(3)
    base = [[f"w{r.randrange(5000)}" for _ in range(r.randint(30, 300))] for _ in range(25)]
    rows = []
    for i in range(160):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"v{r.randrange(99)}"
        rows.append((i + 10, " ".join(w).title() if i % 3 else "\t".join(w)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "é Ü\xa0x"), (8, "a b c d"), (9, "word " * 100_000), (10, rows[0][1]), (None, rows[0][1]), (None, "alone without id")]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame([(*x, "f", 1, 1) for x in rows], SCHEMA)).collect()]
    prints = [plain_print(t) for _, t in rows]
    want = [(i, f"{f:016x}", None if c == 10**9 else c) for (i, _), f, c in zip(rows, prints, brute([i for i, _ in rows], prints), strict=True)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def components_of(pairs, fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("block", [simhash.BLOCK, 5])
def test_links_keep_all_connections(spark, block):
    r = random.Random(8)
    fps = {r.getrandbits(64) for _ in range(150)} | {0}
    for f in list(fps)[:40]:
        for _ in range(r.randint(1, 3)):
            fps.add(f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    dense = r.getrandbits(64)
    fps |= {dense ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = [(x.a % (1 << 64), x.b % (1 << 64)) for x in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), block=block).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    arr = np.array(fps, np.uint64)
    near = np.argwhere(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4)
    assert components_of(got, fps) == components_of([(fps[i], fps[j]) for i, j in near.tolist()], fps)


def test_every_close_pair_has_a_chain():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    flips = np.zeros(len(a), np.uint64)
    for _ in range(6):
        flips ^= np.uint64(1) << rng.integers(0, 64, len(a), dtype=np.uint64)
    b = a ^ flips
    close = np.bitwise_count(flips) <= 4
    chained = np.zeros(len(a), bool)
    for s in range(len(simhash.SEGMENTS)):
        k = simhash.linked(a, b, np.full(len(a), s))
        assert not (k & ~close).any()
        second = simhash._segment(a ^ b, s + 1)
        half = ((second & np.uint64((1 << simhash.HALF) - 1)) == 0) | ((second >> np.uint64(simhash.HALF)) == 0)
        assert not (k & ~half).any() and not (k & (simhash._segment(a ^ b, s) != 0)).any()  # so a bucket has both
        chained |= k
    assert (chained == close).all()
