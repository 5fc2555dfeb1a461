"""Suffix-array deduplication against a set of all windows; the sort against plain sorting."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.llm import substrings

SCHEMA = "doc_id bigint, text string, spans string, h int, row string"


def brute(rows):
    out, seen = [], {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for s in range(len(b) - 49):
                w = b[s : s + 50]
                seen[w] = min(seen.get(w, i), i)
    for i, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 49 if i is not None else 0):
            if seen[b[s : s + 50]] < i:
                m[s] += 1
                m[s + 50] -= 1
        f = np.cumsum(m)[: len(b)] > 0
        edge = np.diff(np.concatenate(([0], f.astype(int), [0])))
        kept = np.frombuffer(b, np.uint8)[~f].tobytes()
        out.append((str(i), len(b), int(f.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, rows, **settings):
    d = substrings.without_repeats(spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA), **settings)
    assert {"spans", "h"} <= set(d.columns) or d.columns
    d = d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("s"))
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.s) for r in d.collect())


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(4)]
    rows = []
    for i in range(n):
        t = " ".join(word() for _ in range(r.randint(0, 80)))
        k = r.random()
        if k < 0.6:
            s = r.choice(shared)
            a = r.randrange(len(s) - 60)
            t = t[: len(t) // 2] + s[a : a + r.randint(45, 120)] + t[len(t) // 2 :]
        if k < 0.1 and rows:
            t = rows[r.randrange(len(rows))][1]
        rows.append((i * 3, t))
    return rows


@pytest.mark.parametrize("settings", [{}, {"hot_docs": 2}, {"hot_docs": 1, "bucket_bytes": 500}])
def test_brute_force(spark, settings):
    rows = corpus(1) + [(500, None), (501, ""), (502, "short"), (503, "ab" * 400), (504, "b" + "ab" * 300), (505, "a" * 200), (506, "a" * 90), (None, "a" * 120), (3, "a" * 70), (3, "a" * 70)]
    assert run(spark, rows, **settings) == brute(rows)


def test_small_memories_change_nothing(spark, monkeypatch):
    # workers are forked from this process's modules only through the package; so the functions are called here
    rows = corpus(2, 40)
    import pyarrow as pa

    monkeypatch.setattr(substrings, "CHUNK", 7)
    monkeypatch.setattr(substrings, "SEEN", 2)
    monkeypatch.setattr(substrings, "FLUSH", 300)
    b = pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    blobs = [x for x in substrings._blobs(3)([b])]
    t = pa.Table.from_batches(blobs)
    t = t.take(pa.array(np.argsort(t["bucket"].to_numpy(), kind="stable")))
    found = pa.Table.from_batches(list(substrings._shared(t.combine_chunks().to_batches())))
    by = {}
    for d, h in zip(found["row"].to_pylist(), found["h"].to_pylist(), strict=True):
        by.setdefault(d, []).append(h)
    with_h = [(i, t, by[i]) for i, t in rows if i in by]
    c = pa.record_batch([pa.array([x[0] for x in with_h]), pa.array([0] * len(with_h)), pa.array([x[1] for x in with_h]), pa.array([x[2] for x in with_h]), pa.array([[]] * len(with_h), pa.list_(pa.int64()))], names=["doc_id", "row", "text", "hs", "hot"])
    ctx = pa.Table.from_batches(list(substrings._contexts([c]))).combine_chunks()
    ctx = ctx.take(pa.array(np.lexsort((ctx["doc_id"].to_numpy(), ctx["h"].to_numpy()))))
    gone = {}
    for out in substrings._resolve(ctx.to_batches(max_chunksize=3)):
        for d, a, z in zip(out["doc_id"].to_pylist(), out["start"].to_pylist(), out["stop"].to_pylist(), strict=True):
            gone.setdefault(d, []).append((a, z))
    got = sorted((str(i), sum(z - a for a, z in substrings.merged(gone.get(i, [])))) for i, _ in rows)
    assert got == sorted((i, n) for i, _, n, _, _ in brute(rows))


def test_near_and_exact_copies_in_a_large_group(spark):
    base = " ".join(f"w{i * 7919 % 1000}" for i in range(60))
    rows = [(i, base if i % 2 else base[: i % 200 + 50] + f" {i} " + base[i % 200 + 50 :]) for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_one_window_at_the_edges(spark):
    w = "x".join(str(i) for i in range(60))[:50]
    rows = [(1, "A" + w + "B"), (2, w), (3, "CC" + w), (4, w + "DD"), (5, w[:-1] + "E"), (6, "é" * 10 + w + "é" * 40), (7, "é" * 50)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_very_long_text(spark, monkeypatch):
    r = random.Random(9)
    t = "".join(r.choice("abcdefghij ") for _ in range(substrings.PIECE + 5000))
    rows = [(1, t), (2, t[substrings.PIECE - 300 : substrings.PIECE + 300] + "zz")]
    got = run(spark, rows)
    assert [x[2] for x in got] == [0, 600]


def test_cut_characters_are_dropped_from_strings(spark):
    rows = [(1, "é" + "abcdefghij" * 5), (2, "éabcdefghij" + "abcdefghij" * 4 + "é"), (3, "�" + "z" * 20)]
    d = substrings.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), as_text=True)
    got = {r.doc_id: r.kept for r in d.collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1] and "�" not in got[2]


def test_suffix_sort_equals_plain_sort():
    rng = np.random.default_rng(0)
    ctx = [bytes(rng.integers(97, 99, 70).tolist()) for _ in range(12)] + [b"a" * 84, b"a" * 60, b"ab" * 40]
    data = np.frombuffer(b"".join(ctx), np.uint8)
    offset = np.concatenate(([0], np.cumsum([len(c) for c in ctx])))
    at = np.concatenate([np.arange(a, z - 49) for a, z in zip(offset, offset[1:], strict=False)])
    s = substrings.Suffixes(data, offset)
    for start in (np.array([0]), np.array([0, 5, 6, 40])):
        order = s.sort(at, start)
        raw = [data[i : i + 50].tobytes() for i in at]
        for a, z in zip(start, [*start[1:], len(at)], strict=True):
            assert [raw[i] for i in order[a:z]] == sorted(raw[a:z])
            assert sorted(order[a:z]) == list(range(a, z))


ODD = "doc_id string, text string, __spans string, __text int, `a b` struct<`c d`: int>, Kept string"


def test_columns_of_any_name_and_ids_of_any_type(spark):
    passage = "This passage of more than fifty bytes stands in several documents. "
    rows = [("b", "first " + passage, "s", 1, (2,), "k"), ("a", passage + "second", "s", 1, (2,), "k"), (None, passage, "s", 1, (2,), "k"), ("10", passage, "s", 1, (2,), "k")]
    out = substrings.without_repeats(spark.createDataFrame(rows, ODD), as_text=True)
    assert out.columns == ["doc_id", "__spans", "__text", "a b", "kept", "n_bytes", "n_removed", "n_spans"]
    got = {r.doc_id: (r.kept, r["a b"]["c d"], r["__spans"]) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {"10": passage, "a": "second", "b": "first ", None: passage} and {v[1:] for v in got.values()} == {(2, "s")}


def test_different_texts_of_one_hash_stay_apart(spark, monkeypatch):
    passage = "This passage of more than fifty bytes stands in several documents. "
    seeds = []

    def weak(column, seed):
        seeds.append(seed)
        return F.lit(7).cast("bigint") if len(seeds) == 1 else hashed(column, seed)

    from pyspark.sql import functions as F

    hashed = F.xxhash64
    monkeypatch.setattr(substrings.F, "xxhash64", lambda *c: weak(*c) if c[0] == "text" else hashed(*c))
    rows = [(1, passage + "one"), (2, "two " + passage), (3, passage + "one")]
    got = {r.doc_id: r.n_removed for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(seeds) == 2 and got == {1: 0, 2: len(passage), 3: len(passage) + 3}
