"""Toxicity: held-out accuracy, and the Kneser-Ney ratios against plain arithmetic."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from undula.llm import toxicity
from undula.llm.labelled import sample
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, score double, raw int"


def corpus(n=600):
    r = random.Random(5)
    words = ["".join(r.choice("aeiorstnl") for _ in range(r.randint(2, 7))) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(["zugdumb", "vilekwak", "zugvile"])
        docs.append((i, " ".join(w), None, 1))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus()
    extra = [(9001, None, None, None), (9002, "", None, None), (9003, "x" * 3_000_000, None, None), (None, "no id", None, None), (5, docs[5][1], None, None)]
    d, lab = spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels + [(1, None), (None, 1), (3, 0)], "doc_id bigint, toxic int")
    got = toxicity.scored(d, lab).collect()
    assert len(got) == len(docs) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    truth = dict(labels)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    by = {r.doc_id: r.score for r in got}
    assert by[9001] == by[9002] and len([r for r in got if r.doc_id == 5]) == 2


def test_the_counts_are_of_all_labelled_rows(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    counts = Counter()
    for (i, text, *_), (_, y) in zip(docs, labels, strict=True):
        if 0 < zlib.crc32(str(i).encode()) % 5 < 4:
            for k in toxicity.grams(text.encode()):
                counts.update((int(x), y) for x in k)
    keys = {k for k, _ in counts}
    rows = [(k, counts[k, 1], counts[k, 0]) for k in sorted(keys)]
    want = toxicity.Model(toxicity.log_ratios(spark.createDataFrame(rows, "key int, toxic bigint, ordinary bigint")))
    got = toxicity.fit(d, lab, rows=60)[0].value
    contexts = np.flatnonzero(want.row)
    assert (np.flatnonzero(got.row) == contexts).all()
    assert np.allclose(got.table[got.row[contexts]], want.table[want.row[contexts]], atol=1e-5)


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    d = spark.createDataFrame([(1, "abc", None, None)], DOCS)
    assert [r.predicted for r in toxicity.scored(d, none).collect()] == [0]
    assert toxicity.scored(d.limit(0), spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")).collect() == []


def test_ratios_equal_plain_kneser_ney(spark):
    texts = [("the cat sat on the mat", 0), ("the bat sat", 1), ("a cat, a hat!", 0), ("bad bat bad cat", 1)]
    counts = [Counter(), Counter()]
    for t, y in texts:
        for k in toxicity.grams(t.encode()):
            counts[y].update(k.tolist())
    keys = sorted(set(counts[0]) | set(counts[1]))
    types = {5: set(keys)}
    for m in (4, 3, 2, 1):
        types[m] = {k & ((1 << 5 * m) - 1) for k in types[m + 1]}

    def shared(k, m):
        if not m:
            return 1 / 32
        count = lambda g: sum(x & ((1 << 5 * m) - 1) == g for x in types[m + 1])
        beside = [g for g in types[m] if g >> 5 == k >> 5]
        return (max(count(k) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(beside) * shared(k & ((1 << 5 * (m - 1)) - 1), m - 1)) / sum(map(count, beside))

    def p(y, k):
        total = sum(n for g, n in counts[y].items() if g >> 5 == k >> 5)
        after = sum(1 for g in counts[y] if g >> 5 == k >> 5)
        low = shared(k & 0xFFFFF, 4)
        return (max(counts[y][k] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * after * low) / total if total else low

    want = {k: math.log(p(1, k) / p(0, k)) for k in keys}
    df = spark.createDataFrame([(k, counts[1][k], counts[0][k]) for k in keys], "key int, toxic bigint, ordinary bigint")
    got = {(r.context << 5) | s.code: s.ratio for r in toxicity.log_ratios(df).collect() for s in r.seen}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    model = toxicity.Model(toxicity.log_ratios(df))
    text = b"the bad cat"
    seen = defaultdict(float)
    for r in toxicity.log_ratios(df).collect():
        seen[r.context] = r.unseen
    plain = sum(want.get(int(k), seen[int(k) >> 5]) for g in toxicity.grams(text) for k in g) / len(text)
    assert model.raw(text)[0] == pytest.approx(plain, abs=1e-5)


def plain_excess(v, n):
    """The mean excess of a text's stretches over their median and three median deviations."""
    s = np.array([int(sum(v[i : i + n])) * toxicity.STEPS // (n * toxicity.UNIT) for i in range(len(v) - n + 1)] or [int(sum(v)) * toxicity.STEPS // (len(v) * toxicity.UNIT)])
    usual = np.median(s)
    return np.maximum(s - usual - 3 * np.median(np.abs(s - usual)), 0).mean() / toxicity.STEPS


def test_scores_do_not_depend_on_pieces(spark, monkeypatch):
    rng = np.random.default_rng(4)
    keys = rng.choice(1 << 25, 4000, replace=False)
    df = spark.createDataFrame([(int(k), int(a), int(b)) for k, a, b in zip(keys, rng.integers(0, 9, 4000), rng.integers(1, 9, 4000))], "key int, toxic bigint, ordinary bigint")
    model = toxicity.Model(toxicity.log_ratios(df))
    model.table = rng.integers(-3_000_000, 3_000_000, model.table.shape).astype(np.int32)
    long = bytes(rng.integers(97, 123, 3_000_000).tolist())
    whole = model.raw(long)
    for text in (b"", b"a", b"abc def", b"x" * 15, b"y" * 16, b"hello world, hello", long[:4000], "é à ü ".encode() * 200):
        want = model.raw(text)
        if text:
            v = np.concatenate([model.table[model.row[k >> 5], k & 31] for k in toxicity.grams(text)])
            assert want.tolist() == pytest.approx([v.mean() / toxicity.UNIT, *(plain_excess(v, n) for n in toxicity.STRETCHES)], abs=1e-9)
        for piece in (1, 7, 1000):
            monkeypatch.setattr(toxicity, "PIECE", piece)
            assert (model.raw(text) == want).all()
    for piece in (1 << 16, 99_999):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert (model.raw(long) == whole).all()


def test_columns_of_any_name_stay(spark):
    docs, labels = corpus(60)
    d = spark.createDataFrame([(i, t, "r", "t", (1,), "s") for i, t, *_ in docs], "doc_id bigint, text string, raw string, __text string, `a b` struct<`c d`: int>, Score string")
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    out = toxicity.with_scores(d, toxicity.fit(d, lab))
    assert out.columns == ["doc_id", "text", "raw", "__text", "a b", "score", "predicted"]
    assert {(r.raw, r["__text"], r["a b"]["c d"]) for r in out.collect()} == {("r", "t", 1)}


def test_pieces_of_long_texts_join(monkeypatch):
    text = ("Some Words é, and others. " * 40).encode()
    whole = np.concatenate(list(toxicity.grams(text)))
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert (np.concatenate(list(toxicity.grams(text))) == whole).all() and len(whole) == len(text)


def test_sample_is_bounded(spark):
    lab = spark.createDataFrame([(i, i % 2) for i in range(3000)] + [(5, 1)], "doc_id bigint, toxic int")
    s = sample(lab, "toxic", F.lit(True), rows=500)
    assert 300 < s.count() <= 500
    assert sample(lab, "toxic", F.lit(True)).count() == 3000
