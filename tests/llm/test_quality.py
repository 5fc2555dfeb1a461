"""Quality: held-out accuracy, and the linear-time identity against the sum over all pairs."""

import random

import numpy as np

from undula.llm import quality

DOCS = "doc_id bigint, text string, n_chars bigint, score double, y int"


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(np.zeros((quality.STATS, quality.BINS - 1)))
    m.w0, m.w = 0.3, rng.normal(size=m.w.shape).astype(np.float32)
    rows = [(rng.choice(len(m.w), n, replace=False).astype(np.int32), rng.random(n).astype(np.float32)) for n in (1, 4, 9)]
    size = np.array([len(r[0]) for r in rows])
    z, _ = m.logits(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(size) - size)
    for (i, x), got in zip(rows, z, strict=True):
        want = m.w0 + m.w[i] @ x + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(got - want) < 1e-4


def test_held_out_rows_are_told_apart(spark):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(500):
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 150))]
        bad = i % 5 == 0
        text = " ".join(x + "%%%" for x in w) if bad else " ".join(w) + "."
        docs.append((i, text, len(text), None, None))
        labels.append((i, int(not bad)))
    extra = [(9001, None, None, None, None), (9002, "", 0, None, None), (9003, "word " * 200_000, -5, None, None), (None, "x", 1, None, None), (7, docs[7][1], docs[7][2], None, None)]
    d, lab = spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels + [(2, None), (None, 0)], "doc_id bigint, quality int")
    got = quality.scored(d, lab).collect()
    assert len(got) == len(docs) + len(extra)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    truth = dict(labels)
    held = [(truth[x.doc_id], x.predicted) for x in got if x.held_out and x.doc_id in truth]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95
    assert quality.scored(d, lab).collect() == got or sorted(map(str, quality.scored(d, lab).collect())) == sorted(map(str, got))


def test_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "abc", 3, None, None)], DOCS)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [0 <= x.score <= 1 for x in quality.scored(d, none).collect()] == [True]
    assert quality.scored(d.limit(0), spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")).collect() == []
