"""Recompression and periodic runs against plain loops."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from undula.llm import periodic
from undula.llm.recompression import Grammar

SCHEMA = "doc_id bigint, text string, runs int, kept string, `a b` struct<`c d`: int>"


def brute(s):
    n, found = len(s), {}
    for p in range(1, n // 4 + 1):
        j = 0
        while j < n - p:
            e = j
            while e < n - p and s[e] == s[e + p]:
                e += 1
            if e - j + p >= max(6, 4 * p):
                found.setdefault((j, e - j + p), p)
            j = max(e, j + 1)
    return sorted(((a, size, p) for (a, size), p in found.items()), key=lambda r: (r[0], r[2]))


def plain(text):
    words = (text or "").encode().split()
    runs = brute(words)
    gone = {i for a, size, p in runs for i in range(a + p, a + size)}
    return len(words), runs, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


piece = st.lists(st.integers(1, 3), max_size=8)
sequence = st.lists(st.tuples(piece, st.integers(1, 9)), max_size=6).map(lambda t: [c for s, n in t for c in s * n])


@settings(max_examples=300, deadline=None)
@given(st.lists(sequence, max_size=6))
def test_runs_equal_a_plain_search(sequences):
    got = periodic.runs_of([np.array(s, np.int64) for s in sequences])
    assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(s) for s in sequences]


@settings(max_examples=200, deadline=None)
@given(sequence.filter(lambda s: len(s) > 1), sequence, st.data())
def test_extensions_equal_a_plain_comparison(s, other, data):
    x = np.array([0, *s, 0, *other, 0] if other else [0, *s, 0], np.int64)
    i = data.draw(st.integers(1, len(s) - 1))
    j = data.draw(st.integers(i + 1, len(s)))
    ahead = next(k for k in range(len(x)) if x[j + k] == 0 or x[i + k] != x[j + k])
    back = next(k for k in range(len(x)) if x[i - 1 - k] == 0 or x[i - 1 - k] != x[j - 1 - k])
    g = Grammar(x)
    assert (g.extension(np.array([i]), np.array([j]))[0], g.extension(np.array([i]), np.array([j]), -1)[0]) == (ahead, back)


def test_grammar_is_small_and_shallow():
    rng = np.random.default_rng(1)
    g = Grammar(np.concatenate(([0], np.tile(rng.integers(1, 9, 50), 2000), [0])))
    assert len(g.symbols[-1]) == 3 and len(g.symbols) < 120
    assert sum(map(len, g.symbols)) < 8 * 100_000 and len(np.unique(np.concatenate(g.symbols))) < 500  # few rules


def test_operator_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a " * 6), (4, "a a a a a"), (None, "x y x y x y x y"), (5, "é é é é " * 9), (5, "b a b a b a b a a a a a a")]
    rows += [(6, "the quick\nbrown fox " * 7 + "end"), (7, " ".join(str(i) for i in range(40_000))), (8, "w " * 30_000 + "v w " * 4)]
    rows += [(9, "same line here\n" * 4)] * 3
    docs = spark.createDataFrame([(i, t, 0, "k", (1,)) for i, t in rows], SCHEMA)
    got = sorted(((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.kept) for r in periodic.periodic_runs(docs).collect()))
    by = {}
    for i, *rest in got:
        by.setdefault(i, []).append(tuple(rest))
    assert by["7"] == [(40_000, [], " ".join(map(str, range(40_000))))]
    assert by["8"][0][1][0] == (0, 30_000, 1) and by["8"][0][1][1][2] == 2
    for i in {i for i, _ in rows} - {7, 8}:
        assert by[str(i)] == sorted(plain(t) for j, t in rows if j == i)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_a_long_text_is_one_group(spark, monkeypatch):
    docs = spark.createDataFrame([(str(i), "p q r " * (50 * i)) for i in range(1, 5)], "name string, body string")
    got = {r.doc_id: r.runs[0] for r in periodic.periodic_runs(docs, "name", "body").collect()}
    assert got == {str(i): (0, 150 * i, 3) for i in range(1, 5)}
    monkeypatch.setattr(periodic, "GROUP_WORDS", 2)
    import pyarrow as pa

    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(["a " * 8, None, "b c " * 8])], names=["i", "t"])
    out = pa.Table.from_batches(list(periodic._found(iter([batch]))))
    assert out.column("n_words").to_pylist() == [8, 0, 16] and [len(r) for r in out.column("runs").to_pylist()] == [1, 0, 1]


@pytest.mark.parametrize("words,runs,left", [([b"a"] * 7, [(0, 7, 1)], b"a"), ([b"a", b"b"] * 4, [(0, 8, 2)], b"a b"), ([b"a"], [], b"a")])
def test_collapsed(words, runs, left):
    assert periodic.collapsed(words, np.array(runs, np.int64).reshape(-1, 3)) == left
