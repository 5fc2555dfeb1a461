"""Ranked lexical search against a plain scoring of every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from undula.llm import lexical

DOCS = "doc_id bigint, text string, term string, shard int, `a b` struct<`c d`: int>"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**40)))
def test_packed_values_come_back(values):
    data, at = lexical.packed(np.array(values, np.int64))
    assert lexical.unpacked(data).tolist() == values and len(at) == len(values) + 1 and at[-1] == len(data)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 9), st.integers(1, 9)), min_size=1), st.integers(0, 60))
def test_fronts_hold_the_highest_impact(postings, ratio):
    block, size, tf = np.array(sorted(postings)).T
    kept = lexical._fronts(block, size, tf)
    value = lexical.impact(tf, 8 * (25 + ratio * size))
    for b in np.unique(block):
        assert value[kept][block[kept] == b].max() == value[block == b].max()


def terms(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", (text or "").translate(str.maketrans(lexical._UPPER, lexical._LOWER)))


def plain(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    size = [sum(c.values()) for _, c in held]
    n, total = sum(s > 0 for s in size), sum(size)
    df = Counter(t for _, c in held for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, Counter()).update(terms(t))
    out = []
    for q, words in queries.items():
        found = []
        for (i, c), s in zip(held, size, strict=True):
            m = 25 + (75 * s * n) // total if total else 0
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in words.items() if t in c)
            if score > 0:
                found.append((-score, (i is not None, i), i))
        out += [(q, r, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def answers(spark, docs, items, k=10, group=1024, **shards):
    d = spark.createDataFrame([(i, t, "t", 0, (1,)) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, weight int, place string")
    return sorted(map(tuple, lexical.ranked(lexical.index(d, **shards), lexical.query_terms(q), k, group).collect()), key=str)


@pytest.mark.parametrize("settings", [{}, {"shard_words": 300, "shard_docs": 40, "group": 3}, {"k": 3, "shard_docs": 7}])
def test_equals_a_plain_scoring(spark, settings):
    rng = np.random.default_rng(3)
    word = lambda: f"w{min(int(rng.zipf(1.3)), 400)}"
    docs = [(i, " ".join(word() for _ in range(rng.integers(0, 30)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(150)]  # a third are copies: ties by id
    docs += [(501, None), (502, ""), (503, "!!! -- ..."), (None, docs[7][1]), (None, "W1 w2 É-é"), (504, "w3 " * 5000), (7, docs[7][1]), (505, "w1_w2/W3 é\x7f日本")]
    items = [(i, " ".join(word() for _ in range(9))) for i in range(12)] + [(20, docs[7][1]), (21, None), (22, ""), (23, "nowhere"), (24, "É é 日本 w1 w1"), (24, "w2"), (None, "w1")]
    k = settings.get("k", 10)
    assert answers(spark, docs, items, **settings) == plain(docs, [(i, t) for i, t in items if i is not None], k)


def test_empty_tables_and_string_ids(spark):
    assert answers(spark, [], [(1, "a")]) == [] and answers(spark, [(1, "a")], []) == [] and answers(spark, [(1, None)], [(1, "a")]) == []
    d = spark.createDataFrame([("b", "x y"), ("a", "y x"), ("c", "z z z z")], "name string, body string")
    q = spark.createDataFrame([("q", "x")], "label string, words string")
    got = lexical.ranked(lexical.index(d, "name", "body"), lexical.query_terms(q, "label", "words"))
    assert [(r.item_id, r["rank"], r.doc_id) for r in got.collect()] == [("q", 1, "a"), ("q", 2, "b")]


def test_blocks_below_the_threshold_stay_compressed():
    n = 6400
    sizes = np.where(np.arange(n) % 640 < 64, 5, 5000)  # short documents in few blocks
    penalty = 8 * (25 + sizes // 10)

    def posting_list(places, tf):
        blocks = [slice(i, i + 128) for i in range(0, len(places), 128)]
        data = []
        for b in blocks:
            p = places[b]
            data.append(lexical.packed(np.stack((np.diff(p, prepend=0), tf[b]), 1).ravel())[0].tobytes())
        return lexical._List(places[[min(b.stop, len(places)) - 1 for b in blocks]], np.array([lexical.impact(tf[b], penalty[places[b]]).max() for b in blocks]), data, {})

    rare, common = np.arange(0, n, 640), np.arange(n)
    lists = [(9000, posting_list(rare, np.full(len(rare), 3))), (50, posting_list(common, np.ones(n, np.int64)))]
    place, score = lexical.search(lists, penalty, 5)
    want = np.zeros(n, np.int64)
    want[rare] += 9000 * lexical.impact(np.full(len(rare), 3), penalty[rare])
    want += 50 * lexical.impact(np.ones(n, np.int64), penalty)
    best = np.lexsort((np.arange(n), -want))[:5]
    assert place.tolist() == best.tolist() and score.tolist() == want[best].tolist()
    assert 0 < len(lists[1][1].decoded) <= len(rare) < len(lists[1][1].data)
