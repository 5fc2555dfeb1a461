"""Decontamination against a plain search, in one slice and in several."""

import hashlib
import random
import re

import pytest

from undula.llm import decontaminate as dc

DOCS = "doc_id bigint, text string, items string, spans int, n_words string, tag string"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    b = (t or "").encode()
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in b))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            v = words(x)
            k = min(10, len(v))
            pats = {tuple(v[p : p + k]) for p in range(len(v) - k + 1)} if v else set()
            for p in range(len(w) - k + 1):
                if k and tuple(w[p : p + k]) in pats:
                    hit.update(range(p, p + k))
                    found.add("" if item is None else str(item))
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def tables():
    r = random.Random(4)
    vocab = ["a", "Bé", "c3", "日本", "dog", "x"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", "-", "\n", "_", ". "]) for _ in range(n))
    items = [(i, text(r.randint(11, 16))) for i in range(12)] + [(20, "unique words"), (21, None), (22, ""), (23, "!?"), (None, "no id at all in here"), (1, "second text of one"), (30, "Unique WORDS")]
    docs = [(i, text(r.randint(0, 60))) for i in range(80)]
    docs += [(100 + i, "pre " + x + " post") for i, (_, x) in enumerate(items[:12])] + [(200, "UNIQUE\twords!"), (201, "uniquewords"), (202, "xunique wordsx"), (203, None), (204, ""), (205, "unique words " * 20_000), (None, "second text of one"), (100, "x")]
    return docs, items


@pytest.mark.parametrize("slice_bytes", [dc.SLICE_BYTES, 900])
def test_brute_force(spark, slice_bytes):
    docs, items = tables()
    d = spark.createDataFrame([(i, t, "x", 1, "y", "tag") for i, t in docs], DOCS)
    a = dc.annotated(d, spark.createDataFrame(items, "item_id bigint, text string"), slice_bytes=slice_bytes)
    assert set(a.columns) == {"doc_id", "text", "tag", "items", "n_words", "n_hit", "spans"}
    got = []
    for r in a.collect():
        got.append((str(r.doc_id), r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0))
        raw = (r.text or "").encode()
        assert sum(len(words(raw[s.start : s.stop].decode())) for s in r.spans) == r.n_hit
        assert all(raw[s.start : s.stop] and words(raw[s.start : s.stop].decode()) for s in r.spans)
    assert sorted(got) == brute(docs, items)


def test_digests_and_empty_tables(spark):
    docs, items = tables()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.digests(d, b).collect())
    assert got == brute(docs, items)
    assert dc.digests(d.limit(0), b).collect() == []
    assert all(not r.contaminated for r in dc.digests(d, b.limit(0)).collect())


def test_columns_of_any_name(spark):
    d = spark.createDataFrame([("x", "one two three", "t", 1, (2,), "i")], "doc_id string, text string, __text string, __bits int, `a b` struct<`c d`: int>, Items string")
    items = spark.createDataFrame([(1, "two three"), (2, "four")], "item_id bigint, text string")
    for size in (1 << 20, 70):
        out = dc.annotated(d, items, slice_bytes=size)
        assert out.columns == ["doc_id", "text", "__text", "__bits", "a b", "items", "n_words", "n_hit", "spans"]
        r = out.first()
        assert (r.items, r.n_hit, r["__text"], r["__bits"], r["a b"]["c d"]) == (["1"], 2, "t", 1, 2)
