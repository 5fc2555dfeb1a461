"""Token counts against the tokenizer library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from undula.llm import tokens

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
PARTS = ["'s", "'re", "'ll", "'v", "'", "''", " ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "Z", "é", "1", "²", "٣", "!", "?", "<|endoftext|>", "<|endoftext", "日本", " ", "　", "don't", "I'm", "we'LL", "😀", "\x1c", "́", "ing", "the", "'d", "e", "l", "r", "​", "\x85"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(*tokens.read_tokenizer(PATH), tokens.changed_characters())


def test_random_strings(library, counter):
    r = random.Random(3)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(5000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x300), r.randrange(1, 0xD7FF), r.randrange(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(1000)]
    assert counter.counts(texts).tolist() == library(texts)


def test_long_pretokens_and_runs(library, counter):
    texts = ["", "a" * 3000, " " * 500, "\n" * 333, "x" + " " * 77 + "y", "ab" * 20_000, "!?" * 700, "<|endoftext|>" * 9, "0" * 999]
    assert counter.counts(texts).tolist() == library(texts)


def test_any_chunk_length_gives_the_same_boundaries(counter):
    import numpy as np

    text = "don't  stop, I'll\n\n go 12ab'rest !'s   \n x" * 3
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    first = np.zeros(len(cp), bool)
    first[[0, 11]] = True
    sym = tokens.symbols(cp, first, counter.classes)
    want = tokens.starts_of_pretokens(sym, counter.to, counter.new, chunk=len(cp))
    for chunk in (1, 2, 3, 7, 64):
        assert (tokens.starts_of_pretokens(sym, counter.to, counter.new, chunk=chunk) == want).all()


def test_merges_go_one_by_one_and_words_are_counted_once(monkeypatch):
    # a merge that a new token takes part in may come before the next equal pair
    m = tokens.Merger({(b"b", b"c"): 0, (b"a", b"bc"): 1, (b"a", b"a"): 2, (b"aa", b"a"): 3, (b"x", b"y"): 5, (b"xy", b"x"): 4})
    assert m.encode(b"aaaabc") == [b"aaa", b"abc"]
    assert m.encode(b"xyxyxy") == [b"xyx", b"y", b"xy"]
    assert (m.encode(b""), m.encode(b"q")) == ([], [b"q"])
    seen, real = [], tokens.Merger.count
    monkeypatch.setattr(tokens.Merger, "count", lambda self, w: seen.append(w) or real(self, w))
    long = "z" * (tokens.LONG + 1)
    assert tokens.Counter([], []).counts([f"{long} {long}", f" {long}"]).tolist() == [99, 50]
    assert len(seen) == len(set(seen))


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "STATES", 50)
    monkeypatch.setattr(tokens, "KNOWN", 3)
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 40)
    texts = ["The quick brown fox jumps over the lazy dog, unbelievably!"] * 3 + ["Étrangement naïve"]
    assert tokens.Counter(*tokens.read_tokenizer(PATH)).counts(texts).tolist() == library(texts)


def test_table(spark, library):
    rows = [(1, "Hello world", 5), (2, None, 5), (3, "", 5), (3, "", 5), (None, "x " * 600, 5), (4, "word" * 50_000, 5)]
    d = tokens.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int"), PATH)
    want = sorted((str(i), len((t or "").encode()), library([t or ""])[0]) for i, t, _ in rows)
    got = d.collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokens.token_counts(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []
