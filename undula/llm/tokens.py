"""Exact token counts from compiled finite-state transducers.

A byte-level BPE tokenizer is two deterministic transducers:

* The splitter reads characters and emits where a pretoken starts. Texts are cut into chunks of equal length;
  each chunk becomes a map from every state to its end state, the maps are composed by a parallel prefix
  scan, and a second pass from the true start states emits the boundaries. All chunks run side by side.
* The merger reads a pretoken's bytes, and each transition is annotated with the tokens that it adds
  (fewer, where a longer token replaces several). Its state is what decides the future: the longest suffix
  that some token starts with, and for every position inside that suffix the last token of the encoding up
  to there and its count. States and transitions are compiled as texts need them.

A token may follow another in an encoding exactly if the two, joined, are encoded as these two; so the last
token of every prefix is the only vocabulary suffix that may follow the last token before it.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.batches import bound_batches
from undula.session import ship_package

CHUNK = 64  # characters of a splitter chunk
BLOCK_CHARS = 1_000_000  # characters that are split at once
KNOWN = 300_000  # pretokens whose counts a worker remembers
LONG = 48  # bytes of the longest pretoken that is remembered
STATES = 400_000  # merger states that a worker keeps before it starts anew

# Symbols of the splitter; a white space character or a contraction's letter depends on its successor too.
L, C1, C2, N, O, A, SP_LAST, SP_MORE, WS_LAST, WS_MORE = range(10)
SYMBOLS = 10
# States: nothing open; letters; digits; others; a blank that the next character joins; white space;
# an apostrophe that starts a pretoken; the first of two contraction letters.
START, LETTERS, DIGITS, OTHERS, BLANK, SPACES, QUOTE, PAIR = range(8)
STATE_COUNT = 8
#: White space of Unicode (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a pretoken starts here) by state and symbol; symbols from SYMBOLS on start a text."""
    fresh = {L: LETTERS, C1: LETTERS, C2: LETTERS, N: DIGITS, O: OTHERS, A: QUOTE, SP_LAST: BLANK, SP_MORE: SPACES, WS_LAST: START, WS_MORE: SPACES}
    to = np.zeros((STATE_COUNT, 2 * SYMBOLS), np.uint8)
    new = np.ones((STATE_COUNT, 2 * SYMBOLS), np.uint8)
    for s, n in fresh.items():
        to[:, s] = to[:, s + SYMBOLS] = n
    goes_on = {
        LETTERS: dict.fromkeys((L, C1, C2), LETTERS),
        DIGITS: {N: DIGITS},
        OTHERS: dict.fromkeys((O, A), OTHERS),
        BLANK: {L: LETTERS, C1: LETTERS, C2: LETTERS, N: DIGITS, O: OTHERS, A: OTHERS},
        SPACES: dict.fromkeys((SP_MORE, WS_MORE), SPACES),
        QUOTE: {C1: START, C2: PAIR, O: OTHERS, A: OTHERS},
        PAIR: dict.fromkeys(range(SYMBOLS), START),
    }
    for state, row in goes_on.items():
        for s, n in row.items():
            to[state, s], new[state, s] = n, 0
    return to, new


def changed_characters() -> dict[int, int]:
    """Classes of the characters that the tokenizer library's Unicode version classes otherwise than this Python's."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    joins = lambda head, c: len(cut(head + chr(c))) == 1
    kinds = {c: unicodedata.category(chr(c)) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000}
    out = {c: O for c, k in kinds.items() if k[0] in "LN" and not joins("a" if k[0] == "L" else "1", c)}
    unknown = [c for c, k in kinds.items() if k == "Cn"]
    for i in range(0, len(unknown), 256):
        some = unknown[i : i + 256]
        for head, kind in (("a", L), ("1", N)):
            if len(cut("".join(head + chr(c) for c in some))) < 2 * len(some):
                out |= {c: kind for c in some if joins(head, c)}
    return out


def character_classes(changed: dict[int, int] | None = None) -> np.ndarray:
    """L, N, O, A, SP_MORE or WS_MORE of every code point, before successors are looked at."""
    out = np.full(0x110000, O, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = L
        elif kind == "N":
            out[c] = N
    for c, kind in (changed or {}).items():
        out[c] = kind
    out[WHITE] = WS_MORE
    out[0x20], out[0x27] = SP_MORE, A
    return out


def symbols(cp: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Splitter symbols of texts laid end to end; ``first`` marks the first character of each."""
    s = classes[cp]
    nxt = np.full(len(cp), SP_MORE, np.uint8)
    nxt[:-1] = s[1:]
    ends = np.append(first[1:], True)
    space, follows = s >= SP_LAST, (nxt < SP_LAST) & ~ends
    after = np.where(ends, 0, np.append(cp[1:], 0))
    s = s - (space & follows).astype(np.uint8)  # SP_MORE -> SP_LAST, WS_MORE -> WS_LAST
    s[np.isin(cp, [ord(c) for c in "stmd"])] = C1
    s[(np.isin(cp, [ord("r"), ord("v")]) & (after == ord("e"))) | ((cp == ord("l")) & (after == ord("l")))] = C2
    s[first] += SYMBOLS
    return s


def starts_of_pretokens(sym: np.ndarray, to: np.ndarray, new: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Flag of each character: does a pretoken start here?"""
    n = len(sym)
    m = -(-n // chunk)
    lanes = np.full(m * chunk, L, np.uint8)
    lanes[:n] = sym
    lanes = lanes.reshape(m, chunk).T.copy()
    maps = np.tile(np.arange(STATE_COUNT, dtype=np.uint8), (m, 1))
    for t in range(chunk):
        maps = to[maps, lanes[t][:, None]]
    step = 1
    while step < m:  # inclusive scan: maps[i] becomes the map of chunks 0..i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    state = np.concatenate(([START], maps[:-1, START])).astype(np.uint8)
    flags = np.empty((chunk, m), np.uint8)
    for t in range(chunk):
        flags[t] = new[state, lanes[t]]
        state = to[state, lanes[t]]
    return flags.T.reshape(-1)[:n].astype(bool)


class Merger:
    """The transducer over a pretoken's bytes; compiled lazily, exact for every byte string."""

    def __init__(self, ranks: dict[tuple[bytes, bytes], int]):
        self.ranks = ranks
        self.words = {bytes([b]) for b in range(256)} | {a + b for a, b in ranks}
        self.heads = {w[:i] for w in self.words for i in range(1, len(w) + 1)}
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.next: list[dict[int, tuple[int, int]]] = []
        self._id((b"", (None,), (0,)))

    def _id(self, key: tuple) -> int:
        i = self.ids.get(key)
        if i is None:
            i = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        return i

    def encode(self, data: bytes) -> list[bytes]:
        """Merges by rank, leftmost first; for short strings."""
        none, rank = 1 << 60, self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        order = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]  # of each part with its successor
        while order and (best := min(order)) < none:
            i = order.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i:
                order[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(order):
                order[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def may_follow(self, before: bytes | None, word: bytes) -> bool:
        key = (before or b"", word)
        if key not in self.follows:
            self.follows[key] = self.encode(key[0] + word) == ([word] if before is None else [before, word])
        return self.follows[key]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from ``state``: (next state, tokens added)."""
        suffix, last, count = self.keys[state]
        v = suffix + bytes([byte])
        for j in range(len(v)):  # the token may start at any position of the suffix
            if v[j:] in self.words and self.may_follow(last[j], v[j:]):
                break
        else:
            raise ValueError("no token fits; the vocabulary is not closed under its merges")
        added = count[j] + 1
        last, count = (*last, v[j:]), (*(c - added for c in count), 0)
        cut = next(i for i in range(len(v) + 1) if i == len(v) or v[i:] in self.heads)
        t = self.next[state][byte] = (self._id((v[cut:], last[cut:], count[cut:])), added)
        return t

    def count(self, data: bytes) -> int:
        state, total, nxt = 0, 0, self.next
        for b in data:
            t = nxt[state].get(b) or self.compile(state, b)
            state = t[0]
            total += t[1]
        if len(self.keys) > STATES:
            self.clear()
        return total


def bytes_of_letters() -> dict[str, int]:
    """The byte that each printable letter stands for in byte-level vocabulary files: printable bytes stand
    for themselves, the others take the letters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_tokenizer(path: str) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """(merges in rank order, special strings) of a byte-level BPE file with the usual splitting pattern."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    pre, model = j["pre_tokenizer"], j["model"]
    if j["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE" or model.get("ignore_merges"):
        raise ValueError("only byte-level BPE without a normalizer is compiled")
    back = bytes_of_letters()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    as_bytes = lambda s: bytes(back[c] for c in s)
    return [(as_bytes(a), as_bytes(b)) for a, b in merges], [t["content"] for t in j["added_tokens"]]


class Counter:
    """Token counts of whole texts; one per worker."""

    def __init__(self, merges: list[tuple[bytes, bytes]], special: list[str], changed: dict[int, int] | None = None):
        self.merger = Merger({m: i for i, m in enumerate(merges)})
        self.special = [s for s in special if s]
        self.classes = character_classes(changed)
        self.to, self.new = splitter()
        self.known: dict[bytes, int] = {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The text around special strings, and how many of these there are (the first in the text wins)."""
        if not any(s in text for s in self.special):
            return [text], 0
        out, n, at = [], 0, 0
        while True:
            found = [(i, -len(s), s) for s in self.special if (i := text.find(s, at)) >= 0]
            if not found:
                return [*out, text[at:]], n
            i, _, s = min(found)
            out.append(text[at:i])
            n, at = n + 1, i + len(s)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        held, owner, size = [], [], 0
        for i, text in enumerate(texts):
            parts, n = self.pieces(text)
            total[i] += n
            for p in parts:
                if p:
                    held.append(p)
                    owner.append(i)
                    size += len(p)
            if size >= BLOCK_CHARS:
                self._add(held, owner, total)
                held, owner, size = [], [], 0
        self._add(held, owner, total)
        return total

    def _add(self, parts: list[str], owner: list[int], total: np.ndarray) -> None:
        if not parts:
            return
        joined = "".join(parts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.cumsum(size) - size
        first = np.zeros(len(cp), bool)
        first[at] = True
        start = np.flatnonzero(starts_of_pretokens(symbols(cp, first, self.classes), self.to, self.new))
        width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
        offset = np.append((np.cumsum(width) - width)[start], int(width.sum())).tolist()
        data, known, merger = joined.encode(), self.known, self.merger
        words = [data[a:b] for a, b in zip(offset, offset[1:], strict=False)]
        out = list(map(known.get, words))
        fresh: dict[bytes, int] = {}  # counted once, also where too long to remember
        for i, n in enumerate(out):
            if n is None:
                w = words[i]
                n = fresh.get(w)
                if n is None:
                    n = fresh[w] = merger.count(w)
                out[i] = n
        known.update((w, n) for w, n in fresh.items() if len(w) <= LONG)
        if len(known) > KNOWN:
            known.clear()
        np.add.at(total, np.asarray(owner), np.add.reduceat(np.array(out, np.int64), np.searchsorted(start, at)))


_counter: dict[str, Counter] = {}


def _counted(key: str, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counter:
            _counter.clear()
            _counter[key] = Counter(*model.value)
        c = _counter[key]
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(c.counts(texts))], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``; ``tokenizer`` is a file's path.

    Only the driver reads the file; its merges, of a fixed size, are broadcast. Null texts are empty and have
    no tokens; special strings inside texts count as one token each; repeated rows are counted alike; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    model = spark.sparkContext.broadcast((*read_tokenizer(tokenizer), changed_characters()))
    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    d = d.mapInArrow(_counted(tokenizer, model), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return d.withColumn("over_limit", F.col("n_tokens") > limit)
