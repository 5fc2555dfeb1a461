"""Stretches of words that repeat with a period, found by recompression.

A run is a stretch of consecutive words with smallest period q and length >= max(SHORTEST, TIMES * q) that no
neighbouring word extends. For each period p, a run has TIMES - 1 = 3 neighbouring multiples of p (the harmonic
grid) whose words equal those p further on. Such grid points are the candidates; the extensions of (i, i + p) to
both sides, asked of a run-length grammar, give the exact ends. A stretch that also has a smaller period is
found with that one too, with the same ends, so the smallest period of equal ends counts.

Texts are taken many at a time: one grid, one grammar and one series of questions serve a group of texts.
Only texts with candidates get into the grammar. No row leaves its task, so there is no shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.batches import bound_batches
from undula.llm.recompression import SEPARATOR, Grammar
from undula.session import ship_package

SHORTEST, TIMES = 6, 4
GROUP_WORDS = 1_000_000  # texts are taken together up to so many words; a longer text is a group of its own


def _grid(x: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of the candidates, by period and place. ``ends``: the separator behind each sequence,
    longest sequence first."""
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(sizes) or sizes[0] < SHORTEST:
        return places[0], periods[0]
    for p in range(1, int(sizes[0]) // TIMES + 1):
        fit = int(np.searchsorted(-sizes, -max(SHORTEST, TIMES * p), side="right"))
        if not fit:
            break
        y = x[: ends[fit - 1] + 1 : p]
        same = y[1:] == y[:-1]
        hit = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(hit):
            hit = hit[y[hit] != SEPARATOR]
            # three equal steps from the hit on: each of them may be the one inside the run
            hit = np.unique(np.concatenate((hit, hit + 1, hit + 2)))
            places.append(hit * p)
            periods.append(np.full(len(hit), p))
    return np.concatenate(places), np.concatenate(periods)


def _stretches(g: Grammar, place: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the runs through the candidates."""
    if not len(place):
        return np.zeros((0, 3), np.int64)

    def ask(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, p = place[at], period[at]
        return i - g.extension(i, i + p, -1), i + g.extension(i, i + p) + p

    follows = np.concatenate(([False], (period[1:] == period[:-1]) & (place[1:] == place[:-1] + period[1:])))
    lead = np.flatnonzero(~follows)
    start, end = ask(lead)  # most rows of neighbouring candidates lie in the first one's stretch
    rest = np.flatnonzero(follows)
    rest = rest[place[rest] + period[rest] >= end[np.cumsum(~follows)[rest] - 1]]
    more = ask(rest)
    at = np.concatenate((lead, rest))
    rows = np.stack((np.concatenate((start, more[0])), np.concatenate((end, more[1])), period[at]), axis=1)
    rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(SHORTEST, TIMES * rows[:, 2])]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[new]


def _laid_out(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences with separators around them, and where each begins."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    x = np.full(int(sizes.sum()) + len(sizes) + 1, SEPARATOR, np.int64)
    for s, at in zip(sequences, begins.tolist(), strict=True):
        x[at : at + len(s)] = s
    return x, begins


def runs_of(sequences: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of symbols (int64, 1 or more) its runs, rows (start, length, period) by start and period."""
    out = [np.zeros((0, 3), np.int64)] * len(sequences)
    sizes = np.array([len(s) for s in sequences], np.int64)
    order = np.flatnonzero(sizes >= SHORTEST)
    order = order[np.argsort(-sizes[order], kind="stable")]
    x, begins = _laid_out([sequences[k] for k in order])
    place, period = _grid(x.astype(np.int32) if x.max() < 2**31 else x, begins + sizes[order], sizes[order])
    k = np.searchsorted(begins, place, side="right") - 1
    inside = place + period < (begins + sizes[order])[k]  # not with a word of the next sequence
    place, period, k = place[inside], period[inside], k[inside]
    if not len(place):
        return out
    held = np.unique(k)  # only sequences with candidates
    x, again = _laid_out([sequences[order[h]] for h in held])
    at = np.searchsorted(held, k)
    rows = _stretches(Grammar(x), place - begins[k] + again[at], period)
    whose = np.searchsorted(again, rows[:, 0], side="right") - 1
    for n in np.unique(whose):
        r = rows[whose == n]
        r = np.stack((r[:, 0] - again[n], r[:, 1] - r[:, 0], r[:, 2]), axis=1)
        out[order[held[n]]] = r[np.lexsort((r[:, 2], r[:, 0]))]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _run_column(runs: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
    flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    cells = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(_RUN))
    return pa.ListArray.from_arrays(pa.array(offsets), cells)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        begin, texts = 0, b.column(1).cast(pa.binary())
        while begin < b.num_rows:
            known = defaultdict(count(1).__next__)
            words, sequences, total, end = [], [], 0, begin
            while end < b.num_rows and (end == begin or total < GROUP_WORDS):
                words.append((texts[end].as_py() or b"").split())  # at the bytes 0x20 and 0x09 to 0x0D
                sequences.append(np.fromiter(map(known.__getitem__, words[-1]), np.int64, len(words[-1])))
                total, end = total + len(words[-1]), end + 1
            runs = runs_of(sequences)
            sizes = pa.array(np.array([len(s) for s in sequences], np.int64))
            kept = pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.large_binary()).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), sizes, _run_column(runs), kept], names=["doc_id", "n_words", "runs", "kept"])
            begin = end


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, kept) for every row of ``docs``.

    Words are the stretches without space, tab, line feed, vertical tab, form feed and carriage return, numbered
    from 0. ``runs`` lists (start, length, period) by start and period; ``kept`` is the text without the words that a
    run holds behind its first period, words joined by one space. Null and empty texts have no words, no runs and
    an empty ``kept``. Every row is judged on its own, so repeated rows, repeated ids and null ids stay as they are.
    Columns besides the two named ones are not read. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = d.mapInArrow(_found, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept binary")
    return found.withColumn("kept", F.col("kept").cast("string"))
