"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its hashed words (weights sqrt(count / words)), some twenty statistics of its
structure, each as one of eight bins, and its declared length. The machine adds low-rank interactions of all
pairs; by the identity 2 * sum_{i<j} <v_i, v_j> x_i x_j = |sum v_i x_i|^2 - sum |v_i x_i|^2 a score costs
time linear in the features. It is fitted on a bounded sample of labelled rows and scored in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.batches import bound_batches
from undula.llm.labelled import fold, sample
from undula.session import ship_package

SAMPLE_ROWS = 12_000  # labelled rows that the machine is fitted on
WORDS = 1 << 14  # buckets of hashed words
BINS = 8
RANK = 8
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.08, 2e-5
THRESHOLD = 0.7
FOLDS, HELD = 4, 2
STATS = 21


def statistics(text: str, words: list[str], counts: Counter, declared: int | None) -> np.ndarray:
    """Structure of a text and its declared length; every value is finite, for empty texts too."""
    data = text.encode()
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, nw = max(1, len(data)), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    nl = max(1, len(lines))
    upper, lower, digit = h[65:91].sum(), h[97:123].sum(), h[48:58].sum()
    mark = h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()
    top = counts.most_common(1)[0][1] if counts else 0
    once = sum(1 for c in counts.values() if c == 1)
    runs = Counter(zip(words, words[1:], words[2:], strict=False))
    ended = sum(1 for x in lines if x.rstrip()[-1:] in (".", "!", "?", '"'))
    return np.array(
        [
            np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), len(words) / nl, sum(map(len, counts)) / max(1, len(counts)),
            upper / n, upper / max(1, upper + lower), digit / n, mark / n, h[128:].sum() / n, h[33] / n, h[124] / n, (h[35] + h[36] + h[37] + h[38] + h[42]) / n,
            len(counts) / nw, top / nw, once / nw, 1 - len(set(lines)) / nl, 1 - len(runs) / max(1, len(words) - 2), ended / nl, (h[46] + h[44]) / nw,
            np.log1p(max(0, declared or 0)),
        ]
    )


def features(text: str | None, declared: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, their weights, statistics)."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    buckets: dict[int, int] = {}
    for w, c in counts.items():
        b = zlib.crc32(w.lower().encode()) % WORDS
        buckets[b] = buckets.get(b, 0) + c
    idx = np.fromiter(buckets, np.int32, len(buckets))
    val = np.sqrt(np.fromiter(buckets.values(), np.float32, len(buckets)) / max(1, len(words)))
    return idx, val, statistics(text, words, counts, declared)


class Machine:
    """w0 + <w, x> + pair interactions; the last STATS * BINS features are the binned statistics."""

    def __init__(self, edges: np.ndarray):
        self.edges = edges  # STATS x (BINS - 1), ascending
        n = WORDS + STATS * BINS
        rng = np.random.default_rng(7)
        self.w0, self.w, self.v = 0.0, np.zeros(n, np.float32), rng.normal(0, 0.05, (n, RANK)).astype(np.float32)

    def row(self, idx: np.ndarray, val: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = (stats[:, None] > self.edges).sum(1) + np.arange(STATS) * BINS + WORDS
        return np.concatenate([idx, bins.astype(np.int32)]), np.concatenate([val, np.full(STATS, STATS**-0.5, np.float32)])

    def logits(self, idx: np.ndarray, val: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of rows laid end to end, and the sums of v_i x_i that the gradient needs."""
        vx = self.v[idx] * val[:, None]
        s = np.add.reduceat(vx, start, axis=0)
        pairs = 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), start))
        return self.w0 + np.add.reduceat(self.w[idx] * val, start) + pairs, s

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        """AdaGrad on the logistic loss, in an order that a fixed seed gives."""
        rng = np.random.default_rng(11)
        g0, gw, gv = 1e-8, np.full(len(self.w), 1e-8), np.full(self.v.shape, 1e-8)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), BATCH):
                pick = order[lo : lo + BATCH]
                idx, val = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
                size = np.array([len(rows[i][0]) for i in pick])
                start = np.cumsum(size) - size
                z, s = self.logits(idx, val, start)
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
                dr = np.repeat(d, size) * val
                u, inv = np.unique(idx, return_inverse=True)
                dw = np.bincount(inv, weights=dr, minlength=len(u)) + DECAY * self.w[u]
                inner = (np.repeat(s, size, axis=0) - self.v[idx] * val[:, None]) * dr[:, None]
                dv = np.stack([np.bincount(inv, weights=inner[:, f], minlength=len(u)) for f in range(RANK)], axis=1) + DECAY * self.v[u]
                g0 += d.sum() ** 2
                gw[u] += dw**2
                gv[u] += dv**2
                self.w0 -= RATE * d.sum() / np.sqrt(g0)
                self.w[u] -= (RATE * dw / np.sqrt(gw[u])).astype(np.float32)
                self.v[u] -= (RATE * dv / np.sqrt(gv[u])).astype(np.float32)


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [features(t, n) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        cols = [b.column(0), b.column(3), pa.array([x[0] for x in out], pa.list_(pa.int32())), pa.array([x[1] for x in out], pa.list_(pa.float32())), pa.array([x[2] for x in out], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "y", "idx", "val", "stats"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Machine:
    """A machine fitted on at most ``rows`` labelled rows outside the held-out fold.

    Their features (a few KB a row) are all that reaches the driver. Without labelled rows the machine
    gives every text the same score, 0.5.
    """
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    ids = F.broadcast(sample(labels, label, fold(F.col("doc_id"), FOLDS) != HELD, rows))
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = docs.select("doc_id", "text", F.col("n_chars").cast("bigint").alias("n_chars")).join(ids, "doc_id").select("doc_id", "text", "n_chars", "y")
    t = seen.mapInArrow(_featurised, f"doc_id {kind}, y int, idx array<int>, val array<float>, stats array<double>").toArrow()
    if not t.num_rows:
        return Machine(np.zeros((STATS, BINS - 1)))
    stats = np.array(t["stats"].to_pylist())
    order = np.lexsort((stats[:, 0], t["doc_id"].to_numpy()))
    m = Machine(np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T.copy())
    idx, val = [x.values.to_numpy() for x in t["idx"]], [x.values.to_numpy() for x in t["val"]]
    m.fit([m.row(idx[i], val[i], stats[i]) for i in order], t["y"].to_numpy()[order].astype(float))
    return m


def _scores(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine.value
        for b in batches:
            score = np.zeros(b.num_rows)
            for lo in range(0, b.num_rows, BATCH):
                rows = [m.row(*features(t, n)) for t, n in zip(b.column(1).slice(lo, BATCH).to_pylist(), b.column(2).slice(lo, BATCH).to_pylist(), strict=True)]
                size = np.array([len(r[0]) for r in rows])
                z, _ = m.logits(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(size) - size)
                score[lo : lo + BATCH] = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text, n_chars).

    Null texts count as empty, null lengths as 0; an empty text is scored by its statistics alone. Repeated
    rows score alike; an empty table gives no rows.
    """
    machine = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", "text", F.col("n_chars").cast("bigint").alias("n_chars")).mapInArrow(_scores(machine), f"doc_id {kind}, score double")
    return d.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
