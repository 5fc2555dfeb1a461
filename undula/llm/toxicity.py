"""Toxicity by class-conditional Kneser-Ney models over characters.

Texts are sequences of 32 symbols: the letters a-z in either case, five classes of other bytes from 0x80,
and one symbol for all that separates words. Two models of order 5, one of toxic and one of ordinary
labelled texts, share their backoff: below the highest order, continuation counts of orders 4 down to 1 come from
both classes together, so an expression that one class has rarely or never seen is smoothed alike in both. A text is
compared by the difference of the two log-likelihoods divided by its length: over the whole text, and over
stretches of 8 and 16 symbols by how far they exceed what is usual in that text (its median and three median
deviations), which takes out what a language or a style does to all of a text. A logistic curve, fitted on
labelled rows that were not counted, makes a probability of the three.

Ratios are whole multiples of 1 / UNIT, so sums are exact and a text's score does not depend on the pieces in which
it is read; of each piece only the counts of its stretches' values are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.llm.batches import bound_batches
from undula.llm.labelled import SAMPLE_ROWS, fold, labelled, sample
from undula.llm.rows import held, released, with_fields
from undula.session import ship_package, stage

ORDER, BITS = 5, 5
DISCOUNT = 0.85
PIECE = 1 << 20  # bytes of a text in memory at once
FOLDS = 5  # fold 0 is held out, the last is for the curve, the others are counted
STRETCHES = (8, 16)  # symbols
UNIT, STEPS = 1 << 20, 1024  # parts of 1 in a symbol's ratio, and in the value of a stretch
FAR = 16  # ratios end here
CODE = np.array([b - 64 if 65 <= b <= 90 else b - 96 if 97 <= b <= 122 else 27 + b % 5 if b >= 128 else 0 for b in range(256)], np.int32)


def grams(data: bytes) -> Iterator[np.ndarray]:
    """Keys of the symbol 5-grams that end at each byte (25 bits), piece by piece."""
    for at in range(0, len(data), PIECE):
        head = data[max(0, at - ORDER + 1) : at]
        c = CODE[np.frombuffer(b" " * (ORDER - 1 - len(head)) + head + data[at : at + PIECE], np.uint8)]
        n = len(c) - ORDER + 1
        k = c[:n].copy()
        for j in range(1, ORDER):
            k <<= BITS
            k |= c[j : j + n]
        yield k


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic, ordinary) counts of a task's texts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # (2 * key + label, count), merged when they grow
    size = 0

    def merge() -> None:
        nonlocal held, size
        if held:
            k, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            u, at = np.unique(k, return_inverse=True)
            held = [(u, np.bincount(at, weights=n).astype(np.int64))]
            size = 0

    for b in batches:
        for text, y in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), strict=True):
            for k in grams(text.as_py() or b""):
                u, n = np.unique(k, return_counts=True)
                held.append((u * 2 + y, n))
                size += len(u)
            if size > 1_000_000:
                merge()
    merge()
    for k, n in held:
        for i in range(0, len(k), 100_000):
            key, toxic = k[i : i + 100_000] >> 1, (k[i : i + 100_000] & 1).astype(bool)
            c = n[i : i + 100_000]
            yield pa.record_batch([pa.array(key.astype(np.int32)), pa.array(np.where(toxic, c, 0)), pa.array(np.where(toxic, 0, c))], names=["key", "toxic", "ordinary"])


def shared_backoff(keys: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, shared): Kneser-Ney probabilities of the grams one symbol shorter than the distinct ``keys`` of ``order``.

    A gram's continuation count is the number of different symbols before it; orders go down to single symbols, whose
    backoff is even. Tables have at most a row for each gram.
    """
    short = keys.select(F.expr(f"key & {(1 << (order - 1) * BITS) - 1}").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    short = short.withColumns({"before": F.expr(f"shiftright(key, {BITS})"), "low": F.expr(f"key & {(1 << max(0, order - 2) * BITS) - 1}")})
    sums = short.groupBy("before").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    short = short.join(sums, "before")
    if order > 2:
        short = short.join(shared_backoff(short.select("key"), order - 1).select(F.col("key").alias("low"), F.col("shared").alias("lower")), "low")
    else:
        short = short.withColumn("lower", F.lit(1.0 / (1 << BITS)))
    shared = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("lower")) / F.col("all")
    return short.select("key", shared.alias("shared"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(context, unseen, seen): per context the log ratio of the two models for each symbol seen after it,
    as (code, ratio), and for symbols never seen after it."""
    g = counts.withColumns({"context": F.expr(f"shiftright(key, {BITS})"), "low": F.expr(f"key & {(1 << (ORDER - 1) * BITS) - 1}")})
    low = shared_backoff(g.select("key")).withColumnRenamed("key", "low")
    sums = [F.sum(c).alias(f"{c}_all") for c in ("toxic", "ordinary")] + [F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in ("toxic", "ordinary")]
    context = g.groupBy("context").agg(*sums)

    def p(c: str) -> Column:
        own = (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"{c}_kinds") * F.col("shared")) / F.col(f"{c}_all")
        return F.when(F.col(f"{c}_all") > 0, own).otherwise(F.col("shared"))

    def rest(c: str) -> Column:
        return F.when(F.col(f"{c}_all") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_all")).otherwise(1.0)

    g = g.join(low, "low").join(context, "context")
    g = g.select("context", F.ln(rest("toxic") / rest("ordinary")).alias("unseen"), F.expr(f"key & {(1 << BITS) - 1}").alias("code"), F.ln(p("toxic") / p("ordinary")).alias("ratio"))
    return g.groupBy("context").agg(F.first("unseen").alias("unseen"), F.array_sort(F.collect_list(F.struct("code", "ratio"))).alias("seen"))


class Model:
    """Log ratios as a row of 32 per context and the row of each context; row 0 is for contexts never seen.
    Symbols have 5 bits and contexts 20, so the rows can never exceed 128 MB; natural text has some 10,000."""

    def __init__(self, ratios: DataFrame):
        rows = ratios.select("context", "unseen", "seen.code", "seen.ratio").toArrow()
        n = rows.num_rows
        self.row = np.zeros(1 << (ORDER - 1) * BITS, np.int32)
        self.table = np.zeros((n + 1, 1 << BITS), np.int32)
        whole = lambda x: np.rint(np.clip(x, -FAR, FAR) * UNIT)
        if n:
            rows = rows.combine_chunks()
            self.row[rows["context"].to_numpy()] = np.arange(1, n + 1)
            self.table[1:] = whole(rows["unseen"].to_numpy())[:, None]
            code = rows["code"].chunk(0)
            at = np.repeat(np.arange(1, n + 1), np.diff(code.offsets.to_numpy()))
            self.table[at, code.flatten().to_numpy()] = whole(rows["ratio"].chunk(0).flatten().to_numpy())

    def raw(self, data: bytes) -> np.ndarray:
        """Log-likelihood ratio per symbol: of the whole text, then the excess of each length of stretches."""
        if not data:
            return np.zeros(1 + len(STRETCHES))
        total, last = 0, np.zeros(0, np.int32)
        values: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in STRETCHES]  # (value, count) of each length
        for k in grams(data):
            v = np.concatenate((last, self.table[self.row[k >> BITS], k & ((1 << BITS) - 1)]))
            sums = np.concatenate(([0], np.cumsum(v, dtype=np.int64)))
            total += int(sums[-1] - sums[len(last)])
            for n, held in zip(STRETCHES, values, strict=True):
                begin = max(0, len(last) - n + 1)  # stretches that end in this piece
                held.append(np.unique((sums[begin + n :] - sums[begin:-n]) * STEPS // (n * UNIT), return_counts=True))
                if len(held) > 8:
                    held[:] = [_merged(held)]
            last = v[-max(STRETCHES) + 1 :]
        short = np.array([total * STEPS // (len(data) * UNIT)])  # of a text shorter than a stretch: all of it
        excess = [_excess(*(_merged(h) if len(data) >= n else (short, np.ones(1, np.int64)))) for n, h in zip(STRETCHES, values, strict=True)]
        return np.array([total / (UNIT * len(data)), *excess])


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(held) == 1:
        return held[0]
    value, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    return value, np.bincount(at, weights=np.concatenate([h[1] for h in held])).astype(np.int64)


def _excess(value: np.ndarray, count: np.ndarray) -> float:
    """The mean of how far values exceed their median and three median deviations; ``value`` is sorted."""

    def twice_median(v: np.ndarray, c: np.ndarray) -> int:
        upto, n = np.cumsum(c), int(c.sum())
        return int(v[np.searchsorted(upto, (n - 1) // 2, "right")] + v[np.searchsorted(upto, n // 2, "right")])

    usual = twice_median(value, count)
    off = np.abs(2 * value - usual)
    order = np.argsort(off, kind="stable")
    over = 4 * value - 2 * usual - 3 * twice_median(off[order], count[order])
    return float((np.maximum(over, 0) * count).sum()) / (4 * STEPS * int(count.sum()))


def _raw_scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            raw = [m.raw(t.as_py() or b"") for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(raw, pa.list_(pa.float64()))], names=["rest", "raw"])

    return run


def with_raw(docs: DataFrame, model, text: str = "text", replaced: tuple[str, ...] = ()) -> DataFrame:
    """(rest, raw): the columns of ``docs`` but the ``replaced`` ones, and the raw scores of each text; ``model`` is a
    broadcast Model."""
    d = held(docs, replaced, text=text)
    return d.mapInArrow(_raw_scores(model), with_fields(d, ["text"], [T.StructField("raw", T.ArrayType(T.DoubleType()))]))


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and, last, the offset of the logistic curve, by Newton steps with a small penalty."""
    if not len(y):
        return np.append(np.zeros(1 + len(STRETCHES)), -1.0)  # nothing is known: unlikely to be toxic
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (p - y) + 0.1 * w)
        w -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS):
    """(broadcast Model, curve) from the labelled rows whose fold is not 0.

    The model counts every labelled row but those of the last fold, which are for the curve: at most ``rows``
    of them, whose raw scores, three numbers a row, are all that comes to the driver. The counted texts meet
    their labels in a shuffled join, since labels grow with the input; the curve's ids are bounded and go to
    the texts.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    texts, part = docs.select("doc_id", "text"), fold(F.col("doc_id"), FOLDS)
    counting = (part > 0) & (part < FOLDS - 1)
    counted = texts.filter(counting).join(labelled(labels, label, counting).hint("merge"), "doc_id").select("text", "y")
    counted = counted.mapInArrow(_count, "key int, toxic bigint, ordinary bigint")
    counts = stage(counted.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "grams")
    model = spark.sparkContext.broadcast(Model(log_ratios(counts)))
    ids = F.broadcast(sample(labels, label, part == FOLDS - 1, rows))
    rest = with_raw(texts.join(ids, "doc_id").select("text", "y"), model).select("rest.y", "raw").toArrow()
    x = np.array(rest["raw"].to_pylist()).reshape(-1, 1 + len(STRETCHES))
    order = np.lexsort(x.T)  # rows come in any order; sums must not depend on it
    return model, fit_curve(x[order], rest["y"].to_numpy()[order].astype(float))


def with_scores(docs: DataFrame, fitted) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1, and ``predicted`` (1 from 0.5 on), which replace columns of
    these names."""
    model, curve = fitted
    d = with_raw(docs, model, replaced=("score", "predicted"))
    z = sum((F.col("raw")[i] * float(c) for i, c in enumerate(curve[:-1])), F.lit(float(curve[-1])))
    d = d.select("rest", (1 / (1 + F.exp(-z))).alias("score"))
    return released(d, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts have raw scores of 0 and take what the curve gives there. Without usable labels the
    score is the same low value for all rows. Repeated rows score alike; an empty table gives no rows.
    """
    d = with_scores(docs.select("doc_id", "text"), fit(docs, labels, label))
    return d.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", "predicted")
