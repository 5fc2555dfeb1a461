"""Removal of repeated byte strings with a hash-compared suffix sort.

A byte goes where a string of ``WINDOW`` bytes that covers it also starts in a document with a smaller
doc_id. Equal windows contain equal anchors: a window's anchor is its ``GRAM``-byte string with the least
hash, so only strings around anchors that two documents share can repeat.

1. Copies of a whole text (same SHA-256) go but for the smallest doc_id. Each different text's anchors are sent
   to buckets by hash; those of several texts are candidates. Anchors that a task has seen in several texts
   are candidates at once, and one of them is sent.
2. Candidates go back to their texts. Around each, the windows that it is the anchor of form a context.
   Of equal contexts in a task only the first goes on; the others are repeats.
3. Contexts meet by anchor. Of equal ones the smallest document stays. The windows of the remaining ones are
   suffixes to sort: two are compared by a binary search for their common extension over prefix polynomial
   hashes, in a bottom-up mergesort of all groups at once. Equal neighbours are verified byte by byte.
4. Repeats go back to their texts.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.llm.batches import bound_batches
from undula.llm.rows import held, released, with_fields
from undula.operators.sequence import global_number
from undula.session import ship_package, stage

NEW = ("kept", "n_bytes", "n_removed", "n_spans")
WINDOW, GRAM, HEAD = 50, 16, 8
SPAN = WINDOW - GRAM + 1  # anchors that compete in a window
PIECE = 1 << 19  # bytes of a text that are hashed at once
FLUSH = 500_000  # anchors that a task gathers before it sends them
BUCKET_BYTES = 6_000_000  # bytes of text whose anchors share a bucket, about
PARTITIONS = 20_000  # most tasks of the bucket step; beyond, a task streams through several buckets
ROW_ANCHORS = 16_384  # anchors in one row between tasks
HOT_DOCS = 50_000  # anchors in more documents are resolved window by window
SEEN = 150_000  # contexts that a task remembers
CHUNK = 25_000  # contexts that are resolved at once

_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_LOW = np.uint64(PIECE * 2 - 1)  # bits of a packed hash that hold a position


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW, _IPOW = _powers(_P, PIECE + 2 * WINDOW), _powers(_INV, PIECE + 2 * WINDOW)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    r, have, n = a, 1, len(a) - w + 1
    while have * 2 <= w:
        r = np.minimum(r[:-have], r[have:])
        have *= 2
    return np.minimum(r[:n], r[w - have : w - have + n]) if have < w else r


def anchors(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, position, first window, last window) of the anchors of a text, piece by piece.

    Every window belongs to one anchor, chosen by content alone: the least hash, the leftmost of equal ones.
    """
    for at in range(0, len(data) - WINDOW + 1, PIECE):
        b = data[at : at + PIECE + WINDOW - 1]
        n = len(b)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POW[:n], out=prefix[1:])
        g = _mixed((prefix[GRAM:] - prefix[:-GRAM]) * _IPOW[: n - GRAM + 1])
        own = _sliding_min((g & ~_LOW) | np.arange(len(g), dtype=np.uint64), SPAN) & _LOW
        new = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
        pos = own[new].astype(np.int64)
        last = np.append(new[1:], len(own)) - 1
        yield g[pos].view(np.int64), pos + at, new + at, last + at


# 1. candidates


def _blobs(buckets: int):
    """Anchors of a task's texts as (bucket, hashes, texts) rows: one row per bucket and flush, and rows with
    bucket -1 for anchors already known as candidates. A text is named by its hash, so copies are one text."""

    def flush(h: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        keep = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
        h, doc = h[keep], doc[keep]
        same = np.concatenate(([False], h[1:] == h[:-1]))
        both = same | np.append(same[1:], False)
        rows = [(-1, h[both][i : i + ROW_ANCHORS], doc[both][i : i + ROW_ANCHORS]) for i in range(0, int(both.sum()), ROW_ANCHORS)]
        h, doc = h[~same], doc[~same]
        bucket = ((h.view(np.uint64) >> np.uint64(33)).astype(np.int64) * buckets) >> 31
        order = np.lexsort((h, bucket))
        h, doc, bucket = h[order], doc[order], bucket[order]
        edge = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(h)]))
        rows += [(int(bucket[a]), h[i : min(b, i + ROW_ANCHORS)], doc[i : min(b, i + ROW_ANCHORS)]) for a, b in zip(edge, edge[1:], strict=False) for i in range(a, b, ROW_ANCHORS)]
        return pa.record_batch(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())],
            names=["bucket", "hashes", "rows"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ds, n = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                for h, *_ in anchors(np.frombuffer(text.as_py() or b"", np.uint8)):
                    hs.append(h)
                    ds.append(np.full(len(h), doc, np.int64))
                    n += len(h)
                    if n >= FLUSH:
                        yield flush(np.concatenate(hs), np.concatenate(ds))
                        hs, ds, n = [], [], 0
        if n:
            yield flush(np.concatenate(hs), np.concatenate(ds))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket, gathered, give (row, h) of the anchors that several texts have."""

    def of(h: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(doc), pa.array(h)], names=["row", "h"])

    def several(hs: list[np.ndarray], ds: list[np.ndarray]) -> pa.RecordBatch:
        h, doc = np.concatenate(hs), np.concatenate(ds)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        keep = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
        h, doc = h[keep], doc[keep]
        same = np.concatenate(([False], h[1:] == h[:-1]))
        both = same | np.append(same[1:], False)
        return of(h[both], doc[both])

    now, hs, ds = None, [], []
    for b in batches:
        for i, bucket in enumerate(b.column("bucket").to_pylist()):
            h, doc = (np.frombuffer(b.column(c)[i].as_py(), np.int64) for c in ("hashes", "rows"))
            if bucket < 0:
                yield of(h, doc)
                continue
            if bucket != now and hs:
                yield several(hs, ds)
                hs, ds = [], []
            now = bucket
            hs.append(h)
            ds.append(doc)
    if hs:
        yield several(hs, ds)


# 2. contexts

_ROWS = "h bigint, doc_id bigint, row bigint, d int, first bigint, context binary"


def _record(h, doc, row, d, first, context) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(d, pa.int32()), pa.array(first, pa.int64()), pa.array(context, pa.binary())],
        names=["h", "doc_id", "row", "d", "first", "context"],
    )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of candidates, documents ascending. A row with a null context is a repeat already known:
    ``d`` bytes from ``first`` on."""
    seen: dict[bytes, int] = {}
    for b in batches:
        out = ([], [], [], [], [], [])

        def put(*row, out=out):
            for c, v in zip(out, row, strict=True):
                c.append(v)

        for doc, row, text, hs, hot in zip(*(b.column(i).to_pylist() for i in range(2)), b.column(2).cast(pa.binary()), b.column(3), b.column(4).to_pylist(), strict=True):
            text = text.as_py() or b""
            mine = np.unique(hs.values.to_numpy())
            hot = set(hot)
            known: list[tuple[int, int]] = []
            for h, pos, first, last in anchors(np.frombuffer(text, np.uint8)):
                at = np.minimum(np.searchsorted(mine, h), len(mine) - 1)
                pick = np.flatnonzero(mine[at] == h)
                for x, p, lo, hi in zip(h[pick].tolist(), pos[pick].tolist(), first[pick].tolist(), last[pick].tolist(), strict=True):
                    one = [(x, p, lo, hi)]
                    if x in hot:  # window by window, keyed by the window itself
                        one = [(int.from_bytes(hashlib.blake2b(text[s : s + WINDOW], digest_size=8).digest(), "little", signed=True), s, s, s) for s in range(lo, hi + 1)]
                    for x2, p2, lo2, hi2 in one:
                        c = text[lo2 : hi2 + WINDOW]
                        key = c + bytes([p2 - lo2])
                        before = seen.setdefault(key, doc)
                        if before < doc:
                            if known and lo2 <= known[-1][1]:
                                known[-1] = (known[-1][0], max(known[-1][1], hi2 + WINDOW))
                            else:
                                known.append((lo2, hi2 + WINDOW))
                        else:
                            put(x2, doc, row, p2 - lo2, lo2, c)
            for lo, hi in known:
                put(row, doc, row, hi - lo, lo, None)
            if len(seen) > SEEN:
                seen.clear()
            if len(out[0]) > 20_000:
                yield _record(*out)
                for c in out:
                    c.clear()
        yield _record(*out)


# 3. hash-compared suffix sort


class Suffixes:
    """Windows of contexts laid end to end, compared through prefix polynomial hashes."""

    def __init__(self, data: np.ndarray, offset: np.ndarray):
        self.data = data
        size = np.diff(offset)
        self.place = np.arange(len(data)) - np.repeat(offset[:-1], size)  # within the context
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POW[self.place], out=self.prefix[1:])
        self.shift = _IPOW[self.place]
        wide = np.concatenate((data, np.zeros(HEAD, np.uint8)))
        self.head = np.zeros(len(data), np.uint64)  # the first HEAD bytes from each place on, as a number in byte order
        for k in range(HEAD):
            self.head |= wide[k : k + len(data)].astype(np.uint64) << np.uint64(8 * (HEAD - 1 - k))

    def hash(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return (self.prefix[at + n] - self.prefix[at]) * self.shift[at]

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Is the window at ``a`` smaller than that at ``b``? Their heads tell if they differ; else equal windows show
        in one probe, and a binary search over the hashes finds the common extension of the others."""
        x, y = self.head[a], self.head[b]
        out = x < y
        i = np.flatnonzero((x == y) & (self.hash(a, WINDOW) != self.hash(b, WINDOW)))
        a, b = a[i], b[i]
        lo, hi = np.full(len(a), HEAD, np.int64), np.full(len(a), WINDOW - 1, np.int64)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.hash(a, mid) == self.hash(b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        out[i] = self.data[a + lo] < self.data[b + lo]
        return out

    def sort(self, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Order of the windows ``at`` within their groups, which begin at ``start``: a mergesort of all groups
        at once, where each window finds its rank in the run beside its own by binary search."""
        size = np.diff(np.append(start, len(at)))
        order, begin, total = np.arange(len(at)), np.repeat(start, size), np.repeat(size, size)
        run = 1
        while run < (size.max() if len(size) else 0):
            live = np.flatnonzero(total > run)
            i = live - begin[live]
            own = i // run
            other = (own ^ 1) * run
            n = np.clip(total[live] - other, 0, run)
            mine, base = at[order[live]], begin[live] + other
            right = (own & 1).astype(bool)  # equal windows of the left run stay before those of the right
            lo, hi = np.zeros(len(live), np.int64), n.copy()
            while (todo := np.flatnonzero(lo < hi)).size:
                mid = (lo[todo] + hi[todo]) >> 1
                him = at[order[base[todo] + mid]]
                r = right[todo]
                small = self.less(np.where(r, mine[todo], him), np.where(r, him, mine[todo]))
                up = np.where(r, ~small, small)  # right run: the other is not larger; left run: the other is smaller
                lo[todo], hi[todo] = np.where(up, mid + 1, lo[todo]), np.where(up, hi[todo], mid)
            to = begin[live] + (own & ~1) * run + (i - own * run) + lo
            moved = order.copy()
            moved[to] = order[live]
            order = moved
            run *= 2
        return order

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal windows: by hash first, then verified byte by byte."""
        out = self.hash(a, WINDOW) == self.hash(b, WINDOW)
        for i in range(0, len(a), 1 << 16):
            k = i + np.flatnonzero(out[i : i + (1 << 16)])
            step = np.arange(WINDOW)
            out[k] = (self.data[a[k][:, None] + step] == self.data[b[k][:, None] + step]).all(axis=1)
        return out


def _ramp(size: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def first_equal(s: Suffixes, offset: np.ndarray, h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each context the first one with the same anchor, place and bytes: by hash, then verified byte by byte."""
    size = np.diff(offset)
    whole = s.prefix[offset[1:]] - s.prefix[offset[:-1]]
    key = _mixed(_mixed(whole ^ h.view(np.uint64)) + (d.astype(np.uint64) << np.uint64(32)) + size.astype(np.uint64))
    order = np.argsort(key)
    start = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    rep = np.empty(len(h), np.int64)
    rep[order] = np.repeat(np.minimum.reduceat(order, start), np.diff(np.append(start, len(h))))
    same = (h == h[rep]) & (d == d[rep]) & (size == size[rep])
    i = np.flatnonzero(same & (rep != np.arange(len(h))))
    if len(i):
        step = _ramp(size[i])
        equal = s.data[np.repeat(offset[i], size[i]) + step] == s.data[np.repeat(offset[rep[i]], size[i]) + step]
        same[i] = np.logical_and.reduceat(equal, np.cumsum(size[i]) - size[i])
    return np.where(same, rep, np.arange(len(h)))


def repeated_windows(s: Suffixes, begin: np.ndarray, size: np.ndarray, h: np.ndarray, doc: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of all windows that a context of a smaller document has too, contexts distinct."""
    many = size - WINDOW + 1
    owner, t = np.repeat(np.arange(len(h)), many), _ramp(many)
    at, place = begin[owner] + t, d[owner] - t
    # equal windows have the same anchor at the same place and the same head; windows alone with theirs are no repeats
    group = _mixed(_mixed(s.head[at] ^ h[owner].view(np.uint64)) + place.astype(np.uint64))
    order = np.argsort(group)
    owner, t, at, group = owner[order], t[order], at[order], group[order]
    new = np.concatenate(([True], group[1:] != group[:-1]))
    size = np.diff(np.append(np.flatnonzero(new), len(at)))
    keep = np.repeat(size > 1, size)
    owner, t, at, new = owner[keep], t[keep], at[keep], new[keep]
    if not len(at):
        return owner, t
    order = s.sort(at, np.flatnonzero(new))
    owner, t, at = owner[order], t[order], at[order]  # groups stay where they were
    joined = np.concatenate(([False], ~new[1:]))
    joined[1:] &= s.equal(at[:-1], at[1:])
    first = np.flatnonzero(~joined)
    least = np.repeat(np.minimum.reduceat(doc[owner], first), np.diff(np.append(first, len(at))))
    hit = least < doc[owner]
    return owner[hit], t[hit]


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, doc_id) give (doc_id, row, start, stop) of repeats. What an open group carries over
    to the next chunk is one row for each of its distinct contexts."""
    rest: pa.Table | None = None
    carried = 0

    def spans(doc, row, start, stop) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.asarray(x), pa.int64()) for x in (doc, row, start, stop)], names=["doc_id", "row", "start", "stop"])

    def work(t: pa.Table, old: int) -> tuple[pa.RecordBatch, np.ndarray]:
        """Repeats among the rows after ``old``, and the rows that stand for a distinct context."""
        h, doc, row, d, first = (t.column(i).to_numpy() for i in range(5))
        c = t.column(5).combine_chunks().cast(pa.large_binary())
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        offset = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        data = np.frombuffer(c.buffers()[2], np.uint8)[offset[0] : offset[-1]]
        offset = offset - offset[0]
        size = np.diff(offset)
        s = Suffixes(data, offset)
        rep = first_equal(s, offset, h, d)  # it has the smallest document
        reps = np.unique(rep)
        whole = np.flatnonzero(doc > doc[rep])
        out = [(doc[whole], row[whole], first[whole], first[whole] + size[whole])]
        _, many = np.unique(h[reps], return_inverse=True)
        pick = reps[np.bincount(many)[many] > 1]
        if len(pick):
            owner, win = repeated_windows(s, offset[pick], size[pick], h[pick], doc[pick], d[pick])
            order = np.lexsort((win, owner))
            owner, win = pick[owner[order]], win[order]
            if len(owner):
                new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (win[1:] > win[:-1] + WINDOW)))
                lo, hi = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(owner)) - 1
                o, a, b = owner[lo], win[lo], win[hi] + WINDOW
                # a document's own repeats of a context share the verdict of its first
                twins = np.flatnonzero((doc == doc[rep]) & (rep != np.arange(len(h))))
                by = np.argsort(o, kind="stable")
                left, right = np.searchsorted(o[by], rep[twins], "left"), np.searchsorted(o[by], rep[twins], "right")
                many = right - left
                k, i = by[np.repeat(left, many) + _ramp(many)], np.repeat(twins, many)
                out.append((doc[i], row[i], first[i] + a[k], first[i] + b[k]))
                fresh = o >= old
                out.append((doc[o[fresh]], row[o[fresh]], (first[o] + a)[fresh], (first[o] + b)[fresh]))
        return spans(*(np.concatenate(x) for x in zip(*out, strict=True))), reps

    def chunk(t: pa.Table, old: int, final: bool):
        h = t.column(0).to_numpy()
        done, reps = work(t, old)
        keep = reps[h[reps] == h[-1]] if not final else reps[:0]
        return done, t.take(pa.array(keep))

    for b in batches:
        t = pa.Table.from_batches([b])
        plain = t.filter(pc.is_null(t.column("context")))
        if plain.num_rows:
            doc, row, n, first = (plain.column(i).to_numpy() for i in (1, 2, 3, 4))
            yield spans(doc, row, first, first + n)
        t = t.filter(pc.is_valid(t.column("context")))
        rest = t if rest is None else pa.concat_tables([rest, t])
        if rest.num_rows - carried >= CHUNK:
            done, rest = chunk(rest, carried, False)
            carried = rest.num_rows
            yield done
    if rest is not None and rest.num_rows > carried:
        yield chunk(rest, carried, True)[0]


# 4. removal


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _free(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class SharedName(Exception):
    """Two different texts have the same ``row``."""


def repeats(docs: DataFrame, hot_docs: int = HOT_DOCS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, row, spans) of the documents (doc_id, row, text) that have repeats; spans may overlap.

    ``row`` names the text: the same for copies, another for other texts, which SHA-256 checks.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WINDOW))
    ids = stage(d.select("doc_id", "row", F.octet_length("text").cast("bigint").alias("n"), F.sha2("text", 256).alias("sha")), "texts")
    first = stage(ids.groupBy("sha").agg(F.min("doc_id").alias("first"), F.first("row").alias("row"), F.first("n").alias("n")), "first")
    if not first.groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise SharedName
    copies = ids.join(first.select("sha", "first"), "sha").filter("doc_id > first")
    copies = copies.select("doc_id", "row", F.lit(0).cast("bigint").alias("start"), F.col("n").alias("stop"))
    size = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(parts, -(-size // bucket_bytes))
    blobs = d.select("row", "text").mapInArrow(_blobs(buckets), "bucket bigint, hashes binary, rows binary")
    key = F.when(F.col("bucket") < 0, F.xxhash64("hashes")).otherwise(F.col("bucket"))
    blobs = blobs.withColumn("key", key).repartition(min(buckets, max(parts, PARTITIONS)), "key").sortWithinPartitions("bucket").drop("key")
    found = stage(blobs.mapInArrow(_shared, "row bigint, h bigint"), "anchors")
    del blobs
    _free(spark)
    # anchors in very many texts, by one count for all, so that everywhere the same is done with them
    hot = stage(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_docs).select("h", F.lit(True).alias("hot")), "hot")
    found = found.withColumn("hot", F.lit(False)) if hot.isEmpty() else found.join(hot, "h", "left")
    hs = found.groupBy("row").agg(F.collect_list("h").alias("hs"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot"))
    hs = hs.join(first.select("row", F.col("first").alias("doc_id")), "row")
    c = d.join(hs.hint("merge"), ["doc_id", "row"]).select("doc_id", "row", "text", "hs", "hot").mapInArrow(_contexts, _ROWS)
    c = c.repartition(parts, "h").sortWithinPartitions("h", "doc_id")
    out = stage(c.mapInArrow(_resolve, "doc_id bigint, row bigint, start bigint, stop bigint"), "repeats")
    del c
    _free(spark)
    return out.unionByName(copies).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _cut(as_text: bool):
    return lambda batches: (t for b in batches for t in _cut_batch(b, as_text))


def _cut_batch(b: pa.RecordBatch, as_text: bool) -> Iterator[pa.RecordBatch]:
    if b.num_rows:
        kept, n, removed, runs = [], [], [], []
        for text, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
            text = text or b""
            gone = merged([(s["start"], s["stop"]) for s in spans or []])
            edges = [0, *(x for s in gone for x in s), len(text)]
            kept.append(b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)) if gone else text)
            n.append(len(text))
            removed.append(sum(z - a for a, z in gone))
            runs.append(len(gone))
        if as_text:
            kept = [x.decode("utf-8", "ignore") for x in kept]
        columns = [b.column("rest"), pa.array(kept, pa.string() if as_text else pa.binary()), *(pa.array(x, pa.int64()) for x in (n, removed, runs))]
        yield pa.RecordBatch.from_arrays(columns, names=["rest", *NEW])


def _named(docs: DataFrame, text: str) -> DataFrame:
    """(number, text, rest): ids as numbers in their order."""
    d = held(docs, [*NEW, text], id="doc_id", text=text)
    if isinstance(d.schema["id"].dataType, T.IntegralType):
        return d.withColumn("number", F.col("id").cast("bigint"))
    order = global_number(d.filter("id IS NOT NULL").select("id").distinct(), ["id"], "number")
    return d.join(order, "id", "left")


def without_repeats(docs: DataFrame, text: str = "text", as_text: bool = False, **settings: int) -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes), n_bytes, n_removed and n_spans in place of ``text``.

    With ``as_text``, ``kept`` is a string without what is left of characters that were cut through.

    Null and empty texts keep zero bytes; texts under ``WINDOW`` bytes are kept. Repeated rows and rows that share a
    doc_id never remove each other's bytes; a row with a null doc_id is kept whole and removes nothing. Ids may be
    of any type that has an order. An empty table gives no rows. Columns named like the new ones are replaced.
    """
    named = _named(docs, text)
    for seed in count():  # texts go by a 64-bit hash; if two different ones share one, by the next
        d = named.withColumn("row", F.xxhash64("text", F.lit(seed)))
        try:
            spans = repeats(d.select(F.col("number").alias("doc_id"), "row", "text"), **settings)
            break
        except SharedName:
            continue
    d = d.join(spans.select(F.col("doc_id").alias("number"), "row", "spans"), ["number", "row"], "left").select("rest", "text", "spans")
    new = [T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *[T.StructField(c, T.LongType()) for c in NEW[1:]]]
    return released(d.mapInArrow(_cut(as_text), with_fields(d, ["text", "spans"], new)), *NEW)
