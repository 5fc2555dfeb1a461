"""SimHash near-duplicates, with pigeonring candidate filtering.

Fingerprints of 64 bits link at up to ``TAU`` differing bits. The bits form a ring of ``len(SEGMENTS)``
segments. If two fingerprints differ in at most TAU bits, then from some segment on, the differences summed
over 1, 2, 3, ... consecutive segments never exceed 1, 2, 3, ... times TAU / segments. Candidates are made
where such a chain starts: the first segment is equal and the second differs in one bit at most, so that one
of its halves is equal. A row per start and half is the key of a bucket; longer chains are tested before the
full Hamming distance. Only distinct fingerprints take part, and a bucket gives a spanning forest of
its links instead of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.batches import bound_batches
from undula.llm.components import components
from undula.session import ship_package, stage

SHINGLE, SEED, TAU = 4, 42, 4
SEGMENTS = (13, 13, 13, 13, 12)  # bits, from the lowest
HALF = 6  # bits of a segment's lower half
BLOCK = 65_536  # fingerprints of one bucket that meet in one task
_SPACE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def fingerprint(text: bytes) -> int:
    """A bit is 1 if set in over half of the XXH64 hashes of the word shingles; no words: 0."""
    words = text.translate(_SPACE).split(b" ")
    words = [w for w in words if w]
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    first = np.concatenate(([0], ends[: n - SHINGLE])).tolist()
    last = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, n - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        known: dict[bytes, int] = {}
        out = []
        for t in b.column(1).cast(pa.binary()):
            t = t.as_py() or b""
            if t not in known:
                known[t] = fingerprint(t)
            out.append(known[t])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_prints, f"doc_id {kind}, fp bigint")


_OFFSET = np.concatenate(([0], np.cumsum(SEGMENTS)))


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    i %= len(SEGMENTS)
    return (fp >> np.uint64(_OFFSET[i])) & np.uint64((1 << SEGMENTS[i]) - 1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ten bucket keys per fingerprint: (start, half, first segment, half of the second)."""
    m = len(SEGMENTS)
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        keys = []
        for i in range(m):
            first, second = _segment(fp, i), _segment(fp, i + 1)
            for half, part in ((0, second & np.uint64((1 << HALF) - 1)), (1, second >> np.uint64(HALF))):
                keys.append((first << np.uint64(8) | part) << np.uint64(4) | np.uint64(2 * i + half))
        key = np.concatenate(keys).view(np.int64)
        yield pa.record_batch([pa.array(key), pa.array(np.tile(fp, 2 * m).view(np.int64))], names=["key", "fp"])


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether a chain from ``start`` keeps its budgets; the last one is the full Hamming distance."""
    m, x = len(SEGMENTS), a ^ b
    diff = np.stack([np.bitwise_count(_segment(x, i)).astype(np.int64) for i in range(m)])
    keep, total, cols = np.ones(len(x), bool), np.zeros(len(x), np.int64), np.arange(len(x))
    for k in range(m):
        total += diff[(start + k) % m, cols]
        keep &= total * m <= (k + 1) * TAU
    return keep


def _forest(fp: np.ndarray, start: int, split: int | None) -> tuple[list[int], list[int]]:
    """Links of one bucket that keep its connections: each pass joins a pivot to all that it links to, and
    compares it only with fingerprints that are not yet joined to it. ``split``: compare across only."""
    n = len(fp)
    root = np.arange(n)
    a, b = [], []
    for i in range(n if split is None else split):
        other = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1 if split is None else np.flatnonzero(root[split:] != root[i]) + split
        if not len(other):
            continue
        hit = other[linked(np.full(len(other), fp[i]), fp[other], np.full(len(other), start))]
        if len(hit):
            _, one = np.unique(root[hit], return_index=True)
            a += [int(fp[i])] * len(one)
            b += [int(x) for x in fp[hit[one]]]
            root[np.isin(root, root[hit])] = root[i]
    return a, b


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, cell, side); small buckets of a batch are compared all at once."""
    rest = None

    def done(t: np.ndarray) -> pa.RecordBatch:
        key, cell, side, fp = t
        fp = fp.view(np.uint64)
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))
        size = np.diff(np.append(new, len(key)))
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        small = np.repeat(size <= 8, size)
        group = np.repeat(np.arange(len(new)), size)
        for lag in range(1, 8):
            if lag >= len(key):
                break
            i = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
            if not len(i):
                break
            start = (key[i] & 15) >> 1
            i = i[linked(fp[i], fp[i + lag], start)]
            a.append(fp[i])
            b.append(fp[i + lag])
        for g in np.flatnonzero(size > 8):
            s = slice(new[g], new[g] + size[g])
            across = int((side[s] == 0).sum()) if side[s].any() else None
            x, y = _forest(fp[s], int(key[new[g]] & 15) >> 1, across)
            a.append(np.array(x, np.uint64))
            b.append(np.array(y, np.uint64))
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        t = np.stack([batch.column(i).to_numpy() for i in range(4)]) if batch.num_rows else None
        if t is None:
            continue
        t = t if rest is None else np.concatenate([rest, t], axis=1)
        last = np.flatnonzero((t[0] != t[0, -1]) | (t[1] != t[1, -1]))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
        rest = t[:, cut:]
        if cut:
            yield done(t[:, :cut])
    if rest is not None and rest.shape[1]:
        yield done(rest)


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that link at TAU bits.

    A bucket with over ``block`` fingerprints is cut into parts, and every pair of parts meets in a task of
    its own, so that no task holds more than twice ``block`` and no link is lost.
    """
    keys = prints.select("fp").mapInArrow(_keys, "key bigint, fp bigint")
    keys = stage(keys, "buckets")
    # a bucket of one has no links; most are of one
    parts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.expr(f"(n + {block - 1}) div {block}").alias("parts"))
    k = keys.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
    cells = F.expr("transform(sequence(0L, parts - 1), j -> named_struct('cell', least(part, j) * parts + greatest(part, j), 'side', CAST(part > j AS BIGINT)))")
    k = k.select("key", "fp", F.explode(cells).alias("c")).select("key", "c.cell", "c.side", "fp")
    k = k.repartition("key", "cell").sortWithinPartitions("key", "cell", "side", "fp")
    return k.mapInArrow(_bucket_links, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, the row's own included. Null and empty
    texts have no words and the fingerprint zero, which links like any other. Repeated rows share everything;
    a null doc_id is never the smallest unless its component has no other; an empty table gives no rows.
    """
    prints = stage(fingerprints(docs, doc_id, text), "prints")
    least = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    classes = components(links(least))
    member = least.join(classes, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = stage(member, "members")
    top = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(top, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
