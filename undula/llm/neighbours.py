"""Near-duplicate vectors by cosine, over binary codes of randomised rotations (see ``rotated``).

Only distinct vectors take part; copies count by their number. Rows that share a key of a hash table meet in a
bucket. In a first pass a bucket holds codes alone: the bounds of the estimates throw out the pairs that are
certainly no links, and only rows with a pair left go on. In a second pass these rows bring their vectors,
and the pairs left are computed exactly, each in the first table whose keys agree. A bucket gives the number of
links of each row and a spanning forest of the links, never the pairs. A bucket of more than ``block`` rows
is cut, and every two of its parts meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.llm import rotated
from undula.llm.components import components
from undula.session import ship_package, stage

LEAST = 0.95
RECALL = 0.9999  # probability that a pair of exactly LEAST shares a bucket; closer pairs share one more often
MEAN = 64  # rows a key, on average
BLOCK = 2048
_SMALL, _PAIRS = 128, 1 << 17
_CELL = ["dim", "key", "cell"]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _records(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(c):
        return np.zeros(0, rotated.layout(dim))
    begin = np.frombuffer(c.buffers()[1], np.int32)[c.offset]
    return np.frombuffer(c.buffers()[2], rotated.layout(dim), len(c), int(begin))


def _binary(records: np.ndarray) -> pa.Array:
    offsets = np.arange(len(records) + 1, dtype=np.int32) * records.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(records), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(records))])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims = b.column(1).to_numpy()
        for dim in np.unique(dims).tolist():
            at = pa.array(np.flatnonzero(dims == dim))
            code = _binary(rotated.encoded(_matrix(b.column(2).take(at), dim)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), code], names=["vid", "dim", "code"])


def _keyed(bits: int, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, vid = b.column(1).to_numpy(), b.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                k = rotated.keys(_records(b.column(2).take(pa.array(at)), dim), dim, bits, number)
                k |= np.arange(number, dtype=np.int64) << 48
                n = k.size
                yield pa.record_batch([pa.array(np.full(n, dim, np.int32)), pa.array(k.ravel()), pa.array(np.repeat(vid[at], number))], names=["dim", "key", "vid"])

    return run


def _pairs(begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j), i < j, within groups of neighbouring rows, a bounded number at a time."""
    n = int(size.sum())
    group, small = np.repeat(np.arange(len(size)), size), np.repeat(size <= _SMALL, size)
    for lag in range(1, min(_SMALL, n)):
        i = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
        if not len(i):
            break
        for part in range(0, len(i), _PAIRS):
            yield i[part : part + _PAIRS], i[part : part + _PAIRS] + lag
    for g in np.flatnonzero(size > _SMALL):
        rows, first = int(size[g]), int(begin[g])
        step = max(1, _PAIRS // rows)
        for r in range(0, rows - 1, step):
            i, j = np.divmod(np.arange(r * rows, min(r + step, rows) * rows), rows)
            keep = j > i
            yield i[keep] + first, j[keep] + first


def _hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the groups of each (i, j) in ``root`` and returns the links that it took."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        x, y = root[i], root[j]
        apart = x != y
        if not apart.any():
            return np.concatenate(a), np.concatenate(b)
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        high, low = np.maximum(x, y), np.minimum(x, y)
        high, one = np.unique(high, return_index=True)  # each root under one smaller root
        a.append(i[one])
        b.append(j[one])
        root[high] = low[one]
        while (root[root] != root).any():
            root[:] = root[root]


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows come sorted by cell; tables of whole cells."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        c = np.stack([t.column(k).to_numpy().astype(np.int64) for k in _CELL])
        last = np.flatnonzero((c != c[:, -1:]).any(0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _meet(least: float, bits: int, number: int, exact: bool):
    """Pass 1 gives the rows that still have a pair; pass 2 (``exact``) rows (a, b, n): a has n links here if b
    is null, else a and b are linked."""

    def cells(t: pa.Table, dim: int) -> Iterator[pa.RecordBatch]:
        c = np.stack([t.column(k).to_numpy() for k in _CELL[1:]])
        begin = np.flatnonzero(np.concatenate(([True], (c[:, 1:] != c[:, :-1]).any(0))))
        size = np.diff(np.append(begin, t.num_rows))
        group, side = np.repeat(np.arange(len(size)), size), t.column("side").to_numpy()
        crossed = np.maximum.reduceat(side, begin)[group] > 0
        table, records, words = c[0] >> 48, _records(t.column("code"), dim), rotated.mask_words(dim, bits, number)
        vid, left = t.column("vid").to_numpy(), np.zeros(t.num_rows, bool)
        if exact:
            x = rotated.unit(_matrix(t.column("v"), dim))
            copies, links, root = t.column("copies").to_numpy(), np.zeros(t.num_rows, np.int64), np.arange(t.num_rows)
        for i, j in _pairs(begin, size):
            ok = ~crossed[i] | (side[i] != side[j])
            i, j = i[ok], j[ok]
            ok = rotated.may_link(records[i], records[j], dim, least)
            i, j = i[ok], j[ok]
            ok = ~rotated.earlier(records[i], records[j], table[i], words)
            i, j = i[ok], j[ok]
            if not exact:
                left[i] = left[j] = True
                continue
            ok = np.einsum("ij,ij->i", x[i], x[j]) >= least
            i, j = i[ok], j[ok]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            a, b = _hook(root, i, j)
            if len(a):
                yield pa.record_batch([pa.array(vid[a]), pa.array(vid[b]), pa.nulls(len(a), pa.int64())], names=["a", "b", "n"])
        if exact:
            at = np.flatnonzero(links)
            yield pa.record_batch([pa.array(vid[at]), pa.nulls(len(at), pa.int64()), pa.array(links[at])], names=["a", "b", "n"])
        else:
            yield from t.select([*_CELL, "side", "vid"]).filter(pa.array(left)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches):
            dims = t.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                yield from cells(t.slice(int(at[0]), len(at)), dim)

    return run


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_CELL).sortWithinPartitions(*_CELL, "side", "vid")


def links(distinct: DataFrame, least: float = LEAST, recall: float = RECALL, block: int = BLOCK, mean: int = MEAN) -> DataFrame:
    """(a, b, n) over ``distinct`` (vid, v, copies), whose vectors differ, are finite and not zero.

    Rows with a null ``b`` say that a has n links to rows of other vectors (several such rows add up); the others
    are links that connect all that link.
    """
    spark = distinct.sparkSession
    ship_package(spark)
    d = distinct.select("vid", F.size("v").alias("dim"), "v")
    codes = stage(d.mapInArrow(_encode, "vid bigint, dim int, code binary"), "codes")
    bits, number = rotated.tables(codes.count(), least, recall, mean)
    keyed = stage(codes.mapInArrow(_keyed(bits, number), "dim int, key bigint, vid bigint"), "keys")
    # a bucket of one has no links
    parts = keyed.groupBy("dim", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("dim", "key", F.expr(f"(n + {block - 1}) div {block}").alias("parts"))
    k = keyed.join(parts, ["dim", "key"]).withColumn("part", F.pmod(F.xxhash64("vid"), "parts"))
    at = F.expr("transform(sequence(0L, parts - 1), j -> named_struct('cell', least(part, j) * parts + greatest(part, j), 'side', CAST(part > j AS INT)))")
    k = k.select("dim", "key", F.explode(at).alias("c"), "vid").select("dim", "key", "c.cell", "c.side", "vid")
    k = k.join(codes.select("vid", "code"), "vid").select(*_CELL, "side", "vid", "code")
    left = _ordered(k).mapInArrow(_meet(least, bits, number, False), "dim int, key bigint, cell bigint, side int, vid bigint")
    left = stage(left, "left").join(codes.select("vid", "code"), "vid").join(distinct.select("vid", "v", "copies"), "vid")
    left = left.select(*_CELL, "side", "vid", "code", "v", "copies")
    return _ordered(left).mapInArrow(_meet(least, bits, number, True), "a bigint, b bigint, n bigint")


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = LEAST, recall: float = RECALL, block: int = BLOCK, mean: int = MEAN) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df``.

    Rows link at a cosine of ``least`` or above, computed in double precision, if their vectors have the same
    length; ``n_links`` counts the rows linked directly, copies and rows of the same id included. ``component_id`` is
    the smallest vec_id reachable by links, the row's own included; a null id is never the smallest unless its
    component has no other. ``kept`` says that the row's id is its component's. Vectors that are null, empty or zero or
    hold null or non-finite components link with nothing. Other columns are not read; an empty table gives no rows.
    """
    kind = df.schema[vector].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    v = F.col(vector) if plain else F.col(vector).cast("array<double>")
    rows = df.select(F.col(vec_id).alias("vec_id"), v.alias("v"))
    sound = F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.col("v")))
    distinct = rows.filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    distinct = stage(distinct.withColumn("vid", F.monotonically_increasing_id()), "vectors")
    found = stage(links(distinct, least, recall, block, mean), "links")
    number = found.filter("b IS NULL").groupBy(F.col("a").alias("vid")).agg(F.sum("n").alias("n"))
    classes = components(found.filter("b IS NOT NULL")).select(F.col("node").alias("vid"), "root")
    named = distinct.select("vid", "v", "copies", "least").join(number, "vid", "left").join(classes, "vid", "left")
    named = stage(named.select("v", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "vid").alias("root"), "least"), "named")
    top = named.groupBy("root").agg(F.min("least").alias("component_id"))
    out = rows.join(named.join(top, "root").drop("root", "least"), "v", "left")
    c = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), c.alias("component_id"), F.col("vec_id").eqNullSafe(c).alias("kept"))
