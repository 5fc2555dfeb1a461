"""Ranked lexical search: an inverted index of compressed blocks, searched by Block-Max MaxScore.

Documents stay in the task that reads them: it cuts them into shards of a bounded number of words and writes
each shard's posting lists in blocks of BLOCK postings (place in the shard and frequency as variable-length
bytes). A block carries its last place and its front: the (document length, frequency) pairs that no other pair of the
block beats in both, so that its highest impact is known exactly whatever the corpus's mean length turns
out to be, without decompressing it.

A shard is searched with all queries of a block of queries. The strongest lists give the first threshold. Lists
whose bounds together stay below it are not essential: candidates come from the essential lists only, and the
others are asked list by list, from the highest bound down. A candidate that the block's maximum cannot lift to the
threshold is rejected before the block is decompressed. The shards' heaps are merged at the end.

Impact of a term: (10^9 * tf) div (1000 * tf + 8 * m), m = 25 + (75 * length * N) div L, with N documents that hold a
term and L terms in all. A list's weight is floor(1000 * ln((2 N + 2) / (2 df + 1))), and never below 0.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.llm.batches import bound_batches
from undula.session import ship_package, stage

BLOCK = 128
SHARD_WORDS, SHARD_DOCS = 1 << 21, 1 << 16
QUERY_ITEMS = 1024  # items that are searched together
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_SPACE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the lowest first, and where each value begins (one more entry for the end)."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= np.uint64(1 << 7 * k)
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(at[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        i = np.flatnonzero(size > k)
        out[at[i] + k] = (values[i] >> np.uint64(7 * k) & np.uint64(127)) | (size[i] > k + 1).astype(np.uint64) << np.uint64(7)
    return out, at


def unpacked(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)
    begins = np.concatenate(([0], ends[:-1] + 1))
    shift = (np.arange(len(data)) - np.repeat(begins, ends - begins + 1)) * 7
    return np.add.reduceat((data & 127).astype(np.int64) << shift, begins)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    offsets = np.ascontiguousarray(offsets.astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _fronts(block: np.ndarray, size: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """The postings of each block that no other one of the block beats: as short or shorter, and as frequent or more."""
    order = np.lexsort((-tf, size, block))
    b, f = block[order], tf[order]
    best = np.maximum.accumulate(f + b * (int(f.max(initial=0)) + 1))
    keep = np.ones(len(order), bool)
    keep[1:] = best[1:] > best[:-1]
    return order[keep]


def _shard(number: int, ids: list, texts: list[np.ndarray], known: dict[bytes, int], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its documents by id, then the blocks of its lists."""
    whose = pa.array(ids, kind)
    order = pc.sort_indices(whose, null_placement="at_start").to_numpy()
    size = np.array([len(texts[i]) for i in order], np.int64)
    n = len(order)
    blank = lambda k, t: pa.nulls(k, t)
    cols = ["shard", "term", "block", "last", "postings", "front", "data", "place", "size", "doc_id"]
    rows = [pa.array(np.full(n, number)), blank(n, pa.binary()), *(blank(n, pa.int32()) for _ in range(3)), blank(n, pa.binary()), blank(n, pa.binary())]
    yield pa.RecordBatch.from_arrays([*rows, pa.array(np.arange(n, dtype=np.int32)), pa.array(size), whose.take(pa.array(order))], names=cols)
    if not known:
        return
    terms = np.concatenate([texts[i] for i in order])
    key = np.sort(terms * n + np.repeat(np.arange(n), size))
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    tf = np.diff(np.append(head, len(key)))
    term, place = np.divmod(key[head], n)
    lists = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    inside = np.arange(len(term)) - np.repeat(lists, np.diff(np.append(lists, len(term))))
    begin = np.flatnonzero(inside % BLOCK == 0)
    many = np.diff(np.append(begin, len(term)))
    step = place.copy()
    step[1:] -= np.where(inside[1:] % BLOCK == 0, 0, place[:-1])
    data, at = packed(np.stack((step, tf), axis=1).ravel())
    block = np.repeat(np.arange(len(begin)), many)
    shared = np.flatnonzero(many[block] > 1)  # a block of one posting is its own front
    front = np.sort(np.concatenate((np.flatnonzero(many[block] == 1), shared[_fronts(block[shared], size[place[shared]], tf[shared])])))
    pairs = np.stack((size[place[front]], tf[front]), axis=1)
    front_at = np.concatenate(([0], np.cumsum(np.bincount(block[front], minlength=len(begin))))) * 16
    n = len(begin)
    rows = pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, number)),
            pa.array(list(known), pa.binary()).take(pa.array(term[begin])),
            pa.array((inside[begin] // BLOCK).astype(np.int32)),
            pa.array(place[begin + many - 1].astype(np.int32)),
            pa.array(many.astype(np.int32)),
            _binary(pairs.view(np.uint8).ravel(), front_at),
            _binary(data, at[np.append(begin, len(term)) * 2]),
            blank(n, pa.int32()),
            blank(n, pa.int64()),
            blank(n, kind),
        ],
        names=cols,
    )
    for k in range(0, n, 1 << 16):
        yield rows.slice(k, 1 << 16)


def _indexed(shard_words: int, shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        known, ids, texts, words, kind = defaultdict(count().__next__), [], [], 0, None
        for b in batches:
            kind = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                w = (t.as_py() or b"").translate(_SPACE).split()
                ids.append(i)
                texts.append(np.fromiter(map(known.__getitem__, w), np.int64, len(w)))
                words += len(w)
                if words >= shard_words or len(ids) >= shard_docs:
                    yield from _shard(number, ids, texts, known, kind)
                    number, known, ids, texts, words = number + 1, defaultdict(count().__next__), [], [], 0
        if ids:
            yield from _shard(number, ids, texts, known, kind)

    return run


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of all terms of ``docs``, written to the shared folder; it can be kept and searched again.

    Rows with a null ``term`` are documents (shard, place, size, doc_id), in the order of their ids within a shard; the
    others are blocks (shard, term, block, last, postings, front, data). Null and empty texts are documents without terms.
    """
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"shard bigint, term binary, block int, last int, postings int, front binary, data binary, place int, size bigint, doc_id {kind}"
    return stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_indexed(shard_words, shard_docs), schema), "index")


def query_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, repeats); rows of one id are one query."""
    words = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(f"({TERM})"))
    d = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.explode(words).alias("term"))
    return d.groupBy("item_id", F.col("term").cast("binary").alias("term")).agg(F.count(F.lit(1)).alias("repeats"))


@dataclass
class _List:
    """One posting list of a shard: per block the last place, the highest impact, and the data."""

    last: np.ndarray
    top: np.ndarray
    data: list[bytes]
    decoded: dict[int, tuple[np.ndarray, np.ndarray]]

    def postings(self, blocks: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, impacts) of some blocks, in order; each is decompressed once."""
        for k in blocks.tolist():
            if k not in self.decoded:
                v = unpacked(np.frombuffer(self.data[k], np.uint8)).reshape(-1, 2)
                place = np.cumsum(v[:, 0])
                self.decoded[k] = place, impact(v[:, 1], penalty[place])
        found = [self.decoded[k] for k in blocks.tolist()]
        return found[0] if len(found) == 1 else (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def impact(tf: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + penalty)


def search(lists: list[tuple[int, _List]], penalty: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, score) of the k best of one query in one shard; of equal scores the smaller places.

    ``lists``: (weight times repeats, list) of the query's terms; ``penalty``: 8 m by place.
    """
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: -x[0] * int(x[1].top.max()))
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bound = np.array([w * int(t.top.max()) for w, t in lists], np.int64)
    behind = np.append(np.cumsum(bound[::-1])[::-1], 0)  # what lists i, i + 1, ... add at most
    score = np.zeros(len(penalty), np.int64)
    seen = np.zeros(len(penalty), bool)

    def kth(s: np.ndarray) -> int:
        return int(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else 1

    least, essential = 1, 0
    while essential < len(lists) and behind[essential] >= least:
        w, t = lists[essential]
        place, add = t.postings(np.arange(len(t.last)), penalty)
        score[place] += w * add
        seen[place] = True
        essential += 1
        least = max(least, kth(score[seen]))
    at = np.flatnonzero(seen)
    s = score[at]
    for i in range(essential, len(lists)):
        w, t = lists[i]
        keep = s + behind[i] >= least
        at, s = at[keep], s[keep]
        block = np.searchsorted(t.last, at)
        there = np.flatnonzero(block < len(t.last))
        # a document that this block's best posting and the lists behind cannot lift to the threshold is not looked up
        there = there[s[there] + w * t.top[block[there]] + behind[i + 1] >= least]
        if len(there):
            place, add = t.postings(np.unique(block[there]), penalty)
            j = np.minimum(np.searchsorted(place, at[there]), len(place) - 1)
            hit = place[j] == at[there]
            s[there[hit]] += w * add[j[hit]]
        # what was not looked up stays below the threshold whatever the lists behind add
        least = max(least, kth(s))
    keep = s >= least
    at, s = at[keep], s[keep]
    best = np.lexsort((at, -s))[:k]
    return at[best], s[best]


def _searched(k: int, docs: int, length: int, item: pa.DataType, doc: pa.DataType):
    names, kinds = ["item_id", "doc_id", "score"], [item, doc, pa.int64()]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.schema(list(zip(names, kinds, strict=True))).empty_table()
        rows = right.filter(pc.is_valid(right.column("place")))
        rows = rows.take(pc.sort_indices(rows.column("place")))
        penalty = 8 * (25 + 75 * rows.column("size").to_numpy() * docs // length)
        left = left.sort_by([("term", "ascending"), ("block", "ascending")])
        terms = left.column("term").to_pylist()
        front = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in left.column("front").to_pylist()]
        pairs = np.concatenate(front)
        value = impact(pairs[:, 1], 8 * (25 + 75 * pairs[:, 0] * docs // length))
        top = np.maximum.reduceat(value, np.cumsum([0, *map(len, front)])[:-1])
        last, data = left.column("last").to_numpy(), left.column("data").to_pylist()
        begin = [i for i in range(len(terms)) if not i or terms[i] != terms[i - 1]]
        known = {terms[a]: _List(last[a:b], top[a:b], data[a:b], {}) for a, b in zip(begin, [*begin[1:], len(terms)], strict=True)}
        uses = right.filter(pc.is_valid(right.column("item_id")))
        queries = defaultdict(list)
        for i, t, w in zip(uses.column("item_id").to_pylist(), uses.column("term").to_pylist(), uses.column("weight").to_pylist(), strict=True):
            queries[i].append((w, known[t]))
        ids, places, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, lists in queries.items():
            place, score = search(lists, penalty, k)
            ids += [i] * len(place)
            places.append(place)
            scores.append(score)
        whose = rows.column("doc_id").take(pa.array(np.concatenate(places)))
        return pa.table([pa.array(ids, item), whose, pa.array(np.concatenate(scores))], schema=pa.schema(list(zip(names, kinds, strict=True))))

    return run


def ranked(indexed: DataFrame, terms: DataFrame, k: int = 10, items: int = QUERY_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item of ``terms`` (see ``query_terms``) the k best documents of ``indexed``.

    Only scores above 0 count; ties go to the smaller doc_id, a null id first. Items without a term that
    any document holds have no rows, and neither has an empty index. Documents that share an id are documents of their own.
    """
    spark = indexed.sparkSession
    documents, blocks = indexed.filter("term IS NULL"), indexed.filter("term IS NOT NULL")
    docs, length = documents.filter("size > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    terms = stage(terms, "terms")
    groups = max(1, -(-terms.select("item_id").distinct().count() // items))
    part = F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("part")
    # postings of the queries' terms only; the frequency of a term in the corpus is the sum over its blocks
    lists = blocks.join(terms.select("term", part).distinct(), "term")
    held = blocks.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("postings").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * docs + 2) / (2 * F.col("df") + 1))) * F.col("repeats")
    q = terms.join(held, "term").select("term", "item_id", part, weight.cast("bigint").alias("weight"))
    uses = lists.filter("block = 0").select("shard", "part", "term").join(q, ["term", "part"])
    every = documents.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    empty = lambda c, d: F.lit(None).cast(d.schema[c].dataType).alias(c)
    right = every.select("shard", "part", "place", "size", "doc_id", empty("term", q), empty("item_id", q), empty("weight", q)).unionByName(
        uses.select("shard", "part", empty("place", documents), empty("size", documents), empty("doc_id", documents), "term", "item_id", "weight")
    )
    left = lists.select(F.col("shard").alias("left_shard"), F.col("part").alias("left_part"), "term", "block", "last", "front", "data")
    kinds = [terms.schema["item_id"].dataType, documents.schema["doc_id"].dataType]
    from pyspark.sql.pandas.types import to_arrow_type

    run = _searched(k, int(docs), max(1, int(length)), *map(to_arrow_type, kinds))
    schema = f"item_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score bigint"
    ship_package(spark)
    found = left.groupBy("left_shard", "left_part").cogroup(right.groupBy("shard", "part")).applyInArrow(run, schema)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
