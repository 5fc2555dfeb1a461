"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised bytewise: A-Z lower-cased, every run of separators one blank. Windows of ``width``
consecutive item words become patterns between blanks, so a match is always a run of whole words. The
automaton reads each document once; word offsets lead back to byte offsets of the original text.

Patterns are kept in slices of at most ``SLICE_BYTES``. One slice is one automaton; a benchmark beyond it
is scanned slice by slice, and the hits are united, so what a task holds never grows with the benchmark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undula.llm.batches import bound_batches
from undula.llm.rows import held, released, with_fields
from undula.session import ship_package, stage

WIDTH = 10
SLICE_BYTES = 32_000_000
#: Word bytes are 0-9, A-Z (lower-cased), a-z and everything from 0x80; all others separate.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_built: dict[str, tuple] = {}


def windows(data: bytes, width: int = WIDTH) -> list[bytes]:
    """The normalised windows of an item; an item shorter than ``width``, but not empty, is one."""
    w = data.translate(TABLE).split()
    return [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


def item_patterns(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(item_id as string, pattern), each once."""
    p = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, pats = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                new = dict.fromkeys(windows(t or b"", width))
                ids += [i] * len(new)
                pats += new
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(pats, pa.binary())], names=["item_id", "pattern"])

    return p.mapInArrow(cut, "item_id string, pattern binary").distinct()


def _automaton(key: str, patterns: list[tuple[bytes, str]]):
    """One automaton per worker and slice."""
    if key not in _built:
        by: dict[bytes, set[str]] = {}
        for p, i in patterns:
            by.setdefault(p, set()).add(i)
        a = ahocorasick.Automaton()
        for p, owners in by.items():
            a.add_word(f" {p.decode('latin-1')} ", (p.count(b" ") + 1, tuple(owners)))
        a.make_automaton()
        _built.clear()
        _built[key] = (a, bool(by))
    return _built[key]


def scan(data: bytes, automaton) -> tuple[int, np.ndarray, set[str]]:
    """(words, flag of each word, items) of one text."""
    words = data.translate(TABLE).split()
    n, hits, items = len(words), None, set()
    if n:
        starts = None
        for end, (k, owners) in automaton.iter(f" {b' '.join(words).decode('latin-1')} "):
            if starts is None:
                lens = np.fromiter(map(len, words), np.int64, n)
                starts = np.cumsum(lens + 1) - lens  # of each word in the padded text
                hits = np.zeros(n + 1, np.int64)
            last = int(np.searchsorted(starts, end, "left"))  # words before the closing blank
            hits[last - k] += 1
            hits[last] -= 1
            items.update(owners)
    flags = np.zeros(n, bool) if hits is None else np.cumsum(hits[:-1]) > 0
    return n, flags, items


def byte_spans(data: bytes, flags: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of the original text from the first to the last word of each run of flagged words."""
    if not flags.any():
        return []
    word = np.frombuffer(data.translate(TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    f = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return list(zip(starts[f[:-1] == 1].tolist(), ends[np.flatnonzero(f == -1) - 1].tolist(), strict=True))


NEW = ("items", "n_words", "n_hit", "spans")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _pass(key: str, patterns, first: bool, last: bool):
    """One scan over all texts. Between scans, ``bits`` holds the flags of the words and ``items`` the items so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, some = _automaton(key, patterns)
        for b in batches:
            t = pa.Table.from_batches([b])
            before = [(None, [])] * b.num_rows if first else list(zip(b.column("bits").to_pylist(), b.column("items").to_pylist(), strict=True))
            n, hit, spans, found, bits = [], [], [], [], []
            for data, (old, items) in zip(b.column("text").cast(pa.binary()).to_pylist(), before, strict=True):
                data = data or b""
                k, flags, owners = scan(data, auto) if some else (len(data.translate(TABLE).split()), None, set())
                flags = np.zeros(k, bool) if flags is None else flags
                if old is not None:
                    flags |= np.unpackbits(np.frombuffer(old, np.uint8), count=k).astype(bool)
                n.append(k)
                hit.append(int(flags.sum()))
                found.append(sorted(owners.union(items)))
                if last:
                    spans.append([{"start": s, "stop": e} for s, e in byte_spans(data, flags)])
                else:
                    bits.append(np.packbits(flags).tobytes())
            t = t.drop_columns([c for c in ("bits", "items") if not first]).append_column("items", pa.array(found, pa.list_(pa.string())))
            if last:
                t = t.drop_columns(["text"]).append_column("n_words", pa.array(n, pa.int64()))
                t = t.append_column("n_hit", pa.array(hit, pa.int64())).append_column("spans", pa.array(spans, _SPAN))
            else:
                t = t.append_column("bits", pa.array(bits, pa.binary()))
            yield from t.to_batches()

    return run


def annotated(docs: DataFrame, items: DataFrame, width: int = WIDTH, slice_bytes: int = SLICE_BYTES, text: str = "text") -> DataFrame:
    """``docs`` with items (sorted ids), n_words, n_hit and spans (byte ranges of the original text).

    A word is hit where it lies inside any occurrence of a window of an item. Null and empty texts have no
    words; null item ids count as ``""``; items without words have no window; repeated items share patterns;
    an empty benchmark hits nothing. Columns of ``docs`` with the names of the four new ones are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    p = stage(item_patterns(items, width=width), "patterns")
    size = p.agg(F.coalesce(F.sum(F.length("pattern") + 64), F.lit(0))).first()[0]
    slices = max(1, -(-size // slice_bytes))
    df = held(docs, NEW, text=text)
    flat = T.StructField("items", T.ArrayType(T.StringType()))
    end = [flat, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", SPANS)]
    for k in range(slices):
        first, last = k == 0, k == slices - 1
        mine = p.filter(F.pmod(F.xxhash64("pattern"), F.lit(slices)) == k).select("pattern", "item_id").collect()
        patterns = spark.sparkContext.broadcast([(bytes(r.pattern), r.item_id) for r in mine])
        schema = with_fields(df, ["text", "items", "bits"], end) if last else with_fields(df, ["items", "bits"], [flat, T.StructField("bits", T.BinaryType())])
        df = df.mapInArrow(_pass_of(patterns, first, last), schema)
        if not last:
            df = stage(df, "scanned")  # one automaton in memory at a time
    return released(df, *NEW)


def _pass_of(patterns, first: bool, last: bool):
    """The scan with the slice that ``patterns``, a broadcast variable, has; workers keep its automaton under ``key``."""
    key = uuid.uuid4().hex

    def run(batches):
        yield from _pass(key, patterns.value, first, last)(batches)

    return run


def digests(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``."""
    a = annotated(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items)
    return a.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
