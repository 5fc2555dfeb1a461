"""Chat formatting by columnar byte assembly.

Rows are dealt by ranges of (conversation, turn) and sorted, so that a conversation with a third of all rows
is spread over many tasks. A batch is assembled at once: the lengths of all segments (role header, content,
end marker), their cumulative offsets and the destination of every byte are NumPy arrays, and headers and
contents are scattered into one preallocated buffer that becomes the Arrow column.

The template marks each turn: ``[INST]`` text ``[/INST]`` for the user, ``[OUT]`` text ``</s>`` for the
assistant, ``[SYS]`` text ``[/SYS]`` for the system and ``[ROLE]`` role ``[/ROLE]`` text ``</s>`` for others.
Control strings inside texts get a backslash after their first character, one more where there is one
already, so reading back removes exactly one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.batches import bound_batches
from undula.session import ship_package

#: Header and end marker by role (fixed values).
USER, ASSISTANT, SYSTEM = ("[INST]", "[/INST]"), ("[OUT]", "</s>"), ("[SYS]", "[/SYS]")
OTHER = ("[ROLE]", "[/ROLE]", "</s>")
CONTROL = r"(INST\]|/INST\]|OUT\]|SYS\]|/SYS\]|ROLE\]|/ROLE\]|s>|/s>)"
PIECE_BYTES = 4_000_000  # bytes of texts that are assembled at once
_HEAD = [USER[0], ASSISTANT[0], SYSTEM[0], OTHER[0]]
_MID = ["", "", "", OTHER[1]]
_FOOT = [USER[1], ASSISTANT[1], SYSTEM[1], OTHER[2]]
_TURN = re.compile(r"\[(INST|OUT|SYS|ROLE)\](.*?)(?:\[/INST\]|\[/SYS\]|\[/ROLE\](.*?)</s>|</s>)", re.S)
_ESCAPED = re.compile(r"([<\[]\\*)\\" + CONTROL)
_ROLE = {"INST": "user", "OUT": "assistant", "SYS": "system"}
PART = "conv_id {kind}, part bigint, n_turns bigint, formatted string, loss array<struct<start: int, stop: int>>"


def escaped(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(text, r"([<\[])(\\*)" + CONTROL, r"\1\2\\\3")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string array without nulls."""
    a = a.cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off


def assemble(role: pa.Array, text: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted conversations of rows in order; ``first`` marks the rows that start one.

    Returns the column, and for each row the byte offset in its conversation's string where its text starts,
    the text's byte length, and the row's kind (0 user, 1 assistant, 2 system, 3 other).
    """
    n = len(role)
    names = np.array(role.to_pylist(), object)
    kind = np.select([names == "user", names == "assistant", names == "system"], [0, 1, 2], 3)
    role_text = escaped(pc.if_else(pa.array(kind == 3), role, ""))
    # segments of a row: header, role, separator, text, end
    tables = [np.frombuffer("".join(x).encode(), np.uint8) for x in (_HEAD, _MID, _FOOT)]
    table_off = [np.concatenate(([0], np.cumsum([len(s) for s in x]))) for x in (_HEAD, _MID, _FOOT)]
    role_data, role_off = _bytes_of(role_text)
    data, off = _bytes_of(escaped(text))
    parts = [
        (tables[0], table_off[0][kind], table_off[0][kind + 1]),
        (role_data, role_off[:-1], role_off[1:]),
        (tables[1], table_off[1][kind], table_off[1][kind + 1]),
        (data, off[:-1], off[1:]),
        (tables[2], table_off[2][kind], table_off[2][kind + 1]),
    ]
    length = np.stack([stop - start for _, start, stop in parts], axis=1)
    dest = np.concatenate(([0], np.cumsum(length.ravel())))
    out = np.empty(int(dest[-1]), np.uint8)
    dest = dest[:-1].reshape(n, 5)
    for k, (src, start, _) in enumerate(parts):
        size = length[:, k]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(dest[:, k], size) + inside] = src[np.repeat(start, size) + inside]
    at = np.flatnonzero(first)
    conv_off = np.append(dest[at, 0], len(out)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(conv_off), pa.py_buffer(out)])
    conv = np.cumsum(first) - 1
    return column, dest[:, 3] - conv_off[conv], length[:, 3], kind


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, serial = TaskContext.get().partitionId(), 0
    for b in batches:
        size = pc.add(pc.binary_length(b.column(1).cast(pa.binary())), pc.binary_length(b.column(2).cast(pa.binary()))).to_numpy()
        piece = np.cumsum(size) // PIECE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            ids, role, text = (b.column(i).slice(lo, hi - lo) for i in range(3))
            code = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy()
            first = np.concatenate(([True], code[1:] != code[:-1]))
            column, start, size, kind = assemble(role, text, first)
            at = np.append(np.flatnonzero(first), hi - lo)
            spans = []
            for s, lo2, hi2 in zip(column.to_pylist(), at, at[1:], strict=False):
                raw, mine = s.encode(), []
                for r in range(lo2, hi2):
                    if kind[r] == 1:
                        a = len(raw[: start[r]].decode())
                        mine.append({"start": a, "stop": a + len(raw[start[r] : start[r] + size[r]].decode())})
                spans.append(mine)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(at[:-1])), pa.array(np.arange(serial, serial + len(at) - 1) + (task << 40)), pa.array(np.diff(at), pa.int64()),
                    column.cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                ],
                names=["conv_id", "part", "n_turns", "formatted", "loss"],
            )
            serial += len(at) - 1


def formatted(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss): the conversations' strings.

    A conversation's string is that of its parts in the order of ``part``; most have one, and a part holds
    whole turns. ``loss`` has the code point ranges of the part's assistant texts. Turns are in the order of
    ``turn``, nulls first, ties by role and text. Null texts and roles are empty; rows with a null conv_id
    form one conversation; repeated rows are turns of their own; an empty table gives no rows.
    """
    ship_package(rows.sparkSession)
    bound_batches(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = rows.select(F.col(conv_id).alias("conv_id"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), F.col(turn).alias("turn"))
    r = r.repartitionByRange(n, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return r.mapInArrow(_format, PART.format(kind=rows.schema[conv_id].dataType.simpleString()))


def turns(part: str) -> Iterator[tuple[str, str, tuple[int, int]]]:
    """(role, text, code point range of the text) of each turn, read back from a formatted string."""
    for m in _TURN.finditer(part):
        if m[1] == "ROLE":
            yield unescaped(m[2]), unescaped(m[3]), m.span(3)
        else:
            yield _ROLE[m[1]], unescaped(m[2]), m.span(2)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts come sorted by conversation and part; only the open conversation's sums are kept."""
    unset = object()
    now, n, all_, chars, loss, loss_chars = unset, 0, None, 0, None, 0
    for b in batches:
        done = []
        for cid, part, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if now is unset or cid != now:
                if now is not unset:
                    done.append((now, n, all_.hexdigest(), loss_chars, loss.hexdigest(), chars))
                now, n, all_, chars, loss, loss_chars = cid, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            chars += len(part)
            for role, text, _ in turns(part):
                n += 1
                all_.update(f"{role}\n{text}\n".encode())
            for s in spans:
                text = unescaped(part[s["start"] : s["stop"]])
                loss.update(text.encode())
                loss_chars += len(text)
        yield _rows(done, b.schema.field(0).type)
    if now is not unset:
        yield _rows([(now, n, all_.hexdigest(), loss_chars, loss.hexdigest(), chars)], None)


def _rows(rows: list, kind) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(parts: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted parts alone."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    p = parts.select("conv_id", "formatted", "loss", "part").repartition("conv_id").sortWithinPartitions("conv_id", "part").drop("part")
    return p.mapInArrow(_digest, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
