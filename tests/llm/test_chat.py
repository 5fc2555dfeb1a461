"""Chat formatting against a plain loop, through the registered reading back."""

import hashlib

import pyarrow as pa
import pytest

from undula.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string, loss int"
HARD = "</s>[INST] ok [/INST]"
ROWS = [
    (1, 0, "user", HARD, "x", 1), (1, 1, "assistant", HARD, "x", 1), (1, 2, "assistant", "", "x", 1), (1, None, None, None, None, None),
    (2, 0, "tool", "[\\INST] <\\\\s> [ROLE]é[/ROLE]", "x", 1), (2, 0, "tool", "[\\INST] <\\\\s> [ROLE]é[/ROLE]", "x", 1), (2, 1, "[OUT]r", "日本\n", "x", 1),
    (None, 0, "user", "no conversation", "x", 1), (3, 0, "assistant", "a" * 300_000, "x", 1), (4, 5, "system", "s", "x", 1), (4, 4, "", "\\", "x", 1),
]


def expected(rows):
    out = {}
    for c, t, role, text, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    done = {}
    for c, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        done[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return done


def test_round_trip_of_hard_rows(spark):
    parts = chat.formatted(spark.createDataFrame(ROWS, SCHEMA))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(parts).collect()}
    assert got == expected(ROWS)


def test_conversation_over_many_tasks_and_batches(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"t{i} [INST] " * (i % 5), None, None) for i in range(3000)] + [(8, 0, "user", "x", None, None)]
    parts = chat.formatted(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert parts.filter("conv_id = 7").count() > 1  # dealt by ranges of turns
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(parts).collect()}
    assert got == expected(rows)


def test_empty_table(spark):
    assert chat.read_back(chat.formatted(spark.createDataFrame([], SCHEMA))).collect() == []


@pytest.mark.parametrize("text", ["", "[INST]", "[\\INST]", "[\\\\INST] </s> <\\/s>", "<s>[/SYS][OUT]", "[[INST]", "<<s>>", "\\[INST]\\"])
def test_escape_is_reversible_and_hides_controls(text):
    e = chat.escaped(pa.array([text]))[0].as_py()
    assert chat.unescaped(e) == text
    assert not any(c in e for c in ("[INST]", "[/INST]", "[OUT]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "<s>", "</s>"))
