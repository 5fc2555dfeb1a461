"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def isclose(v: Column, target: float) -> Column:
    """|v - target| <= 1e-8 + 1e-5*|target|."""
    return F.abs(v - F.lit(float(target))) <= 1e-8 + 1e-5 * abs(target)


def three_state(v: Column) -> Column:
    """0 and 1 up to the usual tolerance, everything else 0.5."""
    return F.when(isclose(v, 1.0), 1.0).when(isclose(v, 0.0), 0.0).otherwise(0.5)


def sigmoid(z: Column) -> Column:
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))
    return 1.0 / (1.0 + F.exp(-z))


def clip_round(v: Column, lo: float, hi: Column | float, decimals: int) -> Column:
    """Clip to [lo, hi], round half to even, clip again."""
    hi = F.lit(float(hi)) if isinstance(hi, (int, float)) else hi
    bound = lambda c: F.greatest(F.lit(float(lo)), F.least(c, hi))
    return bound(F.bround(bound(v), decimals))


def argmax_label(scores: Column) -> Column:
    """Zero-based position of the first largest entry."""
    return F.array_position(scores, F.array_max(scores)) - 1


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def canonical(v: Column) -> Column:
    return F.upper(F.trim(v.cast("string")))


def record_key(path: Column | Sequence[Column], code: Column, subject: Column, trial: Column) -> Column:
    """Composite key (file stem, code, subject, trial); several paths mean first non-empty wins."""
    paths = [path] if isinstance(path, Column) else list(path)
    first = F.coalesce(*[F.when(p != "", p) for p in paths])
    return F.struct(
        stem(first).alias("stem"), canonical(code).alias("code"), canonical(subject).alias("subject"), canonical(trial).alias("trial")
    )


def safe_tag(v: Column) -> Column:
    """Text usable in a file name: '.' -> 'p', '-' -> 'm', '/' -> '_'."""
    return F.translate(v.cast("string"), ".-/", "pm_")


def duration(seconds: Column) -> Column:
    """HH:MM:SS of a number of seconds, rounded half to even, never negative."""
    s = F.greatest(F.bround(seconds.cast("double"), 0).cast("bigint"), F.lit(0).cast("bigint"))
    two = lambda v: v.cast("bigint")
    return F.format_string("%02d:%02d:%02d", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))


def label_name(v: Column, names: dict[int, str]) -> Column:
    """Name of a class id; null when unknown."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), v.cast("int"))


def hash_text(key: Column | Sequence[Column], seed: int | str) -> Column:
    """Reproducible pseudo-random hex text of a row."""
    cols = [key] if isinstance(key, Column) else list(key)
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed))))


def hash_uniform(key: Column | Sequence[Column], seed: int | str) -> Column:
    """Reproducible number in [0, 1) from the first 52 bits of ``hash_text``."""
    return F.conv(F.substring(hash_text(key, seed), 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))
