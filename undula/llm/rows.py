"""Rows whose columns may have any names: they travel as one struct beside what an operator reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def held(docs: DataFrame, replaced: Sequence[str], **read: Column | str) -> DataFrame:
    """``rest`` (all columns of ``docs`` but those named like the ``replaced`` ones, in any case) and the columns ``read``."""
    gone = {c.lower() for c in replaced}
    rest = F.struct(*[F.col(_quoted(c)) for c in docs.columns if c.lower() not in gone])
    columns = {k: F.col(_quoted(c)) if isinstance(c, str) else c for k, c in read.items()}
    return docs.select(rest.alias("rest"), *[c.alias(k) for k, c in columns.items()])


def with_fields(df: DataFrame, drop: Sequence[str], added: Sequence[T.StructField]) -> T.StructType:
    """The schema of ``df`` without ``drop`` and with ``added``."""
    return T.StructType([*[f for f in df.schema.fields if f.name not in drop], *added])


def released(df: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns in ``rest`` again, and ``columns`` behind them."""
    return df.select("rest.*", *columns)
