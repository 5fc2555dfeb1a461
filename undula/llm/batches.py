"""Sizes of the batches of texts that tasks hold in memory."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS = 1000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """Lowers the session's Arrow batches to at most ``rows`` rows, so that a batch of long texts stays small
    in the executor and in its Python worker. A lower setting stays as it is."""
    now = int(spark.conf.get(_KEY))
    if now <= 0 or now > rows:
        spark.conf.set(_KEY, str(rows))
