"""op8: quality classifier (no SQL: a trained model; tested on held-out rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undula.llm import quality
from undula.llm.catalogue import query, table


@query("op8_quality")
def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))
