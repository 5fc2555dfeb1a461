"""op2: toxicity (no SQL: a trained model; tested on held-out rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undula.llm import toxicity
from undula.llm.catalogue import query, table


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))
