"""op10: SimHash near-duplicates (no SQL: XXH64 is not in DuckDB; tested against brute force)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undula.llm import simhash
from undula.llm.catalogue import query, table


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))
