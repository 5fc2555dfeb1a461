"""op7: suffix-array deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import substrings
from undula.llm.catalogue import query, table


@query("op7_substrings")
def op7_substrings(spark: SparkSession, sf: str) -> DataFrame:
    d = substrings.without_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
