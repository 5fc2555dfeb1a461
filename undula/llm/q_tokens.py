"""op4: token counts (no SQL: a tokenizer; tested against the library)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from undula.llm import tokens
from undula.llm.catalogue import query, table


@query("op4_tokens")
def op4_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
