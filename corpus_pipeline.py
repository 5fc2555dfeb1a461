"""A corpus from raw documents: every stage is written as Parquet and reread as the next one's input.

1. toxicity: documents that the toxicity model rejects go.
2. near_duplicates: of each SimHash component, the document with the smallest id stays (rows of one id: each by its text).
3. repeated_passages: bytes that repeat an earlier document go; so does a document of which nothing is left.
4. decontamination: documents that hold a passage of the benchmark go.
5. mixing: documents that the mix takes, with the words taken from each (repeats counted).

Documents may have other columns of any name: they pass through all stages unchanged. Where mixing adds a
column that a document has, the document's is renamed with ``doc_`` before it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import decontaminate, mixing, simhash, substrings, toxicity
from undula.session import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


READ = ("doc_id", "text", "source", "n_chars")  # columns that the stages read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def beside(names: list[str], added: list[str]) -> list[str]:
    """``names`` with ``doc_`` before those that ``added`` has too, as often as it takes to be unlike all others."""
    clash, used, out = {c.lower() for c in added}, {c.lower() for c in [*names, *added]}, []
    for c in names:
        if c.lower() in clash:
            while c.lower() in used:
                c = f"doc_{c}"
            used.add(c.lower())
        out.append(c)
    return out


def whole_rows(fn: Stage) -> Stage:
    """A stage inside which the columns that no stage reads have reserved names, so that operators cannot touch them."""

    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = [c if c.lower() in READ else f"__column_{i}" for i, c in enumerate(docs.columns)]
        out = fn(spark, docs.toDF(*held), sf_dir)
        added = out.columns[len(held) :]
        return out.toDF(*beside(docs.columns, added), *added)

    return run


@whole_rows
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are predicted ordinary."""
    fitted = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, fitted).filter("predicted = 0").select(*docs.columns)


@whole_rows
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component, keeps the document with the smallest id; rows without an id stay.

    A document is an id and a text: rows that repeat both stay or go together, and of rows that share an id only,
    each is judged by its own text (of those in one component, the one with the least SHA-256 counts).
    """
    named = docs.withColumn("__key", F.struct("doc_id", F.unhex(F.sha2("text", 256)).alias("sha")))
    found = simhash.near_duplicates(named.filter("doc_id IS NOT NULL"), "__key")
    gone = stage(found.filter("NOT (doc_id <=> component_id)").select(F.col("doc_id").alias("__gone")).distinct(), "near_duplicates")
    return named.join(gone, F.col("__key").eqNullSafe(F.col("__gone")), "left_anti").select(*docs.columns)


@whole_rows
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated bytes out of the texts; what is left of a character that was cut through goes too."""
    d = substrings.without_repeats(docs, as_text=True).filter("n_removed = 0 OR n_removed < n_bytes")
    d = d.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("bigint"))
    return d.select(*docs.columns)


@whole_rows
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents without a word inside a benchmark window."""
    return decontaminate.annotated(docs, _table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(*docs.columns)


@whole_rows
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken.

    A document is an id, a source and a text: rows that share an id only are taken each on its own; those that repeat
    all three show the most that was taken of one of them.
    """
    named = docs.withColumn("__key", F.struct("doc_id", "source", F.unhex(F.sha2("text", 256)).alias("sha")))
    m = mixing.mixed(named, carry=["__key"]).filter("taken > 0").groupBy(F.col("__key").alias("__k"))
    m = m.agg(*[F.max(c).alias(c) for c in ("size", "source_size", "target", "taken")])
    # one row per document: it grows with the documents and is never broadcast
    return named.join(m.hint("merge"), F.col("__key").eqNullSafe(F.col("__k"))).select(*docs.columns, "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]
#: None: a trained model, XXH64 and byte strings over all documents are not for SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), name)
    return docs
