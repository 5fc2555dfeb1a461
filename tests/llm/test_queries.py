"""Registered queries against their SQL, and the pipeline stage by stage against plain selections."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from tests.compare import compare
from undula.llm import decontaminate, simhash, toxicity
from undula.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), ORACLES[name], SF) == ""


def test_all_are_registered():
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES} and "pipeline" in entry.queries()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    kept = cp.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    assert ids(kept) == ids(toxicity.scored(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 0"))
    kept = cp.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert ids(kept) == ids(simhash.near_duplicates(docs).filter("doc_id = component_id"))
    cut = cp.cut_repeats(spark, docs, SF)
    assert cut.columns == docs.columns and cut.filter(F.length("text") != F.col("n_chars")).count() == 0
    clean = cp.drop_contaminated(spark, docs, SF)
    assert ids(clean) == ids(decontaminate.digests(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("NOT contaminated"))
    out = cp.run(spark, SF)
    assert 0 < out.count() < docs.count() and {"size", "source_size", "target", "taken"} <= set(out.columns)


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (None, "a b c", "en", "s", 5), (3, "x y z", "en", "s", 5), (3, "x y z", "en", "s", 5), (4, "q " * 100_000, "en", "s", 200_000)]
    for name, cols in (("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], cols).write.parquet(f"{tmp_path}/{name}.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, SCHEMA)
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert len(out.collect()) <= len(data)
        assert cp.mix(spark, docs, str(tmp_path)).count() <= len(data)
    assert cp.drop_toxic(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).count() == len(rows)
    assert cp.drop_contaminated(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).count() == len(rows)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    names = "raw Score predicted kept n_bytes n_removed n_spans items n_words n_hit spans size source_size target taken doc_size fp row h __d __r __row __text __spans __bits __s __column_4".split()
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for i, c in enumerate(names):
        docs = docs.withColumn(c, F.concat_ws("-", F.lit(c), "doc_id", F.lit(i)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    of = lambda d, cols: {r.doc_id: [r[c] for c in cols] for r in d.select("doc_id", *cols).collect()}
    want = of(docs, names)
    for n, (name, stage) in enumerate(cp.STAGES, 1):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{n}")
        out = spark.read.parquet(f"{tmp_path}/{n}")
        there = names if name != "mixing" else ["doc_doc_size" if c == "size" else f"doc_{c}" if c in ("source_size", "target", "taken") else c for c in names]
        got = of(out, there)
        assert got and all(got[i] == want[i] for i in got), name
    assert [c for c in out.columns if c not in docs.columns] == ["doc_doc_size", "doc_source_size", "doc_target", "doc_taken"]
    plain = of(cp.mix(spark, docs.drop(*names), SF), ["size", "source_size", "target", "taken"])
    assert of(out, ["size", "source_size", "target", "taken"]) == plain


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b = "one text of some words that others repeat word by word", "another text with nothing at all in common"
    rows = [(1, a, "en", "s", 5), (2, a, "en", "s", 5), (2, b, "en", "s", 5), (2, b, "en", "s", 5), (None, a, "en", "s", 5), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    kept = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([(1, a), (2, b), (2, b), (None, a), (3, None)], key=str)
    rows = [(7, "w " * 30, "en", "s", 5), (7, "v", "en", "s", 5), (None, "x " * 40, "en", "s", 5), (None, "y", "en", None, 5), (8, None, "en", "s", 0)]
    got = {(r.doc_id, r.text): (r.size, r.taken) for r in cp.mix(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()}
    assert got.keys() <= {(i, t) for i, t, *_ in rows}
    assert all(size == len(t.split()) and 0 < taken <= 3 * size for (_, t), (size, taken) in got.items())
    assert (7, "w " * 30) in got and (None, "x " * 40) in got
