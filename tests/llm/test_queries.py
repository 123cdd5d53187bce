"""Every query of the corpus operators on the smallest tables, against its SQL where it has one."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from registry.compare import connect, duck_rows, spark_rows
from tests.llm.helpers import edge_docs
from veilwatch.llm import packing
from veilwatch.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NATIVE = [n for n in QUERIES if n.split("_")[0] in ("op3", "op7", "op9", "op10")]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    cols, got = spark_rows(QUERIES[name](spark, SF))
    want_cols, want = duck_rows(connect(SF), ORACLES[name])
    assert cols == want_cols and got == want and got


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in NATIVE:
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert df.count() > 0 or name == "op1_decontaminate"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == [*range(1, 14)]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = len(corpus_pipeline.STAGES) - 1
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < last:
            assert out.columns == docs.columns
            docs = out.cache()
            kept[name] = docs.count()
    assert spark.read.parquet(f"{SF}/documents.parquet").count() > kept["quality"] == kept["lines"]
    assert kept["lines"] >= kept["near_duplicates"] >= kept["benchmark"] > 0
    whole = corpus_pipeline.run(spark, SF)
    assert whole.select(F.countDistinct("doc_id")).first()[0] == kept["benchmark"]
    assert sorted(whole.columns) == sorted(out.columns)


def test_pipeline_takes_awkward_rows(spark):
    docs = edge_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert set(docs.columns) == set(edge_docs(spark).columns)
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert packing.LENGTH == 1024
