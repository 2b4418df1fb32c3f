"""Registered queries against their SQL, and the pipeline against brute force."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check_oracles import TABLES, compare

import corpus_pipeline
from quire.llm.common import table
from quire.llm.oracles import oracles
from quire.llm.queries import registry

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


def test_all_queries_and_the_pipeline_are_registered():
    import __spark_entry__
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in registry()}
    assert set(registry()) | {"pipeline"} <= names and set(oracles()) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_equals_its_sql(spark, con, name):
    found = compare(spark, name, registry()[name], oracles()[name], SF01, con)
    assert found["status"] == "ok", found


def test_stages_return_the_columns_of_documents_and_take_effect(spark):
    docs = table(spark, SF001, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == table(spark, SF001, "documents").columns, name
        docs = spark.createDataFrame(out.toArrow(), out.schema)
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] <= counts[1]
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    assert tokens.count() == counts[3] and "text" not in tokens.columns
    run = corpus_pipeline.run(spark, SF001)
    key = lambda r: (r["doc_id"], r["ids"])
    assert sorted(map(key, run.collect())) == sorted(map(key, tokens.collect()))


def test_stages_take_odd_and_empty_documents(spark):
    schema = table(spark, SF001, "documents").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "words here", None, None, None)], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF001).collect()
