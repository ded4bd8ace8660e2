"""The registered queries on the smallest tables: beside their SQL where there is one, else by what must hold; and the pipeline."""

import importlib
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check_oracle import compare, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from tickerloom.llm.queries import CHECKS, QUERIES  # noqa: E402
from tickerloom.llm.sources import table  # noqa: E402

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, db, name):
    error, rows, _ = compare(spark, db, FOLDER, name, QUERIES[name], CHECKS.get(name))
    assert not error and rows


def test_all_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_pipeline_stages_hand_on_documents(spark):
    docs = table(spark, FOLDER, "documents")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.pin(stage(spark, docs, FOLDER))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[2] < counts[1] < counts[0] and counts[3] == counts[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert whole.filter("n <> end OR n > 4096").isEmpty()


def test_pipeline_of_no_documents(spark):
    none = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = corpus_pipeline.pin(stage(spark, none, FOLDER))
    assert none.isEmpty()
