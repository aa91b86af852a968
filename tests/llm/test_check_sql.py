"""Queries with SQL against DuckDB, and the names of all queries."""

import os

import duckdb
import pandas as pd
import pytest
from conftest import SMALL_DIR

import corpus_pipeline
from eventlab.llm.queries import QUERIES, SQL


def plain(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted("|".join("" if pd.isna(v) else f"{v:g}" if isinstance(v, float) else str(v) for v in row) for row in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(SMALL_DIR):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL_DIR}/{file}'")
    assert plain(QUERIES[name](spark, SMALL_DIR).toPandas()) == plain(connection.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SMALL_DIR).count() > 0


def test_names():
    assert [int(name.split("_")[0][2:]) for name in QUERIES] == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_pipeline_is_its_stages(spark):
    """The pipeline's pieces are those of the documents that its stages leave, and clean documents stay."""
    docs = spark.read.parquet(f"{SMALL_DIR}/documents.parquet")
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL_DIR).cache()
        if name != "source_weights":
            assert 0.7 * rows < docs.count() <= rows
    expected = {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    pieces = corpus_pipeline.run(spark, SMALL_DIR).where("piece = 0")
    assert {r.doc_id: r["count"] for r in pieces.groupBy("doc_id").count().collect()} == expected
