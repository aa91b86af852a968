"""Every registered query against its SQL, on the smallest tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import SMALL_DIR

import catalog

QUERIES, SQL = catalog.collect()
TYPES = {
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SMALL_DIR):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL_DIR}/{file}'")
    return connection


@pytest.fixture(scope="module")
def results(request, spark):
    """Schema and rows of the selected queries, run a few at a time: small jobs are mostly planning."""

    def run(name: str):
        df = QUERIES[name](spark, SMALL_DIR)
        return df.schema, df.toPandas()

    chosen = [i.callspec.params["name"] for i in request.session.items if i.module is request.module and hasattr(i, "callspec")]
    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in chosen}


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if not pd.api.types.is_numeric_dtype(frame[c]):
            frame[c] = frame[c].map(lambda v: "" if v is None or v is pd.NaT else str(v)[:10] if hasattr(v, "year") else str(v))
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert not [name for name in QUERIES if "pipeline" in name or name.startswith("op")]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(results, duck, name):
    schema, rows = results[name].result()
    cursor = duck.execute(SQL[name])
    types = {c[0]: str(c[1]) for c in cursor.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in schema} == types
    got, expected = normal(rows), normal(cursor.df())
    assert len(got) == len(expected)
    for c in got.columns:
        a, b = got[c], expected[c]
        if pd.api.types.is_float_dtype(a):
            assert np.allclose(a.astype(float), b.astype(float), atol=2e-6, equal_nan=True), c
        else:
            assert (a.astype(str) == b.astype(str)).all(), c


#: SQL cannot fit their models; test_experiments.py holds their figures against plain Python.
FITTED = {
    "gbt_train", "boosted_train", "calibrated_train", "train_event_model", "recommendation", "scenario_analysis",
    "feature_attribution", "overfitting_sweep", "baseline_compare", "walk_forward", "walk_forward_summary",
    "calibration_compare", "gap_robustness", "horizon_alignment", "sue_compare", "survivorship_models", "alignment_models",
}


def test_every_other_query_has_sql():
    assert set(QUERIES) - set(SQL) == FITTED
