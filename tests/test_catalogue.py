"""Every query of the catalogue against its SQL twin on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from seekspark import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return con


def plain(value):
    if isinstance(value, (list, np.ndarray)):
        return tuple(plain(x) for x in value)
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    if isinstance(value, (float, np.floating)):
        return round(float(value), 6) + 0.0
    return value.item() if isinstance(value, np.generic) else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_twin(spark, twin, name):
    got, want = catalogue.QUERIES[name](spark, FOLDER).toPandas(), twin.execute(catalogue.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_twin_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
