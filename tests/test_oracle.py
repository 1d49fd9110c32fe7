"""Every registered query against its DuckDB statement: names, types and rows."""

from __future__ import annotations

import duckdb
import pytest

import newsloom.plans  # noqa: F401
from newsloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"tinyint": "tinyint", "smallint": "smallint", "integer": "int", "varchar": "string", "timestamp": "timestamp_ntz"}
ROWS_ONLY = {"html_extract", "relevance_scores", "source_validation"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def test_every_query_has_an_oracle_but_known_ones():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name in ROWS_ONLY:
        assert got
        return
    answer = duck.sql(ORACLES[name])
    types = {c: TYPES.get(str(t).lower(), str(t).lower()) for c, t in zip(answer.columns, answer.types, strict=True)}
    assert types == dict(df.dtypes)
    names = answer.columns
    want = sorted((tuple(dict(zip(names, row, strict=True))[c] for c in columns) for row in answer.fetchall()), key=repr)
    assert got == want
