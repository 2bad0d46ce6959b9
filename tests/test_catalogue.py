"""Queries of the document model against DuckDB on the small tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from cartolith.plans import catalogue, claims, stored  # noqa: F401  both add their queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if pd.isna(v):
        return ""
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return str(bool(v))
    try:
        return round(float(v), 5)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)
    assert not any(isinstance(v, float) and math.isinf(v) for r in rows(got) for v in r)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_dashboard(spark, duck):
    from cartolith.operators import registry
    from cartolith.plans import binding

    parts = registry.dashboard(binding.tables(spark, SF), catalogue.SELECTED)
    head = parts["headline"].first()
    want = duck.sql(catalogue.ORACLES["headline_metrics"]).df().iloc[0]
    assert all(head[c] == want[c] for c in ("total", "ready", "registered", "threat"))
    assert parts["threat"].count() == 25 and parts["organizations"].count() == 10
    assert parts["statuses"].agg({"count": "sum"}).first()[0] == head["total"]
    assert parts["technology"].agg({"count": "sum"}).first()[0] == head["ready"] and 0 < parts["years"].count() <= 5
