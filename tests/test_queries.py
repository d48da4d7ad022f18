"""Every registered query against its SQL twin, and the plans of the important ones."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from panelcast.plans import market, queries

TWINS = {n: q for n, q in entry.oracle_sql().items() if n in queries.REGISTRY}
TABLES = [*market.SALES, "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        values = frame[c]
        sample = values.dropna()
        first = sample.iloc[0] if len(sample) else None
        if isinstance(first, (bool, int, float, np.number)):
            frame[c] = values.astype(float)
        elif hasattr(first, "isoformat"):
            frame[c] = pd.to_datetime(values).astype(str)
        else:
            frame[c] = values.astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_sql(spark, sf, db, name):
    got = normal(entry.queries()[name](spark, sf).toPandas())
    want = normal(db.sql(TWINS[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    same = (got == want) | (got.isna() & want.isna())
    assert same.all().all(), (got[~same.all(axis=1)], want[~same.all(axis=1)])


@pytest.mark.parametrize("name", sorted(set(queries.REGISTRY) - set(TWINS)))
def test_model_query_returns_rows(spark, sf, name):
    rows = entry.queries()[name](spark, sf).toPandas()
    assert len(rows) > 0
    numbers = rows.select_dtypes("number").to_numpy(dtype=float)
    assert np.isfinite(numbers).all()


def test_entry_has_stable_schema(spark):
    df = entry.entry(spark)
    assert [n for n, _ in df.dtypes] == ["series_id", "ds", "y", "mean_3", "diff_1", "scaled"]
    assert df.count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    orders = market.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    text = plan(orders)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text
    lines = plan(market.facts(spark, sf))
    assert "l_shipdate" not in lines and "o_orderstatus" not in lines
    assert "lineitem" not in plan(market.market_size(spark, sf))


# These solve small matrices in Python, one row per series; all others are native throughout.
SOLVED = (
    "adf_", "should_diff", "sarx_", "trend_season_", "forecast_grid", "best_forecast",
    "smoothing_", "var_", "elastic_net_", "ridge_", "inflation_",
)
NATIVE = [n for n in sorted(TWINS) if not n.startswith(SOLVED)]


@pytest.mark.parametrize("name", NATIVE)
def test_sql_queries_stay_in_the_engine(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    for python in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups"):
        assert python not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["adf_test", "sarx_coefficients", "trend_season_fit"])
def test_python_sees_one_row_per_series(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    python = [i for i, line in enumerate(text.splitlines()) if "ArrowEvalPython" in line]
    lines = text.splitlines()
    assert python
    for i in python:
        below = "\n".join(lines[i + 1 : i + 8])
        assert "Aggregate" in below or "Scan ExistingRDD" in below and "gram" in below


def test_windows_over_events_are_split_by_chunk(spark, sf):
    text = plan(entry.queries()["event_lags"](spark, sf))
    spans = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert any("__chunk" in line for line in spans)
    # Only the table of chunk sizes is laid out by series alone.
    alone = [line for line in spans if "__chunk" not in line]
    assert len(alone) <= 2


def test_top_k_limits_groups_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(entry.queries()["topk_rows"](spark, sf))


def test_order_lines_are_joined_without_a_second_shuffle(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(market.facts(spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning(l_orderkey") == 1
