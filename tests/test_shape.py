from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.functions import feature_cols, matching, variant_last
from panelcast.operators import shape, trees
from panelcast.sources import load_panel
from tests.helpers import panel, rows_of


def test_name_rules_keep_order_and_move_variant_last():
    names = ["Date", "a_cov", "a_Ncov", "b", "c_FCT", "d_Ncov"]
    assert variant_last(names, "Ncov", "cov") == ["Date", "b", "c_FCT", "a_Ncov", "d_Ncov"]
    assert matching(names, "FCT") == ["c_FCT"]
    assert feature_cols(names, ["Date", "b"]) == ["a_cov", "a_Ncov", "c_FCT", "d_Ncov"]


def test_csv_is_read_as_text_and_cast_strictly(spark, tmp_path):
    path = tmp_path / "panel.csv"
    path.write_text("Date,Product,price index,gap\n2020-01-01,A,1.5,\n2020-02-01,B,2,NaN\n")
    df = load_panel(spark, str(path))
    assert [t for _, t in df.dtypes] == ["string"] * 4
    cast = shape.parse_ds(shape.cast_numeric(df, ["price index", "gap"]), "Date")
    assert rows_of(cast, "Date") == [
        (dt.date(2020, 1, 1), "A", 1.5, None),
        (dt.date(2020, 2, 1), "B", 2.0, None),
    ]
    path.write_text("Date,Product,price index,gap\n2020-01-01,A,abc,1\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        shape.cast_numeric(load_panel(spark, str(path)), ["price index"]).collect()


def test_other_sources(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("some_panel")
    assert load_panel(spark, "some_panel", "table").count() == 3
    for fmt in ("parquet", "orc"):
        spark.range(4).write.format(fmt).save(str(tmp_path / fmt))
        assert load_panel(spark, str(tmp_path / fmt), fmt, "id bigint").count() == 4


def test_csv_schema_is_checked_against_the_header(spark, tmp_path):
    path = tmp_path / "panel.csv"
    path.write_text("b,a\n1,x\n")
    with pytest.raises(Exception):
        load_panel(spark, str(path), schema="a string, b int").collect()


def test_slices_drop_null_and_joins_go_by_key(spark):
    df = spark.createDataFrame(
        [("v", "A", 1), ("v", None, 2), ("w", "A", 3)], "measure string, product string, x int"
    )
    assert rows_of(shape.slice_panel(df, measure="v", product="A"), "x") == [("v", "A", 1)]
    left = panel(spark, {"a": [1.0, 2.0, 3.0]}).drop("y")
    right = panel(spark, {"a": [5.0, 6.0]})
    joined = shape.attach_features(left, right)
    assert [r["y"] for r in joined.orderBy("ds").collect()] == [5.0, 6.0, None]
    assert shape.attach_column(left, right, "y").count() == 2


def test_densify_and_top_k(spark):
    df = panel(spark, {"a": [1.0, 2.0, 3.0, 4.0], "b": [7.0]})
    holes = df.filter(~F.col("y").isin(2.0, 3.0))
    full = shape.densify(holes)
    assert [r["y"] for r in full.orderBy("series_id", "ds").collect()] == [1, None, None, 4, 7]
    best = shape.top_k(df, "y", 2, ["ds"], ["series_id"])
    assert sorted(r["y"] for r in best.collect()) == [3.0, 4.0, 7.0]
    assert [r["y"] for r in shape.top_k(df, "y", 2, ["ds"]).collect()] == [7.0, 4.0]


def test_ranked_projection_breaks_ties_by_name(spark):
    ranking = spark.createDataFrame(
        [("x_b", 0.4), ("x_a", 0.4), ("x_c", 0.2)], "attribute string, importance double"
    )
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "id int, x_c double, x_b double, x_a double")
    assert shape.select_ranked(df, ranking, 2, ["id"]).columns == ["id", "x_a", "x_b"]


def test_zone_is_dropped_and_range_is_closed(spark):
    df = spark.sql("select timestamp '2024-03-01 10:00:00' as ds")
    plain = shape.strip_tz(df)
    assert plain.dtypes == [("ds", "timestamp_ntz")]
    assert plain.first()[0] == dt.datetime(2024, 3, 1, 10)
    days = panel(spark, {"a": [1.0, 2.0, 3.0, 4.0]})
    assert shape.between_dates(days, "2015-02-01", "2015-03-01").count() == 2


def test_importance_table_names_features(spark):
    df = panel(
        spark,
        {"a": [float(i) for i in range(40)]},
        x_0={"a": [float(i) for i in range(40)]},
        x_1={"a": [0.0] * 40},
    )
    table, names = trees.prepare(df, ["x_0", "x_1"])
    model = trees.forest(numTrees=3, maxDepth=3).fit(table)
    found = trees.importance_frame(df, model, names, "forest")
    assert rows_of(found, "attribute") == [("forest", "x_0", 1.0), ("forest", "x_1", 0.0)]
