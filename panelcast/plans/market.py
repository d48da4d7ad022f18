"""Panels derived from the sales tables.

Money and quantities are summed as whole hundredths in BIGINT: exact, independent of the order of
rows, and quicker than wide decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hundredths(name: str) -> Column:
    return F.rint(F.col(name) * 100).cast("bigint")


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with segment, nation and month: the join all panels share.

    Order lines are not needed here, so the widest table is not read.
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            "o_orderkey",
            "o_orderpriority",
            F.col("n_name").alias("geography"),
            F.col("c_mktsegment").alias("product"),
            F.trunc("o_orderdate", "MM").alias("ds"),
            hundredths("o_totalprice").alias("price_c"),
        )
    )


def market_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ds, y): monthly order value of each market segment, in thousands."""
    return (
        sales(spark, sf_dir)
        .groupBy(F.col("product").alias("series_id"), "ds")
        .agg((F.sum("price_c").cast("double") / 1e5).alias("y"))
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per (nation, segment, month) of orders and their lines.

    Lines are first summed per order. That shuffle by order key is the one the join needs, and a
    crowded order shrinks to one row per task before it.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(hundredths("l_quantity")).alias("qty_c"),
            F.sum(hundredths("l_extendedprice")).alias("ext_c"),
            F.sum(hundredths("l_discount")).alias("disc_c"),
            F.sum(hundredths("l_tax")).alias("tax_c"),
            F.count(F.lit(1)).alias("n_lines"),
        )
    )
    orders = sales(spark, sf_dir)
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("price_c")).otherwise(F.lit(0))
    return (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
        .groupBy("geography", "product", "ds")
        .agg(
            F.sum("price_c").alias("value_c"),
            F.sum(urgent).alias("urgent_c"),
            *[
                F.coalesce(F.sum(c), F.lit(0)).alias(c)
                for c in ("qty_c", "ext_c", "disc_c", "tax_c", "n_lines")
            ],
            F.count(F.lit(1)).alias("n_orders"),
        )
    )


MODEL_FEATURES = ["x_qty", "x_price", "x_disc", "x_urgent"]


def model_panel(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    """(series_id, ds, y, x_*): one row per series and month; ``fine`` makes a series of every
    nation and segment instead of every segment."""
    name = F.concat_ws("/", "geography", "product") if fine else F.col("product")
    sums = (
        facts(spark, sf_dir)
        .groupBy(name.alias("series_id"), "ds")
        .agg(
            *[
                F.sum(c).alias(c)
                for c in ("value_c", "urgent_c", "qty_c", "ext_c", "disc_c", "n_lines")
            ]
        )
    )
    return sums.select(
        "series_id",
        "ds",
        (F.col("value_c").cast("double") / 1e5).alias("y"),
        (F.col("qty_c").cast("double") / 100.0).alias("x_qty"),
        _ratio(F.col("ext_c"), F.col("qty_c")).alias("x_price"),
        (_ratio(F.col("disc_c"), F.col("n_lines")) / 100.0).alias("x_disc"),
        _ratio(F.col("urgent_c"), F.col("value_c")).alias("x_urgent"),
    )


LONG_DRIVERS = ["disc_Ncov", "disc_Wcov", "tax_FCT", "price index", "qty", "flat", "gap"]


def long_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide text table as a CSV export gives it: every column a string, two measures per cell.

    ``flat`` is constant and ``gap`` is missing in every fourth month.
    """
    cells = facts(spark, sf_dir)
    price = F.floor(_ratio(F.col("ext_c") * 100, F.col("qty_c"))).cast("bigint")
    measures = F.array(
        F.struct(F.lit("value").alias("measure"), F.col("value_c").alias("amount")),
        F.struct(F.lit("volume").alias("measure"), F.col("qty_c").alias("amount")),
    )
    wide = cells.select(
        F.date_format("ds", "yyyy-MM-dd").alias("date"),
        "geography",
        "product",
        F.inline(measures),
        F.col("urgent_c").alias("own_share"),
        F.col("disc_c").alias("disc_Ncov"),
        (F.col("disc_c") + F.col("n_lines")).alias("disc_Wcov"),
        F.col("tax_c").alias("tax_FCT"),
        price.alias("price index"),
        F.col("qty_c").alias("qty"),
        F.lit(1).alias("flat"),
        F.when(F.month("ds") % 4 != 0, F.col("n_orders")).alias("gap"),
    )
    text = ["amount", "own_share", *LONG_DRIVERS]
    return wide.select(
        "date",
        "measure",
        "geography",
        "product",
        *[
            F.col(f"`{c}`").cast("string").alias("total_market" if c == "amount" else c)
            for c in text
        ],
    )


def naive_forecast(panel: DataFrame, season: int = 12) -> DataFrame:
    """(series_id, ds, yhat): the value ``season`` rows earlier. A model-free forecast."""
    from panelcast.operators.ordered import lag_matrix

    lagged = lag_matrix(panel.select("series_id", "ds", "y"), "y", [season])
    return lagged.filter(F.col(f"y_lag_{season}").isNotNull()).select(
        "series_id", "ds", F.col(f"y_lag_{season}").alias("yhat")
    )


# Coefficients of a fixed linear model over the features; its shares are exact by construction.
LINEAR_MODEL = {"x_qty": 0.53, "x_price": -0.27, "x_disc": 3011.37, "x_urgent": 211.37}


def linear_phi(panel: DataFrame) -> DataFrame:
    """(row_id, feature, value, phi): exact shares of a linear model, phi = b (value - mean).

    The four means are one row, read as a scalar subquery; the features become rows by one
    ``inline`` without a join.
    """
    names = list(LINEAR_MODEL)
    means = panel.agg(F.struct(*[F.round(F.avg(c), 6).alias(c) for c in names]).alias("m"))
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(c).alias("value"),
                (F.lit(b) * (F.col(c) - F.col("__m").getField(c))).alias("phi"),
            )
            for c, b in LINEAR_MODEL.items()
        ]
    )
    rows = panel.filter(" and ".join(f"{c} is not null" for c in names))
    return rows.withColumn("__m", means.scalar()).select(
        F.concat_ws("|", "series_id", F.col("ds").cast("string")).alias("row_id"),
        F.inline(entries),
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events as series of microsecond timestamps: five keys hold all rows."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"), F.col("ts").alias("ds"), "event_id", "value"
    )
