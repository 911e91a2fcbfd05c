"""The panels that the given tables hold, as lazy frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_mean(name: str) -> Column:
    """The mean of a column of decimal fractions, whatever the order of its rows.

    Doubles below 1e9 that print with six places at most are summed as whole millionths, so equal means stay equal and a
    row on a border stays there. Where a group has other values, or the sum is no long, it is the plain mean."""
    c = F.col(name)
    whole = F.expr(f"try_cast(rint(`{name}` * 1e6D) as bigint)")
    whole = F.when((F.abs(c) < 1e9) & (whole.cast("double") / 1e6 == c), whole)
    total = F.try_sum(whole).cast("double") / (F.count(name) * 1e6)
    return F.coalesce(F.when(F.count(whole) == F.count(name), total), F.avg(name))


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1: user_id, ts, event_id, value, event_type and k from the JSON properties."""
    e = _table(spark, sf_dir, "events")
    return e.select("user_id", "ts", "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


def user_day_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2: user and day; mean value, number of events, mean k."""
    e = event_panel(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return e.groupBy("user_id", "day").agg(F.avg("value").alias("y"), F.count("*").cast("double").alias("n"), F.avg("k").alias("k"))


def supplier_month_panel(spark: SparkSession, sf_dir: str, mean: Callable[[str], Column] = F.avg) -> DataFrame:
    """P3: supplier and month; revenue, quantity, mean discount (the treatment), mean tax, lines."""
    l = _table(spark, sf_dir, "lineitem").withColumn("month", F.to_date(F.date_trunc("month", "l_shipdate")))  # noqa: E741
    return l.groupBy("l_suppkey", "month").agg(
        F.sum("l_extendedprice").alias("y"),
        F.sum("l_quantity").alias("quantity"),
        mean("l_discount").alias("discount"),
        mean("l_tax").alias("tax"),
        F.count("*").cast("double").alias("n"),
    )


def order_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4: customer and order date; some customers order twice on a day."""
    return _table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


def turn_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: conversation and turn; length of the text, role."""
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("y"), "role")
