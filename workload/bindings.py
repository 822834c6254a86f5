"""The driver's tables read as series: users by day, suppliers by month.

Daily values are built from whole cents, so that a sum does not depend on the order of
its rows and both engines decide events on the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fallpoint.contracts import to_daily
from fallpoint.operators.grid import fill_forward

KINDS = ("click", "error", "purchase", "signup", "view")
ID, DAY, LEVEL, EXPOSURE = "id", "day", "level", "exposure"
SEGMENT = "segment"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str | Column) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 100).cast("long")


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, day, level, one column per event kind, events that day, purchase seen that day."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))) + 1
    mean = lambda c: F.sum(c).cast("double") / F.count(c) / 100
    kinds = {k: mean(F.when(F.col("event_type") == k, _cents("value"))) for k in KINDS}
    out = to_daily(ev.withColumnRenamed("user_id", ID), id_col=ID, day=day,
                   aggs={LEVEL: mean(_cents("value")), "n_events": F.count(F.lit(1)), **kinds})
    return out


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_days plus running exposure, setpoint schedule and market segment."""
    base = user_days(spark, sf_dir)
    w = Window.partitionBy(ID).orderBy(DAY)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = base.withColumns({
        EXPOSURE: F.sum("n_events").over(run).cast("double"),
        "setpoint": F.when(F.count("purchase").over(run) > 0, 0.0).otherwise(1.0)})
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(ID),
                                                   F.col("c_mktsegment").alias(SEGMENT))
    return base.join(cust, ID, "left")


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by month: id, day, level, exposure, discount, tax, setpoint."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias(ID), "l_shipdate", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag")
    day = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
    n = F.count(F.lit(1))
    out = to_daily(li, id_col=ID, day=day, aggs={
        LEVEL: F.sum(_cents("l_quantity")).cast("double") / 100,
        "_price": F.sum(_cents("l_extendedprice")),
        "discount": F.sum(_cents("l_discount")).cast("double") / n / 100,
        "tax": F.sum(_cents("l_tax")).cast("double") / n / 100,
        "_r": F.count_if(F.col("l_returnflag") == "R")})
    run = Window.partitionBy(ID).orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({EXPOSURE: F.sum("_price").over(run).cast("double") / 100,
                            "setpoint": F.when(F.sum("_r").over(run) > 0, 0.0).otherwise(1.0)}
                           ).drop("_price", "_r")


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second observation set: event-kind columns carried forward."""
    return fill_forward(user_days(spark, sf_dir), id_col=ID, day_col=DAY, value_cols=list(KINDS))
