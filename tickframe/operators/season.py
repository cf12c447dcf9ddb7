"""Seasonality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions.expr import month_name
from tickframe.operators.returns import daily_return


def seasonality(df: DataFrame, named: bool = False) -> DataFrame:
    """Per symbol and month of year: mean and sample stddev of the daily return, bar count."""
    if "daily_return" not in df.columns:
        df = daily_return(df)
    out = df.groupBy("symbol", F.month("Date").alias("month")).agg(
        F.avg("daily_return").alias("avg_return"),
        F.stddev_samp("daily_return").alias("return_volatility"),
        F.count(F.lit(1)).alias("days_counted"),
    )
    if named:
        out = out.withColumn("month_name", month_name("month"))
    return out
