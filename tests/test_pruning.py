"""Look-back ranges and portfolios reach the scan of stored bars."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import SF_SMALL
from tickframe.plans.inspect import formatted_plan, physical_plan
from tickframe.schema import BAR_SCHEMA
from tickframe.sources import bars_from_orders, lookback, portfolio_bars, read_table, stored_lookback, tracked_bars


def rows(df):
    return sorted(map(tuple, df.collect()))


def partitions_read(df):
    """Partitions that the scans of a plan opened, when it is run for the first time."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
        if name.startswith("Scan parquet"):
            metrics = node.metrics()
            out.append(metrics.apply("numPartitions").value() if metrics.contains("numPartitions") else None)
    return out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars"))
    bars = bars_from_orders(read_table(spark, SF_SMALL, "orders"))
    # one symbol stopped trading years before the others
    bars = bars.filter((F.col("symbol") != "2-HIGH") | (F.col("Date") < "1998-05-20"))
    bars.withColumn("month", F.trunc("Date", "month")).write.partitionBy("month").parquet(f"{path}/month")
    bars.write.partitionBy("symbol").parquet(f"{path}/symbol")
    spark.createDataFrame([("ann", "1-urgent"), ("ann", " 1-URGENT "), ("ann", "GONE"), ("bob", "5-LOW")],
                          "owner string, ticker string").write.parquet(f"{path}/portfolios")
    schema = T.StructType([*BAR_SCHEMA.fields, T.StructField("month", T.DateType())])
    return (bars, spark.read.schema(schema).parquet(f"{path}/month"),
            spark.read.schema(BAR_SCHEMA).parquet(f"{path}/symbol"), spark.read.parquet(f"{path}/portfolios"))


def test_look_back_reads_the_months_in_range(stored):
    bars, by_month, _, _ = stored
    want = rows(lookback(bars, 90))
    got = stored_lookback(by_month, 90)
    assert rows(got.drop("month")) == want
    months = {r[0] for r in lookback(bars, 90).select(F.trunc("Date", "month")).collect()}
    assert len(months) < 12 < by_month.select("month").distinct().count()
    pruned = re.search(r"PartitionFilters: \[([^\n]*)\]", formatted_plan(got)).group(1)
    assert "month" in pruned and str(dt.date(1998, 5, 1)) in pruned and "1999" not in pruned
    last = bars.groupBy("symbol").agg(F.max("Date").alias("last"))
    with_summary = stored_lookback(by_month, 90, last=last)
    assert len(months) <= max(p or 0 for p in partitions_read(with_summary)) <= len(months) + 2
    assert rows(with_summary.drop("month")) == want
    assert stored_lookback(by_month.limit(0), 90).collect() == []
    with pytest.raises(ValueError):
        stored_lookback(by_month, 0)
    assert rows(stored_lookback(by_month, "1 Month").drop("month")) == rows(lookback(bars, 30))


def test_a_portfolio_table_prunes_symbols_at_run_time(stored):
    bars, _, by_symbol, portfolios = stored
    got = tracked_bars(by_symbol, portfolios.filter("owner = 'ann'"), "ticker")
    assert "dynamicpruning" in physical_plan(got)
    assert 1 in partitions_read(got)  # of five
    assert rows(got) == rows(bars.filter("symbol = '1-URGENT'"))


def test_a_portfolio_list_is_a_partition_filter(stored):
    bars, _, by_symbol, _ = stored
    got = portfolio_bars(by_symbol, ["1-urgent", "5-low"], normalised=True)
    assert "symbol" in re.search(r"PartitionFilters: \[([^\n]*)\]", formatted_plan(got)).group(1)
    assert partitions_read(got) == [2]
    assert rows(got.select(bars.columns)) == rows(portfolio_bars(bars, ["1-urgent", "5-low"]))
