"""Plan checks: one symbol shuffle, no single-partition window, no Python, no cross join."""

import re

import pytest

from tests.conftest import SF
from tickframe import operators as op
from tickframe.catalogue import ENTRIES, bars_o, spark_query
from tickframe.plans.inspect import formatted_plan, physical_plan, plan_problems

QUERIES = {name: spark_query(name) for name in ENTRIES}


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "export_indicators"])
def test_plan_has_no_forbidden_nodes(spark, name):
    df = QUERIES[name](spark, SF)
    assert plan_problems(df) == []


def test_flagship_plans_two_shuffles(spark):
    plan = physical_plan(QUERIES["scored_signals"](spark, SF))
    exchanges = re.findall(r"Exchange (hashpartitioning\([^)]*\))", plan)
    # partial-aggregated bar build, then one small shuffle of bars by symbol; every window reuses it
    assert len(exchanges) == 2, exchanges
    assert "partial_max_by" in plan


def test_scan_reads_only_needed_columns(spark):
    plan = formatted_plan(QUERIES["seasonality"](spark, SF))
    m = re.search(r"ReadSchema: (struct<[^>]*>)", plan)
    assert m and m.group(1) == "struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>"


def test_benchmark_correlation_scans_once(spark):
    plan = physical_plan(QUERIES["pair_correlation"](spark, SF))
    assert plan.count("FileScan parquet") == 1  # one pass over the raw rows, no self-join


def test_top_k_uses_window_group_limit(spark):
    assert "WindowGroupLimit" in physical_plan(QUERIES["preview_last40"](spark, SF))


# queries that first write (export, stored bars) or checkpoint (chunked chains) their bars
_MATERIALISED = {"export_indicators", "basic_stats_actions", "missing_counts_actions", "adjusted_close",
                 "all_pairs_correlation", "all_pairs_top3", "bars_merged_loads", "incremental_indicators",
                 *(name for name in QUERIES if name.endswith(("_chunked", "_bounded", "_stored")))}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in _MATERIALISED])
def test_raw_table_scanned_once(spark, name):
    from tests.conftest import SF_SMALL

    df = QUERIES[name](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1


@pytest.mark.parametrize("name", ["basic_stats", "missing_counts", "humanized_volume"])
def test_summaries_combine_before_the_symbol_shuffle(spark, name):
    plan = physical_plan(QUERIES[name](spark, SF))
    assert "REPARTITION_BY_COL" not in plan
    below = plan[plan.index("hashpartitioning(symbol#"):]
    assert re.search(r"HashAggregate\(keys=\[symbol#\d+\], functions=\[partial_|SortAggregate\(keys=\[symbol#\d+\], functions=\[partial_", below)


def test_symbol_list_is_loaded_without_a_shuffle(spark, tmp_path):
    from tickframe.sources import load_bars

    bars_o(spark, SF).write.partitionBy("symbol").parquet(str(tmp_path / "bars"))
    assert "Exchange" not in physical_plan(load_bars(spark, str(tmp_path / "bars"), symbols=["5-LOW"]))


@pytest.mark.parametrize("fn", [lambda b: op.flag_outliers(b, exact=False), lambda b: op.returns_boxplot(b, exact=False)])
def test_sketched_quartiles_scan_once(spark, fn):
    plan = physical_plan(fn(bars_o(spark, SF)))
    assert plan.count("FileScan parquet") == 1


def test_large_dimension_is_not_broadcast_by_hint(spark):
    from pyspark.sql import functions as F
    from tickframe.sources import category_bars

    rows = spark.range(300_000).select(F.lit("c").alias("category"), F.col("id").cast("string").alias("symbol"),
                                       F.lit("x").alias("company"))
    assert "ResolvedHint" not in category_bars(bars_o(spark, SF), rows)._jdf.queryExecution().analyzed().toString()
