"""Stored bars and indicators that follow new raw rows.

``BarStore`` keeps, partitioned by month below one shared folder,

* ``states``: mergeable bars (``sources.bar_states``);
* ``summary``: bars per symbol and month with their first and last Date (the high-water dates);
* ``indicators``: the output of an indicator chain.

``append`` merges new states into the months they fall into, finds from the small summary
which months' indicators can change (the operator looks back a bounded number of
rows, so a change reaches that many bars ahead) and which earlier months hold the bars
these look back on, reads only these months and rewrites only the changed ones (dynamic
partition overwrite). Lists of months come to the driver; their number is bounded by the calendar.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickframe.operators.signals import technical_indicators
from tickframe.plans.chunks import CHUNK_SCOPES, reach
from tickframe.plans.session import cut_lineage
from tickframe.plans.windows import cluster_by_symbol
from tickframe.schema import BAR_SCHEMA
from tickframe.sources.bar_states import STATE_SCHEMA, bars_from_states, merge_states

SUMMARY_SCHEMA = "symbol string, n bigint, first date, last date, month date"


def month_of(date: Column | str) -> Column:
    return F.trunc(date, "month")


def _months(df: DataFrame, column: str = "month") -> list[dt.date]:
    return sorted(r[0] for r in df.select(column).distinct().collect())


def _in(months: Iterable[dt.date]) -> Column:
    return F.col("month").isin([F.lit(m) for m in months])


class BarStore:
    """Bars and indicators below ``path``; ``indicators(df, scope)`` is the chain, run at ``scope``."""

    def __init__(self, spark: SparkSession, path: str,
                 indicators: Callable[[DataFrame, str], DataFrame] = technical_indicators, scope: str = "month"):
        self.spark, self.path, self.chain, self.scope = spark, path.rstrip("/"), indicators, scope
        empty = spark.createDataFrame([], BAR_SCHEMA)
        self.reach = reach(empty, lambda d: indicators(d, CHUNK_SCOPES[scope]))
        self.indicator_schema = indicators(empty, scope).schema

    # ---- tables

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str) -> None:
        df.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "month").parquet(f"{self.path}/{name}")

    def states(self) -> DataFrame:
        return self._read("states", f"{STATE_SCHEMA}, month date")

    def summary(self) -> DataFrame:
        return self._read("summary", SUMMARY_SCHEMA)

    def bars(self, months: Iterable[dt.date] | None = None) -> DataFrame:
        """Stored bars, of all or the listed months (a partition filter)."""
        states = self.states() if months is None else self.states().filter(_in(months))
        return bars_from_states(states)

    def indicators(self) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.indicator_schema.fields)
        return self._read("indicators", f"{schema}, month date").drop("month")

    # ---- updates

    def append(self, states: DataFrame) -> list[dt.date]:
        """Adds states of new raw rows; returns the months whose indicators were rewritten."""
        new = cut_lineage(states.withColumn("month", month_of("Date")))
        touched = _months(new)
        if not touched:
            return []
        old = self.states().filter(_in(touched)).drop("month")
        merged = cut_lineage(merge_states(old, new.drop("month")).withColumn("month", month_of("Date")))
        self._write(merged, "states")
        self._write(merged.groupBy("month", "symbol").agg(
            F.count(F.lit(1)).alias("n"), F.min("Date").alias("first"), F.max("Date").alias("last")), "summary")
        changed = self._changed(new)
        bars = self.bars([*changed, *self._looked_back_on(changed)])
        done = self.chain(cluster_by_symbol(bars), self.scope).withColumn("month", month_of("Date"))
        self._write(done.filter(_in(changed)), "indicators")
        return changed

    def _changed(self, new: DataFrame) -> list[dt.date]:
        """Months with a bar that is new, merged, or less than ``reach`` bars behind one that is."""
        first = new.groupBy("symbol").agg(F.min("month").alias("_from"), F.max("month").alias("_to"))
        later = Window.partitionBy("symbol").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
        own = self.summary().join(first, "symbol").filter("month >= _from")
        # bars after the last touched month and before this one
        between = F.coalesce(F.sum(F.when(F.col("month") > F.col("_to"), F.col("n"))).over(later), F.lit(0))
        return _months(own.withColumn("_between", between).filter(
            (F.col("month") <= F.col("_to")) | (F.col("_between") < self.reach)))

    def _looked_back_on(self, changed: list[dt.date]) -> list[dt.date]:
        """Earlier months with one of the ``reach`` bars before a run of changed months, for any symbol."""
        stored = _months(self.summary())
        runs = [m for i, m in enumerate(stored) if m in set(changed) and (not i or stored[i - 1] not in set(changed))]
        starts = self.summary().withColumn("_start", F.explode(F.array([F.lit(m) for m in runs])))
        nearer = Window.partitionBy("_start", "symbol").orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)
        earlier = starts.filter("month < _start").withColumn("_nearer", F.coalesce(F.sum("n").over(nearer), F.lit(0)))
        return [m for m in _months(earlier.filter(F.col("_nearer") < self.reach)) if m not in set(changed)]
