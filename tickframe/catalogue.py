"""The query catalogue: every operator as a Spark query and as oracle SQL.

Each entry holds

* ``build(spark, sf_dir) -> DataFrame``: the Spark plan over the given tables;
* ``sql``: the same result as a chain of DuckDB CTEs ending in ``result``
  (``None`` where SQL cannot express it);
* ``out``: the output columns in order. ``name:d`` is a double rounded to 4
  decimals, ``name:c`` a correlation rounded to 9. The same list projects
  both sides, so names, order and rounding agree by construction.

Four decimals: windowed means and standard deviations of ~1e5 prices differ
between engines by up to ~1e-9 (different summation trees), which would flip
a 6th decimal; at 2 decimals, means of cents over 8 or 16 rows hit exact ties.

Fixtures (``FIXTURES.md``): O = bars built from ``orders`` (one symbol per
order priority), E = bars built from ``events`` (one per event type).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe import operators as op
from tickframe.functions.expr import humanize_amount
from tickframe.incremental import BarStore
from tickframe.plans.session import checkpoint_dir
from tickframe.schema import BAR_SCHEMA, PRICE_COLUMNS
from tickframe.sources import (
    bars_from_events, bars_from_orders, category_bars, category_frame, export_indicators,
    load_bars, lookback, lookback_ytd, portfolio_bars, read_table, stored_lookback, tracked_bars,
)
from tickframe.sources.bar_states import STATE_SCHEMA, bars_from_states, merge_states, order_states
from tickframe.sources.bars import EVENTS_COLUMNS, ORDERS_COLUMNS
from tickframe.sources.sinks import EXPORT_COLUMNS

DECIMALS = 4
CORR_DECIMALS = 9

# Test dimension for fixture O: the five order priorities in two categories.
FIXTURE_CATEGORIES = {
    "Urgent": {"1-URGENT": "Urgent orders", "2-HIGH": "High-priority orders"},
    "Routine": {"3-MEDIUM": "Medium-priority orders", "4-NOT SPECIFIED": "Unprioritised orders",
                "5-LOW": "Low-priority orders"},
}
FIXTURE_PORTFOLIO = ["1-urgent", " 5-LOW", "1-URGENT"]
BENCHMARK_O = "3-MEDIUM"
# Chunk size for the chunked chains: small, so that the fixture's ~1,700 bars
# per symbol span several chunks and every chunk boundary is exercised.
CHUNK_ROWS = 256
BENCHMARK_E = "view"


@dataclass(frozen=True)
class Entry:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    out: tuple[str, ...]
    python: bool = False  # has tasks that run this package's Python code


def _spec(out: str) -> tuple[str, ...]:
    return tuple(out.split())


def project(df: DataFrame, out: tuple[str, ...]) -> DataFrame:
    """Select ``out`` with :func:`fixed_round` on doubles, as one JVM-side parsed projection."""
    def one(item: str) -> str:
        name, _, kind = item.partition(":")
        q = f"`{name}`"
        if not kind:
            return q
        scale = f"{10 ** (DECIMALS if kind == 'd' else CORR_DECIMALS)}D"
        return f"round(CAST({q} AS DOUBLE) * {scale}, 0) / {scale} + 0D AS {q}"

    return df.selectExpr(*[one(item) for item in out])


def rnd(x: str, d: int) -> str:
    """DuckDB twin of :func:`tickframe.functions.expr.fixed_round`."""
    scale = f"CAST({10**d} AS DOUBLE)"
    return f"(round(({x}) * {scale}) / {scale} + CAST(0 AS DOUBLE))"


def project_sql(body: str, out: tuple[str, ...]) -> str:
    cols = []
    for item in out:
        name, _, kind = item.partition(":")
        q = f'"{name}"'
        if kind == "d":
            cols.append(f"{rnd(f'CAST({q} AS DOUBLE)', DECIMALS)} AS {q}")
        elif kind == "c":
            cols.append(f"{rnd(f'CAST({q} AS DOUBLE)', CORR_DECIMALS)} AS {q}")
        else:
            cols.append(q)
    return f"WITH {body}\nSELECT {', '.join(cols)} FROM result"


# ---------------------------------------------------------------- Spark side

def bars_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_orders(read_table(spark, sf_dir, "orders", ORDERS_COLUMNS))


def bars_o_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture O for per-symbol aggregates: not clustered by symbol."""
    return bars_from_orders(read_table(spark, sf_dir, "orders", ORDERS_COLUMNS), clustered=False)


def _on_spread(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(bars_o_spread(spark, sf_dir))


def bars_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_events(read_table(spark, sf_dir, "events", EVENTS_COLUMNS))


def bars_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture C: 40 series, the orders of customers in groups by key."""
    orders = read_table(spark, sf_dir, "orders", "o_custkey BIGINT, " + ORDERS_COLUMNS)
    group = F.concat(F.lit("C"), (F.col("o_custkey") % 40).cast("string"))
    return bars_from_orders(orders.withColumn("o_orderpriority", group), clustered=False)


def _on_o(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(bars_o(spark, sf_dir))


def _checkpointed(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """For queries that checkpoint: the session must name a shared folder."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        checkpoint_dir(spark)
        return build(spark, sf_dir)
    return run


def _category(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = category_frame(spark, FIXTURE_CATEGORIES)
    return category_bars(bars_o(spark, sf_dir), dim)


def _pairs(bars: DataFrame, benchmark: str, null_as_zero: bool = False) -> DataFrame:
    return op.benchmark_correlation(bars, benchmark, null_as_zero=null_as_zero)


# Pair list for the pair-list form: each order priority against the next one.
FIXTURE_PAIRS = [("1-URGENT", "2-HIGH"), ("2-HIGH", "3-MEDIUM"), ("3-MEDIUM", "4-NOT SPECIFIED"),
                 ("4-NOT SPECIFIED", "5-LOW"), ("5-LOW", "1-URGENT")]


def _pair_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame(FIXTURE_PAIRS, "symbol_a string, symbol_b string")
    return op.pair_correlation(bars_o(spark, sf_dir), pairs)


def _humanized(bars: DataFrame) -> DataFrame:
    out = bars.groupBy("symbol").agg(F.sum("Volume").alias("total_volume"), F.avg("Volume").alias("avg_volume"))
    return out.withColumn("total_volume_label", humanize_amount("total_volume")).withColumn(
        "avg_volume_label", humanize_amount("avg_volume")
    )


_EXPORT_SCHEMA = T.StructType(
    [T.StructField("Date", T.DateType()), T.StructField("Close", T.DoubleType()),
     T.StructField("Volume", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in EXPORT_COLUMNS[3:]]
    + [T.StructField("symbol", T.StringType())]
)


STORED_TICKER = "2-HIGH"


def _stored_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written once (partitioned by symbol), reloaded for one ticker and one year."""
    base = checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/bars/orders-{uuid.uuid4().hex}"
    bars_o(spark, sf_dir).write.partitionBy("symbol").parquet(path)
    return lookback(load_bars(spark, path, symbols=[STORED_TICKER]), 365)


def _stored_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the last 90 days of bars stored by month."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/bars/months-{uuid.uuid4().hex}"
    bars_o_spread(spark, sf_dir).withColumn("month", F.trunc("Date", "month")).write.partitionBy("month").parquet(path)
    schema = T.StructType([*BAR_SCHEMA.fields, T.StructField("month", T.DateType())])
    return stored_lookback(spark.read.schema(schema).parquet(path), 90)


# A table of portfolios: whose, and the symbols as typed.
FIXTURE_PORTFOLIOS = [("ann", "1-urgent"), ("ann", " 5-LOW"), ("ann", "1-URGENT"), ("bob", "3-MEDIUM")]


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One owner's symbols of a stored portfolio table against bars stored by symbol."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/bars/tracked-{uuid.uuid4().hex}"
    bars_o(spark, sf_dir).write.partitionBy("symbol").parquet(f"{base}/bars")
    spark.createDataFrame(FIXTURE_PORTFOLIOS, "owner string, ticker string").write.parquet(f"{base}/portfolios")
    own = spark.read.parquet(f"{base}/portfolios").filter("owner = 'ann'")
    return tracked_bars(spark.read.schema(BAR_SCHEMA).parquet(f"{base}/bars"), own, "ticker")


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/exports/indicators-{uuid.uuid4().hex}"
    export_indicators(op.technical_indicators(bars_o(spark, sf_dir)), path)
    return spark.read.option("header", True).schema(_EXPORT_SCHEMA).csv(path)


def _merged_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of three loads (interleaved order keys), stored as they come, merged when read."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/bars/states-{uuid.uuid4().hex}"
    orders = read_table(spark, sf_dir, "orders", ORDERS_COLUMNS)
    for load in range(3):
        order_states(orders.filter(F.col("o_orderkey") % 3 == load)).write.mode("append").parquet(path)
    return bars_from_states(merge_states(spark.read.schema(STATE_SCHEMA).parquet(path)))


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of a store that got the history, then the last months, then late rows of all days."""
    store = BarStore(spark, f"{checkpoint_dir(spark).rstrip('/')}/bars/store-{uuid.uuid4().hex}")
    orders = read_table(spark, sf_dir, "orders", ORDERS_COLUMNS)
    late, recent = F.col("o_orderkey") % 101 == 0, F.col("o_orderdate") >= "1998-06-01"
    for part in (~late & ~recent, ~late & recent, late):
        store.append(order_states(orders.filter(part)))
    return store.indicators()


LOW_PRICE = 1e10


def _low_price(bars: DataFrame) -> DataFrame:
    return bars.withColumns({c: F.col(c) / LOW_PRICE for c in PRICE_COLUMNS})


def _relative_macd(df: DataFrame) -> DataFrame:
    return df.withColumns({"macd_rel": F.col("macd_line") / F.col("Close"),
                           "signal_rel": F.col("signal_line") / F.col("Close"), "side": F.signum("macd_histogram")})


def _null_price_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders", ORDERS_COLUMNS)
    return bars_from_orders(orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))))


def _stored_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with dividends (some missing) and splits, written and read back with the wider schema."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/bars/actions-{uuid.uuid4().hex}"
    bars = bars_o_spread(spark, sf_dir).withColumns({
        "Dividends": F.when(F.day("Date") != 1, F.day("Date") / 8.0),
        "Stock_Splits": F.when(F.month("Date") == 6, 2.0).otherwise(0.0)})
    bars.write.parquet(path)
    return load_bars(spark, path, symbols=[*FIXTURE_CATEGORIES["Urgent"], *FIXTURE_CATEGORIES["Routine"]], actions=True)


def _related_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series related to the benchmark by construction: labels of every strength and sign."""
    bars = bars_o(spark, sf_dir).filter(F.col("symbol") == BENCHMARK_O)
    noise = F.when(F.day("Date") % 2 == 0, 1.0).otherwise(-1.0) * 20000.0
    series = {BENCHMARK_O: F.col("Close"), "SAME": F.col("Close") * 2, "OPPOSITE": -F.col("Close"),
              "NOISY": F.col("Close") + noise * 4, "NOISE": noise + F.col("Volume") % 7}
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("close")) for k, v in series.items()]))
    rel = bars.withColumn("_s", parts).withColumn("symbol", F.col("_s.name")).withColumn("Close", F.col("_s.close"))
    return _pairs(rel.drop("_s"), BENCHMARK_O)


# ---------------------------------------------------------------- SQL side

BARS_O_SQL = """bars AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS Date,
         arg_min(o_totalprice, o_orderkey) AS Open, max(o_totalprice) AS High,
         min(o_totalprice) AS Low, arg_max(o_totalprice, o_orderkey) AS Close,
         CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS Volume
  FROM orders GROUP BY 1, 2)"""

BARS_E_SQL = """bars AS (
  SELECT event_type AS symbol, CAST(ts AS DATE) AS Date,
         arg_min(value, (ts, event_id)) AS Open, max(value) AS High,
         min(value) AS Low, arg_max(value, (ts, event_id)) AS Close,
         CAST(count(*) AS BIGINT) AS Volume
  FROM events GROUP BY 1, 2)"""

BARS_C_SQL = BARS_O_SQL.replace("o_orderpriority AS symbol", "'C' || CAST(o_custkey % 40 AS VARCHAR) AS symbol")

_W = {
    "symbol": "PARTITION BY symbol ORDER BY Date",
    "month": "PARTITION BY symbol, date_trunc('month', Date) ORDER BY Date",
    "week": "PARTITION BY symbol, date_trunc('week', Date) ORDER BY Date",
}


def W(scope: str) -> str:
    return f"({_W[scope]})"


def WR(scope: str, rows: int) -> str:
    return f"({_W[scope]} ROWS BETWEEN {rows} PRECEDING AND CURRENT ROW)"


def pct(new: str, old: str) -> str:
    return f"(({new}) - ({old})) / NULLIF(({old}), 0) * 100"


def ln(x: str) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN ln({x}) END)"


def seq_avg(x: str, frame: str) -> str:
    """Frame mean summed oldest to newest, like Spark's sliding frame.

    DuckDB's own windowed ``avg`` sums long frames along a segment tree. Means
    of cent prices are often exact decimal ties at the 5th place (a frame of
    200 bars, or 24 bars whose sum divides by 3), and there the last-bit
    difference of another summation order would decide the rounding.
    """
    return f"(list_sum(list({x}) OVER {frame}) / NULLIF(list_count(list({x}) OVER {frame}), 0))"


def rsi_sql(src: str, dst: str, variant: str = "a", scope: str = "month", period: int = 14) -> str:
    rows = period if variant == "a" else period - 1
    return f"""{dst}_1 AS (SELECT *, Close - lag(Close, 1) OVER {W(scope)} AS price_change FROM {src}),
{dst}_2 AS (SELECT *, CASE WHEN price_change > 0 THEN price_change ELSE CAST(0 AS DOUBLE) END AS gain,
                      CASE WHEN price_change < 0 THEN -price_change ELSE CAST(0 AS DOUBLE) END AS loss FROM {dst}_1),
{dst}_3 AS (SELECT *, {seq_avg('gain', WR(scope, rows))} AS avg_gain, {seq_avg('loss', WR(scope, rows))} AS avg_loss
            FROM {dst}_2),
{dst}_4 AS (SELECT *, avg_gain / NULLIF(avg_loss, 0) AS rs FROM {dst}_3),
{dst} AS (SELECT *, 100 - 100 / (1 + rs) AS rsi FROM {dst}_4)"""


def macd_sql(src: str, dst: str, variant: str = "a", scope: str = "month") -> str:
    """The reference's formulas; a line below 1e-11 of Close is 0, a signal within 1e-13 of the line equals it."""
    line = lambda d: f"CASE WHEN abs({d}) <= CAST(1e-11 AS DOUBLE) * abs(Close) THEN CAST(0 AS DOUBLE) ELSE {d} END"
    snap = lambda x: (f"CASE WHEN abs({x} - macd_line) <= CAST(1e-13 AS DOUBLE) * abs(macd_line) "  # noqa: E731
                      f"THEN macd_line ELSE {x} END")
    if variant == "a":
        return f"""{dst}_1 AS (SELECT *, coalesce(exp({seq_avg(ln('Close'), WR(scope, 12))}), Close) AS ema_12,
                      coalesce(exp({seq_avg(ln('Close'), WR(scope, 26))}), Close) AS ema_26 FROM {src}),
{dst}_2 AS (SELECT *, coalesce({line('(ema_12 - ema_26)')}, CAST(0 AS DOUBLE)) AS macd_line FROM {dst}_1),
{dst}_s AS (SELECT *, exp({seq_avg(ln('abs(macd_line) + CAST(0.00001 AS DOUBLE)'), WR(scope, 9))}) AS sig FROM {dst}_2),
{dst}_3 AS (SELECT *, coalesce({snap('sig')}, macd_line) AS signal_line FROM {dst}_s),
{dst} AS (SELECT *, coalesce(macd_line - signal_line, CAST(0 AS DOUBLE)) AS macd_histogram FROM {dst}_3)"""
    return f"""{dst}_1 AS (SELECT *, exp({seq_avg(ln('Close'), WR(scope, 11))}) AS ema_fast,
                      exp({seq_avg(ln('Close'), WR(scope, 25))}) AS ema_slow FROM {src}),
{dst}_2 AS (SELECT *, {line('(ema_fast - ema_slow)')} AS macd_line FROM {dst}_1),
{dst}_s AS (SELECT *, exp({seq_avg(ln('macd_line'), WR(scope, 8))}) AS sig FROM {dst}_2),
{dst}_3 AS (SELECT *, {snap('sig')} AS signal_line FROM {dst}_s),
{dst} AS (SELECT *, macd_line - signal_line AS macd_histogram FROM {dst}_3)"""


LOW_PRICE_SQL = """low AS (SELECT symbol, Date, Open / CAST(1e10 AS DOUBLE) AS Open, High / CAST(1e10 AS DOUBLE) AS High,
  Low / CAST(1e10 AS DOUBLE) AS Low, Close / CAST(1e10 AS DOUBLE) AS Close, Volume FROM bars)"""

ACTIONS_SQL = """acts AS (SELECT *, CASE WHEN day(Date) <> 1 THEN day(Date) / CAST(8 AS DOUBLE) END AS Dividends,
  CASE WHEN month(Date) = 6 THEN CAST(2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS Stock_Splits FROM bars)"""

# A bar's factor: the product of all later days' factors, multiplied from the last day back.
ADJUST_SQL = """f AS (SELECT *, coalesce(CAST(1 AS DOUBLE) / NULLIF(Stock_Splits, 0), 1) AS split,
  coalesce(CASE WHEN Dividends <> 0 THEN CAST(1 AS DOUBLE) - Dividends / NULLIF(lag(Close, 1) OVER (PARTITION BY symbol
  ORDER BY Date), 0) END, 1) AS dividend FROM acts),
p AS (SELECT *, coalesce(product(split * dividend) OVER later, 1) AS adjust_factor,
  coalesce(product(split) OVER later, 1) AS split_factor FROM f
  WINDOW later AS (PARTITION BY symbol ORDER BY Date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
result AS (SELECT *, Open * adjust_factor AS adjusted_open, High * adjust_factor AS adjusted_high,
  Low * adjust_factor AS adjusted_low, Close * adjust_factor AS adjusted_close,
  Volume / NULLIF(split_factor, 0) AS adjusted_volume FROM p)"""

RELATED_SQL = f"""n AS (SELECT *, CASE WHEN day(Date) % 2 = 0 THEN CAST(20000 AS DOUBLE) ELSE CAST(-20000 AS DOUBLE) END AS noise
  FROM bars WHERE symbol = '{BENCHMARK_O}'),
rel AS (SELECT '{BENCHMARK_O}' AS symbol, Date, Close, Volume, High, Low FROM n
  UNION ALL SELECT 'SAME', Date, Close * 2, Volume, High, Low FROM n
  UNION ALL SELECT 'OPPOSITE', Date, -Close, Volume, High, Low FROM n
  UNION ALL SELECT 'NOISY', Date, Close + noise * 4, Volume, High, Low FROM n
  UNION ALL SELECT 'NOISE', Date, noise + Volume % 7, Volume, High, Low FROM n)"""


def rule_sql(src: str, dst: str) -> str:
    return f"""{dst} AS (SELECT *, CASE WHEN rsi < 30 AND macd_line > signal_line THEN 'Strong Buy'
  WHEN rsi < 40 AND macd_line > signal_line THEN 'Buy' WHEN rsi > 70 AND macd_line < signal_line THEN 'Strong Sell'
  WHEN rsi > 60 AND macd_line < signal_line THEN 'Sell' ELSE 'Hold' END AS trade_signal FROM {src})"""


def bollinger_sql(src: str, dst: str) -> str:
    return f"""{dst}_1 AS (SELECT *, {seq_avg('Close', WR('symbol', 20))} AS bb_middle,
                      stddev_samp(Close) OVER {WR('symbol', 20)} AS bb_std FROM {src}),
{dst} AS (SELECT *, bb_middle + bb_std * CAST(2.0 AS DOUBLE) AS bb_upper,
                    bb_middle - bb_std * CAST(2.0 AS DOUBLE) AS bb_lower FROM {dst}_1)"""


def ma_set_sql(src: str, dst: str, scope: str = "month") -> str:
    cols = ", ".join(f"{seq_avg('Close', WR(scope, n))} AS ma_{n}" for n in (5, 10, 20, 50, 200))
    return f"{dst} AS (SELECT *, {cols} FROM {src})"


def scored_sql(src: str, dst: str, scope: str = "month") -> str:
    w = W(scope)
    lc, lv, lh = f"lag(Close, 1) OVER {w}", f"lag(Volume, 1) OVER {w}", f"lag(macd_histogram, 1) OVER {w}"
    return f"""{ma_set_sql(src, dst + '_ma', scope)},
{dst}_1 AS (SELECT *,
  CASE WHEN Close > ma_10 THEN 2 WHEN Close < ma_10 THEN -2 ELSE 0 END AS signal_short_term,
  CASE WHEN Close > ma_50 THEN CAST(1.5 AS DOUBLE) WHEN Close < ma_50 THEN CAST(-1.5 AS DOUBLE)
       ELSE CAST(0 AS DOUBLE) END AS signal_medium_term,
  CASE WHEN Close > ma_200 THEN 1 WHEN Close < ma_200 THEN -1 ELSE 0 END AS signal_long_term,
  CASE WHEN Close > {lc} THEN 1 WHEN Close < {lc} THEN -1 ELSE 0 END AS price_momentum,
  CASE WHEN rsi < 30 THEN 2 WHEN rsi < 40 THEN 1 WHEN rsi > 70 THEN -2 WHEN rsi > 60 THEN -1 ELSE 0 END AS signal_rsi,
  CASE WHEN macd_line > signal_line AND macd_histogram > {lh} THEN 2
       WHEN macd_line > signal_line THEN 1
       WHEN macd_line < signal_line AND macd_histogram < {lh} THEN -2
       WHEN macd_line < signal_line THEN -1 ELSE 0 END AS signal_macd,
  CASE WHEN Volume > {lv} AND Close > {lc} THEN 1 WHEN Volume > {lv} AND Close < {lc} THEN -1 ELSE 0 END
       AS volume_trend
  FROM {dst}_ma),
{dst}_2 AS (SELECT *, signal_short_term + signal_medium_term + signal_long_term + signal_rsi + signal_macd
                      + price_momentum + volume_trend AS total_signals FROM {dst}_1),
{dst} AS (SELECT *, (total_signals + CAST(10.5 AS DOUBLE)) / CAST(21.0 AS DOUBLE) AS sentiment_strength,
  CASE WHEN total_signals > 3 THEN 'Strongly Bullish' WHEN total_signals > 0 THEN 'Bullish'
       WHEN total_signals < -3 THEN 'Strongly Bearish' WHEN total_signals < 0 THEN 'Bearish'
       ELSE 'Neutral' END AS sentiment FROM {dst}_2)"""


def technical_sql(src: str = "bars", dst: str = "tech") -> str:
    return ",\n".join([
        rsi_sql(src, "ti_rsi", "a"), macd_sql("ti_rsi", "ti_macd", "a"), bollinger_sql("ti_macd", "ti_bb"),
        scored_sql("ti_bb", dst),
    ])


def vol_sql(src: str, dst: str, scope: str = "symbol") -> str:
    lc = f"lag(Close, 1) OVER {W(scope)}"
    return f"""{dst}_1 AS (SELECT *, {pct('Close', lc)} AS daily_change,
  greatest(High - Low, abs(High - {lc}), abs(Low - {lc})) AS true_range FROM {src}),
{dst} AS (SELECT *, stddev_samp(daily_change) OVER {WR(scope, 20)} AS daily_volatility FROM {dst}_1)"""


def period_returns_sql(src: str, dst: str) -> str:
    fw = f"first_value(Close) OVER {WR('week', 5)}"
    fm = f"first_value(Close) OVER {WR('month', 21)}"
    return f"""{dst} AS (SELECT *, {pct('Close', 'Open')} AS intraday_return,
  {pct('Close', fw)} AS weekly_return, {pct('Close', fm)} AS monthly_return FROM {src})"""


def daily_return_sql(src: str, dst: str, scope: str = "symbol") -> str:
    return f"{dst} AS (SELECT *, {pct('Close', f'lag(Close, 1) OVER {W(scope)}')} AS daily_return FROM {src})"


def money_sql(x: str) -> str:
    x = f"CAST({x} AS DOUBLE)"
    units = [(1e12, "T"), (1e9, "B"), (1e6, "M")]
    whens = " ".join(
        f"WHEN {x} >= {lim!r} THEN '$' || printf('%.1f', round({x} / {lim!r}, 1)) || '{s}'" for lim, s in units
    )
    return f"(CASE {whens} ELSE '$' || format('{{:,}}', CAST(round({x}, 0) AS BIGINT)) END)"


def corr_sql(x: str, y: str) -> str:
    x, y = f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)"
    return f"covar_pop({x}, {y}) / NULLIF(stddev_pop({x}) * stddev_pop({y}), 0)"


def pair_sql(benchmark: str, zero: bool = False) -> str:
    z = (lambda e: f"coalesce({e}, CAST(0 AS DOUBLE))") if zero else (lambda e: e)
    metrics = ", ".join(f"{z(corr_sql(f'a.{m}', f'b.{m}'))} AS corr_{m.lower()}" for m in ("Close", "Volume", "High", "Low"))
    return f"""pairs AS (SELECT DISTINCT symbol AS symbol_a, '{benchmark}' AS symbol_b FROM bars WHERE symbol <> '{benchmark}'),
g AS (SELECT p.symbol_a, p.symbol_b, count(*) AS n_days, {metrics}
      FROM bars a JOIN pairs p ON a.symbol = p.symbol_a
      JOIN bars b ON b.symbol = p.symbol_b AND b.Date = a.Date GROUP BY 1, 2),
result AS (SELECT *, (corr_high + corr_low) / 2 AS price_range_corr,
  CASE WHEN corr_close IS NULL THEN NULL
       WHEN abs(corr_close) > 0.7 THEN 'Strong ' || CASE WHEN corr_close > 0 THEN 'positive' ELSE 'negative' END
       WHEN abs(corr_close) > 0.3 THEN 'Moderate ' || CASE WHEN corr_close > 0 THEN 'positive' ELSE 'negative' END
       ELSE 'Weak' END AS correlation_label FROM g)"""


def pair_list_sql() -> str:
    values = ", ".join(f"('{a}', '{b}')" for a, b in FIXTURE_PAIRS)
    metrics = ", ".join(f"{corr_sql(f'a.{m}', f'b.{m}')} AS corr_{m.lower()}" for m in ("Close", "Volume", "High", "Low"))
    return f"""pairs AS (SELECT * FROM (VALUES {values}) t(symbol_a, symbol_b)),
g AS (SELECT p.symbol_a, p.symbol_b, count(*) AS n_days, {metrics}
      FROM bars a JOIN pairs p ON a.symbol = p.symbol_a
      JOIN bars b ON b.symbol = p.symbol_b AND b.Date = a.Date GROUP BY 1, 2),
result AS (SELECT *, (corr_high + corr_low) / 2 AS price_range_corr,
  CASE WHEN corr_close IS NULL THEN NULL
       WHEN abs(corr_close) > 0.7 THEN 'Strong ' || CASE WHEN corr_close > 0 THEN 'positive' ELSE 'negative' END
       WHEN abs(corr_close) > 0.3 THEN 'Moderate ' || CASE WHEN corr_close > 0 THEN 'positive' ELSE 'negative' END
       ELSE 'Weak' END AS correlation_label FROM g)"""


def all_pairs_sql(top: int | None = None) -> str:
    every = pair_sql("").replace("pairs AS (SELECT DISTINCT symbol AS symbol_a, '' AS symbol_b FROM bars WHERE symbol <> '')",
                                 "s AS (SELECT DISTINCT symbol FROM bars),\npairs AS (SELECT a.symbol AS symbol_a, "
                                 "b.symbol AS symbol_b FROM s a JOIN s b ON a.symbol < b.symbol)")
    if top is None:
        return every
    return every.replace("result AS", "whole AS") + f""",
sides AS (SELECT *, unnest([symbol_a, symbol_b]) AS side FROM whole),
best AS (SELECT symbol_a, symbol_b FROM sides QUALIFY row_number() OVER (PARTITION BY side
  ORDER BY abs(corr_close) DESC NULLS LAST, symbol_a, symbol_b) <= {top}),
result AS (SELECT w.* FROM whole w SEMI JOIN best b ON w.symbol_a = b.symbol_a AND w.symbol_b = b.symbol_b)"""


PIVOTS_SQL = """w AS (SELECT *, count(*) OVER f AS n, max(High) OVER f AS top, min(Low) OVER f AS bottom FROM bars
  WINDOW f AS (PARTITION BY symbol ORDER BY Date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
pivots AS (SELECT symbol, Date, 'high' AS kind, High AS price, Volume AS volume FROM w WHERE n = 11 AND High = top
  UNION ALL SELECT symbol, Date, 'low', Low, Volume FROM w WHERE n = 11 AND Low = bottom)"""

LEVELS_SQL = PIVOTS_SQL + """,
g AS (SELECT *, CASE WHEN price < lag(price) OVER line * CAST(1.01 AS DOUBLE) THEN 0 ELSE 1 END AS new FROM pivots
  WHERE price > 0 WINDOW line AS (PARTITION BY symbol, kind ORDER BY price)),
l AS (SELECT *, sum(new) OVER (PARTITION BY symbol, kind ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  AS nr FROM g),
result AS (SELECT symbol, CASE kind WHEN 'high' THEN 'resistance' ELSE 'support' END AS kind, avg(price) AS level,
  min(price) AS low, max(price) AS high, count(*) AS strength, min(Date) AS first_touch, max(Date) AS last_touch
  FROM l GROUP BY symbol, l.kind, nr)"""

DIVERGENCE_SQL = PIVOTS_SQL + """,
p AS (SELECT *, lag(Date) OVER line AS previous_date, lag(price) OVER line AS previous_price,
  lag(volume) OVER line AS previous_volume FROM pivots WINDOW line AS (PARTITION BY symbol, kind ORDER BY Date)),
result AS (SELECT *, CASE WHEN previous_price IS NULL OR volume IS NULL OR previous_volume IS NULL THEN NULL
  WHEN kind = 'high' AND price > previous_price THEN
    CASE WHEN volume < previous_volume THEN 'Bearish divergence' ELSE 'Confirmed' END
  WHEN kind = 'low' AND price < previous_price THEN
    CASE WHEN volume < previous_volume THEN 'Bullish divergence' ELSE 'Confirmed' END ELSE 'None' END AS divergence FROM p)"""


PROFILE_SQL = """r AS (SELECT symbol, min(Close) AS lo, max(Close) AS hi FROM bars GROUP BY symbol),
b AS (SELECT b.symbol, Volume, lo, hi, CASE WHEN hi > lo THEN least(CAST(floor((Close - lo) / (hi - lo) * 12) AS INTEGER), 11)
  ELSE 0 END AS bin FROM bars b JOIN r ON b.symbol = r.symbol WHERE Close IS NOT NULL AND Volume IS NOT NULL),
g AS (SELECT symbol, bin, lo, hi, count(*) AS days, CAST(sum(Volume) AS BIGINT) AS volume FROM b GROUP BY symbol, bin, lo, hi),
result AS (SELECT symbol, bin, lo + (hi - lo) / 12 * bin AS low, lo + (hi - lo) / 12 * (bin + 1) AS high, days, volume,
  CAST(volume AS DOUBLE) / NULLIF(sum(volume) OVER (PARTITION BY symbol), 0) * 100 AS share,
  row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, bin) = 1 AS is_peak FROM g)"""


def edge_sql(n: int, desc: bool) -> str:
    order = "Date DESC" if desc else "Date"
    return f"result AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY {order}) <= {n})"


def sentiment_sql(desc: bool) -> str:
    order = "Date DESC" if desc else "Date"
    return f"""{daily_return_sql('bars', 'd0')},
d AS (SELECT symbol, Volume, daily_return, row_number() OVER (PARTITION BY symbol ORDER BY {order}) AS rn FROM d0),
g AS (SELECT symbol, coalesce(avg(CASE WHEN rn <= 10 THEN daily_return END), CAST(0 AS DOUBLE)) AS avg_recent_return,
             coalesce(avg(CASE WHEN rn <= 5 THEN Volume END), CAST(0 AS DOUBLE)) AS avg_recent_volume,
             avg(Volume) AS avg_volume FROM d GROUP BY symbol),
result AS (SELECT *, CASE WHEN avg_recent_return > 0 THEN 'Bullish' ELSE 'Bearish' END AS price_trend,
  CASE WHEN avg_recent_volume > avg_volume THEN 'Increasing' ELSE 'Decreasing' END AS volume_trend FROM g)"""


def _cat_values() -> str:
    rows = []
    for cat, members in FIXTURE_CATEGORIES.items():
        rows += [f"('{cat}', '{s}', '{n}')" for s, n in members.items()]
    return ", ".join(rows)


BAR_OUT = "symbol Date Open:d High:d Low:d Close:d Volume"
TECH_OUT = ("symbol Date Close:d Volume rsi:d macd_line:d signal_line:d macd_histogram:d bb_middle:d bb_upper:d "
            "bb_lower:d ma_5:d ma_10:d ma_20:d ma_50:d ma_200:d signal_short_term signal_medium_term:d "
            "signal_long_term signal_rsi signal_macd total_signals:d sentiment_strength:d sentiment")

_stats_out = " ".join(
    f"{c}_mean:d {c}_stddev:d {c}_min{':d' if c != 'Volume' else ''} {c}_max{':d' if c != 'Volume' else ''}"
    for c in ("Open", "High", "Low", "Close", "Volume")
)
_stats_sql = ", ".join(
    f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_stddev, min({c}) AS {c}_min, max({c}) AS {c}_max"
    for c in ("Open", "High", "Low", "Close", "Volume")
)
_ACTIONS = ("Dividends", "Stock_Splits")
_action_stats_out = " ".join(f"{c}_mean:d {c}_stddev:d {c}_min:d {c}_max:d" for c in _ACTIONS)
_action_stats_sql = ", ".join(
    f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_stddev, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in _ACTIONS
)
_missing_sql = ", ".join(
    f"CAST(count_if({c} IS NULL) AS BIGINT) AS {c}_missing" for c in ("Date", "Open", "High", "Low", "Close", "Volume")
)

_FREQ_SQL = f"""{BARS_O_SQL},
g AS (SELECT symbol, CAST(Date - lag(Date, 1) OVER {W('month')} AS INTEGER) AS gap_days FROM bars),
c AS (SELECT symbol, gap_days, count(*) AS n FROM g GROUP BY 1, 2),
m AS (SELECT symbol, gap_days FROM c
      QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY (gap_days IS NULL), n DESC, gap_days) = 1),
result AS (SELECT symbol, gap_days, CASE WHEN gap_days IS NULL THEN NULL WHEN gap_days = 1 THEN 'Daily'
  WHEN gap_days = 7 THEN 'Weekly' WHEN gap_days = 30 THEN 'Monthly' WHEN gap_days = 365 THEN 'Yearly'
  ELSE 'Custom (' || CAST(gap_days AS VARCHAR) || ' days)' END AS frequency FROM m)"""

_BOX_SQL = f"""{BARS_O_SQL},
{period_returns_sql('bars', 'pr')},
long AS (SELECT symbol, 'intraday_return' AS return_type, intraday_return AS value FROM pr
         UNION ALL SELECT symbol, 'weekly_return', weekly_return FROM pr
         UNION ALL SELECT symbol, 'monthly_return', monthly_return FROM pr),
lv AS (SELECT * FROM long WHERE value IS NOT NULL),
q AS (SELECT symbol, return_type, count(value) AS n, quantile_cont(value, 0.25) AS q1,
             quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM lv GROUP BY 1, 2),
q2 AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q),
result AS (SELECT q2.symbol, q2.return_type, n, q1, median, q3, iqr, lower_fence, upper_fence,
  min(CASE WHEN value >= lower_fence AND value <= upper_fence THEN value END) AS whisker_low,
  max(CASE WHEN value >= lower_fence AND value <= upper_fence THEN value END) AS whisker_high,
  CAST(count_if(NOT (value >= lower_fence AND value <= upper_fence)) AS BIGINT) AS n_outliers
  FROM lv JOIN q2 ON lv.symbol = q2.symbol AND lv.return_type = q2.return_type
  GROUP BY q2.symbol, q2.return_type, n, q1, median, q3, iqr, lower_fence, upper_fence)"""

_SUMMARY_SQL = f"""{BARS_O_SQL},
{vol_sql('bars', 'v0')},
v AS (SELECT *, {pct('Close', 'lag(Close, 10) OVER ' + W('symbol'))} AS momentum_10d FROM v0),
g AS (SELECT symbol, max(Date) AS Date, avg(Close) AS avg_price, avg(Volume) AS avg_volume,
             arg_max_null(Close, Date) AS latest_close, arg_max_null(Volume, Date) AS latest_volume,
             arg_max_null(daily_volatility, Date) AS daily_volatility,
             arg_max_null(momentum_10d, Date) AS momentum_10d, avg(true_range) AS avg_true_range
      FROM v GROUP BY symbol),
g2 AS (SELECT *, {pct('latest_close', 'avg_price')} AS price_vs_avg, {pct('latest_volume', 'avg_volume')} AS volume_vs_avg
       FROM g),
result AS (SELECT *,
  CASE WHEN price_vs_avg > 0 THEN 'above' WHEN price_vs_avg <= 0 THEN 'below' END AS price_position,
  CASE WHEN volume_vs_avg > 0 THEN 'above' WHEN volume_vs_avg <= 0 THEN 'below' END AS volume_position,
  CASE WHEN daily_volatility IS NULL THEN NULL WHEN daily_volatility > 2 THEN 'high'
       WHEN daily_volatility > 1 THEN 'moderate' ELSE 'low' END AS volatility_level FROM g2)"""

_LATEST_SQL = f"""{BARS_O_SQL},
{technical_sql('bars', 'tech')},
last AS (SELECT * FROM tech QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY Date DESC) = 1),
l2 AS (SELECT *, (Close - bb_lower) / NULLIF(bb_upper - bb_lower, 0) * 100 AS bb_position,
              coalesce(macd_line, CAST(0 AS DOUBLE)) AS macd_value,
              coalesce(signal_line, CAST(0 AS DOUBLE)) AS signal_value FROM last),
result AS (SELECT symbol, Date, Close, sentiment, sentiment_strength,
  CASE WHEN signal_short_term > 0 THEN 'Bullish' ELSE 'Bearish' END AS short_term_trend,
  CASE WHEN signal_medium_term > 0 THEN 'Bullish' ELSE 'Bearish' END AS medium_term_trend,
  CASE WHEN signal_long_term > 0 THEN 'Bullish' ELSE 'Bearish' END AS long_term_trend,
  CASE WHEN signal_rsi > 0 THEN 'Oversold (Bullish)' WHEN signal_rsi < 0 THEN 'Overbought (Bearish)'
       ELSE 'Neutral' END AS rsi_signal,
  CASE WHEN signal_macd > 0 THEN 'Bullish' ELSE 'Bearish' END AS macd_signal,
  CASE WHEN Close > ma_200 THEN 'Above' WHEN Close <= ma_200 THEN 'Below' END AS vs_ma_200,
  CASE WHEN Close > ma_50 THEN 'Above' WHEN Close <= ma_50 THEN 'Below' END AS vs_ma_50,
  CASE WHEN Close > ma_10 THEN 'Above' WHEN Close <= ma_10 THEN 'Below' END AS vs_ma_10,
  rsi, CASE WHEN rsi IS NULL THEN NULL WHEN rsi < 30 THEN 'Oversold' WHEN rsi > 70 THEN 'Overbought'
            ELSE 'Neutral' END AS rsi_level,
  macd_value, signal_value, CASE WHEN macd_value > signal_value THEN 'Bullish' ELSE 'Bearish' END AS macd_cross,
  bb_position, CASE WHEN bb_position IS NULL THEN NULL WHEN bb_position < 20 THEN 'Oversold'
                    WHEN bb_position > 80 THEN 'Overbought' ELSE 'Neutral' END AS bb_signal FROM l2)"""


def _o(body: str) -> str:
    return f"{BARS_O_SQL},\n{body}"


def _entries() -> dict[str, Entry]:
    E = {}

    def add(name, build, sql, out, python=False):
        E[name] = Entry(build, sql, _spec(out), python)

    # S10 sources
    add("bars_orders", bars_o, f"{BARS_O_SQL},\nresult AS (SELECT * FROM bars)", BAR_OUT)
    add("bars_events", bars_e, f"{BARS_E_SQL},\nresult AS (SELECT * FROM bars)", BAR_OUT)
    add("bars_merged_loads", _merged_loads, f"{BARS_O_SQL},\nresult AS (SELECT * FROM bars)", BAR_OUT)
    # S3, S4 look-back
    add("lookback_90d", _on_o(lambda b: lookback(b, 90)),
        _o("e AS (SELECT *, max(Date) OVER (PARTITION BY symbol) + 1 AS as_of FROM bars),\n"
           "result AS (SELECT * FROM e WHERE Date >= as_of - 90 AND Date < as_of)"), BAR_OUT)
    add("lookback_ytd", _on_o(lookback_ytd),
        _o("e AS (SELECT *, max(Date) OVER (PARTITION BY symbol) + 1 AS as_of FROM bars),\n"
           "result AS (SELECT * FROM e WHERE Date >= date_trunc('year', as_of - 1) AND Date < as_of)"), BAR_OUT)
    add("lookback_90d_stored", _stored_lookback, E["lookback_90d"].sql, BAR_OUT)
    add("stored_bars_ticker", _stored_ticker,
        _o("e AS (SELECT *, max(Date) OVER (PARTITION BY symbol) + 1 AS as_of FROM bars"
           f" WHERE symbol = '{STORED_TICKER}'),\n"
           "result AS (SELECT * FROM e WHERE Date >= as_of - 365 AND Date < as_of)"), BAR_OUT)
    # S5, S6 dimension joins
    add("category_bars", _category,
        _o(f"dim AS (SELECT * FROM (VALUES {_cat_values()}) t(category, symbol, company)),\n"
           "result AS (SELECT b.*, d.category, d.company FROM bars b JOIN dim d ON b.symbol = d.symbol)"),
        BAR_OUT + " category company")
    add("portfolio_bars", _on_o(lambda b: portfolio_bars(b, FIXTURE_PORTFOLIO)),
        _o("result AS (SELECT * FROM bars WHERE symbol IN ('1-URGENT', '5-LOW'))"), BAR_OUT)
    add("portfolio_bars_stored", _tracked, E["portfolio_bars"].sql, BAR_OUT)
    # L1-L3 previews
    add("preview_first40", _on_o(lambda b: op.preview_first(b, 40)), _o(edge_sql(40, False)), BAR_OUT)
    add("preview_last40", _on_o(lambda b: op.preview_last(b, 40)), _o(edge_sql(40, True)), BAR_OUT)
    add("recent_ma", _on_o(op.recent_ma),
        _o(f"m AS (SELECT symbol, Date, Close, {seq_avg('Close', WR('symbol', 4))} AS Close_MA_5,"
           f" {seq_avg('Close', WR('symbol', 19))} AS Close_MA_20, {seq_avg('Close', WR('symbol', 49))} AS Close_MA_50"
           " FROM bars),\nresult AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY Date DESC) <= 5)"),
        "symbol Date Close:d Close_MA_5:d Close_MA_20:d Close_MA_50:d")
    # A1-A3 profile
    add("basic_stats", _on_spread(op.basic_stats),
        _o(f"result AS (SELECT symbol, {_stats_sql} FROM bars GROUP BY symbol)"), "symbol " + _stats_out)
    add("missing_counts", _on_spread(op.missing_counts),
        _o(f"result AS (SELECT symbol, {_missing_sql} FROM bars GROUP BY symbol)"),
        "symbol Date_missing Open_missing High_missing Low_missing Close_missing Volume_missing")
    add("data_frequency", _on_o(op.data_frequency), _FREQ_SQL, "symbol gap_days frequency")
    # W1-W4, A4, A17 returns
    add("intraday_return", _on_o(op.intraday_return),
        _o(f"result AS (SELECT *, {pct('Close', 'Open')} AS intraday_return FROM bars)"),
        "symbol Date intraday_return:d")
    add("daily_return", _on_o(op.daily_return), _o(daily_return_sql("bars", "result")), "symbol Date daily_return:d")
    add("period_returns", _on_o(op.period_returns), _o(period_returns_sql("bars", "result")),
        "symbol Date intraday_return:d weekly_return:d monthly_return:d")
    add("returns_summary", _on_o(op.returns_summary),
        _o(period_returns_sql("bars", "pr") + ",\nresult AS (SELECT symbol, "
           + ", ".join(f"avg({k}_return) AS avg_{k}_return, stddev_samp({k}_return) AS {k}_return_volatility"
                       for k in ("intraday", "weekly", "monthly")) + " FROM pr GROUP BY symbol)"),
        "symbol avg_intraday_return:d intraday_return_volatility:d avg_weekly_return:d weekly_return_volatility:d "
        "avg_monthly_return:d monthly_return_volatility:d")
    add("returns_boxplot", _on_o(op.returns_boxplot), _BOX_SQL,
        "symbol return_type n q1:d median:d q3:d iqr:d lower_fence:d upper_fence:d whisker_low:d whisker_high:d "
        "n_outliers")
    add("returns_boxplot_bounded", _checkpointed(_on_o(lambda b: op.returns_boxplot(b, bounded=True))), _BOX_SQL,
        " ".join(E["returns_boxplot"].out))
    # W5, W6 trend
    add("moving_averages", _on_o(op.moving_averages),
        _o(f"result AS (SELECT *, {seq_avg('Close', WR('symbol', 4))} AS Close_MA_5,"
           f" {seq_avg('Close', WR('symbol', 19))} AS Close_MA_20, {seq_avg('Close', WR('symbol', 49))} AS Close_MA_50"
           " FROM bars)"),
        "symbol Date Close:d Close_MA_5:d Close_MA_20:d Close_MA_50:d")
    add("ma_cross", _on_o(op.ma_cross),
        _o(f"m AS (SELECT *, {seq_avg('Close', WR('symbol', 4))} AS Close_MA_5,"
           f" {seq_avg('Close', WR('symbol', 19))} AS Close_MA_20 FROM bars),\n"
           f"m2 AS (SELECT *, lag(Close_MA_5, 1) OVER {W('symbol')} AS ps, lag(Close_MA_20, 1) OVER {W('symbol')} AS pl"
           " FROM m),\nresult AS (SELECT *, CASE WHEN Close_MA_5 > Close_MA_20 AND ps <= pl THEN 'Golden Cross (Buy)'"
           " WHEN Close_MA_5 < Close_MA_20 AND ps >= pl THEN 'Death Cross (Sell)' ELSE 'No Signal' END"
           " AS ma_cross_signal FROM m2)"),
        "symbol Date Close_MA_5:d Close_MA_20:d ma_cross_signal")
    # W7-W9, A12 volatility
    add("true_range", _on_o(op.volatility_metrics), _o(vol_sql("bars", "result")),
        "symbol Date daily_change:d true_range:d")
    add("rolling_volatility", _on_o(op.volatility_metrics), _o(vol_sql("bars", "result")),
        "symbol Date daily_volatility:d")
    add("avg_true_range", _on_o(op.avg_true_range),
        _o(vol_sql("bars", "v") + ",\nresult AS (SELECT symbol, avg(true_range) AS avg_true_range FROM v GROUP BY symbol)"),
        "symbol avg_true_range:d")
    # W13, W17 Bollinger
    add("bollinger", _on_o(op.bollinger_bands), _o(bollinger_sql("bars", "result")),
        "symbol Date Close:d bb_middle:d bb_std:d bb_upper:d bb_lower:d")
    add("bollinger_position", _on_o(op.bollinger_position),
        _o(bollinger_sql("bars", "bb") + ",\nlast AS (SELECT * FROM bb QUALIFY row_number() OVER "
           "(PARTITION BY symbol ORDER BY Date DESC) = 1),\n"
           "l2 AS (SELECT *, (Close - bb_lower) / NULLIF(bb_upper - bb_lower, 0) * 100 AS bb_position FROM last),\n"
           "result AS (SELECT *, CASE WHEN bb_position IS NULL THEN NULL WHEN bb_position < 20 THEN 'Oversold' "
           "WHEN bb_position > 80 THEN 'Overbought' ELSE 'Neutral' END AS bb_signal FROM l2)"),
        "symbol Date Close:d bb_lower:d bb_middle:d bb_upper:d bb_position:d bb_signal")
    explore_sql = _o(vol_sql("bars", "v") + ",\nresult AS (SELECT *, "
                     + pct("Close", "lag(Close, 10) OVER " + W("symbol")) + " AS momentum_10d, "
                     + ", ".join(f"{seq_avg('Close', WR('symbol', n - 1))} AS Close_MA_{n}" for n in (5, 20, 50))
                     + " FROM v)")
    explore_out = ("symbol Date daily_change:d true_range:d daily_volatility:d momentum_10d:d Close_MA_5:d "
                   "Close_MA_20:d Close_MA_50:d")
    add("exploration_indicators", _on_o(op.exploration_indicators), explore_sql, explore_out)
    add("exploration_indicators_chunked",
        _checkpointed(_on_o(lambda b: op.exploration_indicators(b, chunk_rows=CHUNK_ROWS))),
        explore_sql, explore_out)
    # W10, W16
    add("momentum_10d", _on_o(op.momentum),
        _o(f"result AS (SELECT *, {pct('Close', 'lag(Close, 10) OVER ' + W('symbol'))} AS momentum_10d FROM bars)"),
        "symbol Date momentum_10d:d")
    add("rebase_100", _on_o(op.rebase),
        _o("result AS (SELECT *, Close / NULLIF(first_value(Close) OVER (PARTITION BY symbol ORDER BY Date "
           "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) * 100.0 AS rebased FROM bars)"),
        "symbol Date rebased:d")
    # W11, W12 oscillators
    add("rsi_plus_one", _on_o(lambda b: op.rsi(b, variant="a")), _o(rsi_sql("bars", "result", "a")),
        "symbol Date price_change:d gain:d loss:d avg_gain:d avg_loss:d rs:d rsi:d")
    add("rsi_exact", _on_o(lambda b: op.rsi(b, variant="b")), _o(rsi_sql("bars", "result", "b")),
        "symbol Date rsi:d")
    add("macd_robust", _on_o(lambda b: op.macd(b, variant="a")), _o(macd_sql("bars", "result", "a")),
        "symbol Date ema_12:d ema_26:d macd_line:d signal_line:d macd_histogram:d")
    add("macd_plain", _on_o(lambda b: op.macd(b, variant="b")), _o(macd_sql("bars", "result", "b")),
        "symbol Date macd_line:d signal_line:d macd_histogram:d")
    # W14, W15, W18, W19 signals
    add("ma_set", _on_o(op.ma_set), _o(ma_set_sql("bars", "result")),
        "symbol Date ma_5:d ma_10:d ma_20:d ma_50:d ma_200:d")
    add("scored_signals", _on_o(op.technical_indicators), _o(technical_sql("bars", "result")), TECH_OUT)
    add("scored_signals_events", lambda s, d: op.technical_indicators(bars_e(s, d)),
        f"{BARS_E_SQL},\n{technical_sql('bars', 'result')}", TECH_OUT)
    add("rule_signals_events", lambda s, d: op.rule_signals(bars_e(s, d)),
        f"{BARS_E_SQL},\n" + rsi_sql("bars", "rr", "b") + ",\n" + macd_sql("rr", "rm", "b") + ",\n"
        "result AS (SELECT *, CASE WHEN rsi < 30 AND macd_line > signal_line THEN 'Strong Buy' "
        "WHEN rsi < 40 AND macd_line > signal_line THEN 'Buy' WHEN rsi > 70 AND macd_line < signal_line "
        "THEN 'Strong Sell' WHEN rsi > 60 AND macd_line < signal_line THEN 'Sell' ELSE 'Hold' END "
        "AS trade_signal FROM rm)",
        "symbol Date rsi:d macd_line:d signal_line:d macd_histogram:d trade_signal")
    add("rule_signals", _on_o(op.rule_signals),
        _o(rsi_sql("bars", "rr", "b") + ",\n" + macd_sql("rr", "rm", "b") + ",\n"
           "result AS (SELECT *, CASE WHEN rsi < 30 AND macd_line > signal_line THEN 'Strong Buy' "
           "WHEN rsi < 40 AND macd_line > signal_line THEN 'Buy' WHEN rsi > 70 AND macd_line < signal_line "
           "THEN 'Strong Sell' WHEN rsi > 60 AND macd_line < signal_line THEN 'Sell' ELSE 'Hold' END "
           "AS trade_signal FROM rm)"),
        "symbol Date rsi:d macd_line:d signal_line:d macd_histogram:d trade_signal")
    add("latest_report", _on_o(op.latest_report), _LATEST_SQL,
        "symbol Date Close:d sentiment sentiment_strength:d short_term_trend medium_term_trend long_term_trend "
        "rsi_signal macd_signal vs_ma_200 vs_ma_50 vs_ma_10 rsi:d rsi_level macd_value:d signal_value:d "
        "macd_cross bb_position:d bb_signal")
    # J1, A5-A7 correlation
    pair_out = ("symbol_a symbol_b n_days corr_close:c corr_volume:c corr_high:c corr_low:c price_range_corr:c "
                "correlation_label")
    add("pair_correlation", _on_o(lambda b: _pairs(b, BENCHMARK_O)), _o(pair_sql(BENCHMARK_O)), pair_out)
    add("pair_correlation_events", lambda s, d: _pairs(bars_e(s, d), BENCHMARK_E),
        f"{BARS_E_SQL},\n{pair_sql(BENCHMARK_E)}", pair_out)
    add("pair_correlation_list", _pair_list, _o(pair_list_sql()), pair_out)
    add("pair_correlation_label", lambda s, d: _pairs(bars_e(s, d), BENCHMARK_E),
        f"{BARS_E_SQL},\n{pair_sql(BENCHMARK_E)}", "symbol_a symbol_b corr_close:c price_range_corr:c correlation_label")
    add("pair_correlation_zero", _on_o(lambda b: _pairs(b, BENCHMARK_O, null_as_zero=True)),
        _o(pair_sql(BENCHMARK_O, zero=True)), pair_out)
    # J1, all pairs of 40 series (customers of orders in groups), in tiles of 8 x 8 series
    add("all_pairs_correlation", _checkpointed(lambda s, d: op.all_pairs_correlation(bars_c(s, d), block=8)),
        f"{BARS_C_SQL},\n{all_pairs_sql()}", pair_out, python=True)
    add("all_pairs_top3", _checkpointed(lambda s, d: op.all_pairs_correlation(bars_c(s, d), top=3, block=8)),
        f"{BARS_C_SQL},\n{all_pairs_sql(3)}", pair_out, python=True)
    # prices far below 1: float noise is judged relative to the price
    add("macd_plain_lowprice", _on_o(lambda b: _relative_macd(op.macd(_low_price(b), variant="b"))),
        _o(LOW_PRICE_SQL + ",\n" + macd_sql("low", "m", "b") + ",\n"
           "result AS (SELECT *, macd_line / Close AS macd_rel, signal_line / Close AS signal_rel, CAST(sign(macd_histogram) AS DOUBLE) AS side FROM m)"),
        "symbol Date macd_rel:c signal_rel:c side:d")
    add("rule_signals_lowprice", _on_o(lambda b: op.rule_signals(_low_price(b))),
        _o(LOW_PRICE_SQL + ",\n" + rsi_sql("low", "rr", "b") + ",\n" + macd_sql("rr", "rm", "b") + ",\n"
           + rule_sql("rm", "result")), "symbol Date rsi:d trade_signal")
    add("scored_signals_lowprice", _on_o(lambda b: op.technical_indicators(_low_price(b))),
        _o(LOW_PRICE_SQL + ",\n" + technical_sql("low", "result")),
        "symbol Date rsi:d signal_rsi signal_macd total_signals:d sentiment_strength:d sentiment")
    add("rule_signals_given", _on_o(lambda b: op.rule_signals(op.rsi(b, variant="a"), include_indicators=["macd"])),
        _o(rsi_sql("bars", "rr", "a") + ",\n" + macd_sql("rr", "rm", "b") + ",\n" + rule_sql("rm", "result")),
        "symbol Date rsi:d macd_line:d signal_line:d trade_signal")
    # S10 with missing prices, S2 with corporate actions, S7 in data
    add("bars_orders_nulls", _null_price_bars,
        "bars AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS Date, arg_min(p, o_orderkey) AS Open, "
        "max(p) AS High, min(p) AS Low, arg_max(p, o_orderkey) AS Close, "
        "CAST(sum(CAST(floor(p) AS BIGINT)) AS BIGINT) AS Volume FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 "
        "THEN o_totalprice END AS p FROM orders) GROUP BY 1, 2),\nresult AS (SELECT * FROM bars)", BAR_OUT)
    actions = _o(ACTIONS_SQL)
    add("basic_stats_actions", lambda s, d: op.basic_stats(_stored_actions(s, d)),
        f"{actions},\nresult AS (SELECT symbol, {_stats_sql}, {_action_stats_sql} FROM acts GROUP BY symbol)",
        f"symbol {_stats_out} {_action_stats_out}")
    add("missing_counts_actions", lambda s, d: op.missing_counts(_stored_actions(s, d)),
        f"{actions},\nresult AS (SELECT symbol, {_missing_sql}, CAST(count_if(Dividends IS NULL) AS BIGINT) AS "
        "Dividends_missing, CAST(count_if(Stock_Splits IS NULL) AS BIGINT) AS Stock_Splits_missing FROM acts "
        "GROUP BY symbol)",
        "symbol Date_missing Open_missing High_missing Low_missing Close_missing Volume_missing Dividends_missing "
        "Stock_Splits_missing")
    add("portfolio_bars_mixed_case",
        _on_o(lambda b: portfolio_bars(b.withColumn("symbol", F.initcap(F.lower("symbol"))), FIXTURE_PORTFOLIO)),
        _o("result AS (SELECT * REPLACE (CASE symbol WHEN '1-URGENT' THEN '1-urgent' ELSE '5-low' END AS symbol) "
           "FROM bars WHERE symbol IN ('1-URGENT', '5-LOW'))"), BAR_OUT)
    # §2.11 adjustment for splits and dividends, plain and on chunks
    adjust_sql = f"{actions},\n{ADJUST_SQL}"
    adjust_out = ("symbol Date Close:d adjust_factor:c adjusted_open:d adjusted_high:d adjusted_low:d adjusted_close:d "
                  "adjusted_volume:d")
    add("adjusted_close", lambda s, d: op.adjust_prices(_stored_actions(s, d)), adjust_sql, adjust_out)
    add("adjusted_close_chunked", lambda s, d: op.adjust_prices(_stored_actions(s, d), chunk_rows=CHUNK_ROWS),
        adjust_sql, adjust_out)
    # P5, drop missing, S3 with a given end, presets
    add("keep_columns", _on_o(lambda b: op.keep_columns(b, ["Close", "Date", "symbol", "absent"])),
        _o("result AS (SELECT symbol, Date, Close FROM bars)"), "symbol Date Close:d")
    add("drop_missing", _on_o(lambda b: op.drop_missing(op.daily_return(b), ["daily_return"])),
        _o(daily_return_sql("bars", "d") + ",\nresult AS (SELECT * FROM d WHERE daily_return IS NOT NULL)"),
        "symbol Date Close:d daily_return:d")
    add("lookback_as_of", _on_o(lambda b: lookback(b, 180, as_of="1998-07-01")),
        _o("result AS (SELECT * FROM bars WHERE Date >= DATE '1998-07-01' - 180 AND Date < DATE '1998-07-01')"), BAR_OUT)
    add("lookback_preset", _on_o(lambda b: lookback(b, "5 Years")),
        _o("e AS (SELECT *, max(Date) OVER (PARTITION BY symbol) + 1 AS as_of FROM bars),\n"
           "result AS (SELECT * FROM e WHERE Date >= as_of - 1825 AND Date < as_of)"), BAR_OUT)
    add("pair_correlation_strength", _related_pairs, _o(RELATED_SQL + ",\n" + pair_sql(BENCHMARK_O).replace(
        "FROM bars", "FROM rel").replace("JOIN bars", "JOIN rel")), pair_out)
    # A8-A11 summaries
    add("high_volume_ratio", _on_o(op.high_volume_ratio),
        _o("a AS (SELECT symbol, Volume, avg(Volume) OVER (PARTITION BY symbol) AS avg_volume FROM bars),\n"
           "result AS (SELECT symbol, max(avg_volume) AS avg_volume,"
           " CAST(count_if(Volume > avg_volume * CAST(1.5 AS DOUBLE)) AS BIGINT) AS high_volume_days,"
           " count(*) AS total_days,"
           " CAST(count_if(Volume > avg_volume * CAST(1.5 AS DOUBLE)) AS DOUBLE) * CAST(100.0 AS DOUBLE)"
           " / NULLIF(count(*), 0) AS high_volume_ratio FROM a GROUP BY symbol)"),
        "symbol avg_volume:d high_volume_days total_days high_volume_ratio:d")
    add("summary_position", _on_o(op.summary_position), _SUMMARY_SQL,
        "symbol Date avg_price:d avg_volume:d latest_close:d latest_volume daily_volatility:d momentum_10d:d "
        "avg_true_range:d price_vs_avg:d volume_vs_avg:d price_position volume_position volatility_level")
    # A15
    card_out = "symbol avg_recent_return:d avg_recent_volume:d avg_volume:d price_trend volume_trend"
    add("sentiment_card_last", _on_o(lambda b: op.sentiment_card(b, "last")), _o(sentiment_sql(True)), card_out)
    add("sentiment_card_first", _on_o(lambda b: op.sentiment_card(b, "first")), _o(sentiment_sql(False)), card_out)
    # A13, A14
    season_body = (daily_return_sql("bars", "d") + ",\nresult AS (SELECT symbol, CAST(month(Date) AS INTEGER) AS month,"
                   " avg(daily_return) AS avg_return, stddev_samp(daily_return) AS return_volatility,"
                   " count(*) AS days_counted{extra} FROM d GROUP BY 1, 2)")
    add("seasonality", _on_o(op.seasonality), _o(season_body.format(extra="")),
        "symbol month avg_return:d return_volatility:d days_counted")
    add("seasonality_named", _on_o(lambda b: op.seasonality(b, named=True)),
        _o(season_body.format(extra=", monthname(make_date(2000, CAST(month(Date) AS INTEGER), 1)) AS month_name")),
        "symbol month month_name avg_return:d return_volatility:d days_counted")
    # A16, money format
    add("quote_change", _on_o(op.quote_change),
        _o("r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY Date DESC) AS rn FROM bars),\n"
           "g AS (SELECT symbol, max(CASE WHEN rn = 1 THEN Date END) AS Date,"
           " max(CASE WHEN rn = 1 THEN Close END) AS current_price,"
           " max(CASE WHEN rn = 2 THEN Close END) AS previous_close,"
           " max(CASE WHEN rn = 1 THEN Volume END) AS volume FROM r WHERE rn <= 2 GROUP BY symbol),\n"
           f"result AS (SELECT *, coalesce({pct('current_price', 'previous_close')}, CAST(0 AS DOUBLE))"
           " AS price_change_pct FROM g)"),
        "symbol Date current_price:d previous_close:d volume price_change_pct:d")
    add("humanized_volume", _on_spread(_humanized),
        _o("g AS (SELECT symbol, CAST(sum(Volume) AS BIGINT) AS total_volume, avg(Volume) AS avg_volume"
           " FROM bars GROUP BY symbol),\n"
           f"result AS (SELECT *, {money_sql('total_volume')} AS total_volume_label,"
           f" {money_sql('avg_volume')} AS avg_volume_label FROM g)"),
        "symbol total_volume total_volume_label avg_volume:d avg_volume_label")
    # Stored bars and indicators updated in parts
    add("incremental_indicators", _incremental, _o(technical_sql("bars", "result")), TECH_OUT)
    # S8 sink, written and read back
    add("export_indicators", _export, _o(technical_sql("bars", "result")),
        "symbol Date Close:d Volume rsi:d macd_line:d signal_line:d macd_histogram:d bb_upper:d bb_middle:d "
        "bb_lower:d")
    # Q1: the same indicators over the whole series of a symbol
    add("scope_symbol_rsi", _on_o(lambda b: op.rsi(b, variant="a", scope="symbol")),
        _o(rsi_sql("bars", "result", "a", scope="symbol")), "symbol Date rsi:d")
    add("scope_symbol_ma_set", _on_o(lambda b: op.ma_set(b, scope="symbol")),
        _o(ma_set_sql("bars", "result", scope="symbol")), "symbol Date ma_5:d ma_10:d ma_20:d ma_50:d ma_200:d")
    # the same two chains over bounded chunks of each series (halo split): same SQL, same rows
    add("scored_signals_chunked", _checkpointed(_on_o(lambda b: op.technical_indicators(b, chunk_rows=CHUNK_ROWS))),
        _o(technical_sql("bars", "result")), TECH_OUT)
    add("scope_symbol_signals_chunked",
        _checkpointed(_on_o(lambda b: op.technical_indicators(b, scope="symbol", chunk_rows=CHUNK_ROWS))),
        _o(",\n".join([rsi_sql("bars", "x_rsi", "a", "symbol"), macd_sql("x_rsi", "x_macd", "a", "symbol"),
                       bollinger_sql("x_macd", "x_bb"), scored_sql("x_bb", "result", "symbol")])), TECH_OUT)
    add("scope_symbol_signals", _on_o(lambda b: op.technical_indicators(b, scope="symbol")),
        _o(",\n".join([rsi_sql("bars", "x_rsi", "a", "symbol"), macd_sql("x_rsi", "x_macd", "a", "symbol"),
                       bollinger_sql("x_macd", "x_bb"), scored_sql("x_bb", "result", "symbol")])), TECH_OUT)
    # §2.11 features; *_chunked: state carried from chunk to chunk, same SQL
    chunked_twins = (
            ("rebase_100_chunked", "rebase_100", lambda b: op.rebase(b, chunk_rows=CHUNK_ROWS)),
            ("fill_missing_days_chunked", "fill_missing_days",
             lambda b: op.fill_forward(op.complete_calendar(b), chunk_rows=CHUNK_ROWS)),
            ("normalise_minmax_chunked", "normalise_minmax",
             lambda b: op.normalise(b, method="minmax", chunk_rows=CHUNK_ROWS)),
            ("normalise_zscore_chunked", "normalise_zscore",
             lambda b: op.normalise(b, method="zscore", chunk_rows=CHUNK_ROWS)))
    add("fill_missing_days", _on_o(lambda b: op.fill_forward(op.complete_calendar(b))),
        _o("span AS (SELECT symbol, min(Date) AS lo, max(Date) AS hi FROM bars GROUP BY symbol),\n"
           "days AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS Date FROM span),\n"
           "cal AS (SELECT d.symbol, d.Date, b.Open, b.High, b.Low, b.Close, b.Volume FROM days d"
           " LEFT JOIN bars b ON b.symbol = d.symbol AND b.Date = d.Date),\n"
           "result AS (SELECT symbol, Date, " + ", ".join(
               f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY Date ROWS BETWEEN UNBOUNDED "
               f"PRECEDING AND CURRENT ROW) AS {c}" for c in ("Open", "High", "Low", "Close", "Volume")) + " FROM cal)"),
        BAR_OUT)
    add("missing_days", _on_o(lambda b: op.missing_counts(op.complete_calendar(b))),
        _o("span AS (SELECT symbol, min(Date) AS lo, max(Date) AS hi FROM bars GROUP BY symbol),\n"
           "days AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS Date FROM span),\n"
           "cal AS (SELECT d.symbol, d.Date, b.Open, b.High, b.Low, b.Close, b.Volume FROM days d"
           " LEFT JOIN bars b ON b.symbol = d.symbol AND b.Date = d.Date),\n"
           f"result AS (SELECT symbol, {_missing_sql} FROM cal GROUP BY symbol)"),
        "symbol Date_missing Open_missing High_missing Low_missing Close_missing Volume_missing")
    add("normalise_minmax", _on_o(lambda b: op.normalise(b, method="minmax")),
        _o("result AS (SELECT *, " + ", ".join(
            f"(CAST({c} AS DOUBLE) - min(CAST({c} AS DOUBLE)) OVER (PARTITION BY symbol)) / NULLIF(max(CAST({c} AS DOUBLE))"
            f" OVER (PARTITION BY symbol) - min(CAST({c} AS DOUBLE)) OVER (PARTITION BY symbol), 0) AS {c}_norm"
            for c in ("Close", "Volume")) + " FROM bars)"),
        "symbol Date Close_norm:d Volume_norm:d")
    add("normalise_zscore", _on_o(lambda b: op.normalise(b, method="zscore")),
        _o("result AS (SELECT *, " + ", ".join(
            f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER (PARTITION BY symbol)) / NULLIF(stddev_samp(CAST({c} AS DOUBLE))"
            f" OVER (PARTITION BY symbol), 0) AS {c}_norm" for c in ("Close", "Volume")) + " FROM bars)"),
        "symbol Date Close_norm:d Volume_norm:d")
    add("outlier_flags", _on_o(op.flag_outliers),
        _o(daily_return_sql("bars", "d") + ",\n"
           "q AS (SELECT symbol, quantile_cont(daily_return, 0.25) AS q1, quantile_cont(daily_return, 0.75) AS q3"
           " FROM d GROUP BY symbol),\n"
           "result AS (SELECT d.*, CASE WHEN daily_return IS NULL THEN NULL ELSE"
           " (daily_return < q1 - 1.5 * (q3 - q1) OR daily_return > q3 + 1.5 * (q3 - q1)) END AS is_outlier"
           " FROM d JOIN q ON d.symbol = q.symbol)"),
        "symbol Date daily_return:d is_outlier")
    add("outlier_flags_bounded", _checkpointed(_on_o(lambda b: op.flag_outliers(b, bounded=True))),
        E["outlier_flags"].sql, " ".join(E["outlier_flags"].out))
    add("relative_volume", _on_o(op.relative_volume),
        _o(f"result AS (SELECT *, CAST(Volume AS DOUBLE) / NULLIF({seq_avg('Volume', WR('symbol', 19))}, 0)"
           " AS relative_volume FROM bars)"),
        "symbol Date relative_volume:d")
    add("efficiency_ratio", _on_o(op.efficiency_ratio),
        _o(f"s AS (SELECT *, abs(Close - lag(Close, 1) OVER {W('symbol')}) AS step FROM bars),\n"
           f"result AS (SELECT *, abs(Close - lag(Close, 10) OVER {W('symbol')}) / NULLIF(sum(step) OVER "
           f"{WR('symbol', 9)}, 0) * 100 AS efficiency_ratio_10 FROM s)"),
        "symbol Date efficiency_ratio_10:d")
    # §2.11 levels and divergence, plain and on chunks
    level_out = "symbol kind level:d low:d high:d strength first_touch last_touch"
    pivot_out = "symbol Date kind price:d volume previous_date previous_price:d previous_volume divergence"
    add("support_resistance", _on_o(op.support_resistance), _o(LEVELS_SQL), level_out)
    add("support_resistance_chunked", _checkpointed(_on_o(lambda b: op.support_resistance(b, chunk_rows=CHUNK_ROWS))),
        _o(LEVELS_SQL), level_out)
    add("volume_divergence", _on_o(op.volume_divergence), _o(DIVERGENCE_SQL), pivot_out)
    add("volume_divergence_chunked", _checkpointed(_on_o(lambda b: op.volume_divergence(b, chunk_rows=CHUNK_ROWS))),
        _o(DIVERGENCE_SQL), pivot_out)
    add("volume_profile", _on_o(lambda b: op.volume_profile(b, bins=12)), _o(PROFILE_SQL),
        "symbol bin low:d high:d days volume share:d is_peak")
    add("rolling_atr", _on_o(op.rolling_atr),
        _o(vol_sql("bars", "v") + f",\nresult AS (SELECT *, {seq_avg('true_range', WR('symbol', 13))} AS atr_14 FROM v)"),
        "symbol Date true_range:d atr_14:d")
    for name, of, fn in chunked_twins:
        E[name] = Entry(_checkpointed(_on_o(fn)), E[of].sql, E[of].out)
    return E


ENTRIES: dict[str, Entry] = _entries()


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    e = ENTRIES[name]
    return lambda spark, sf_dir: project(e.build(spark, sf_dir), e.out)


def oracle(name: str) -> str | None:
    e = ENTRIES[name]
    return None if e.sql is None else project_sql(e.sql, e.out)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars from orders -> RSI -> MACD -> Bollinger -> scored signals."""
    return spark_query("scored_signals")(spark, sf_dir)


__all__ = ["BAR_SCHEMA", "ENTRIES", "Entry", "flagship", "oracle", "project", "project_sql", "spark_query"]
