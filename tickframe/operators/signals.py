"""Composite trading signals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions.expr import ladder
from tickframe.operators.oscillators import RSI_INTERMEDIATE, macd, macd_stages, rsi, rsi_stages
from tickframe.operators.trend import ma_set_stages
from tickframe.operators.volatility import (
    bb_position_expr, bb_signal_expr, bollinger_bands, bollinger_stages, latest_row,
)
from tickframe.plans.chunks import CHUNK_SCOPES, over_chunks
from tickframe.plans.stages import Stage, apply_stages, merge_stages
from tickframe.plans.windows import bar_window

# Fixed value of the reference: sum of the positive vote weights
# (2 + 1.5 + 1 + 2 + 2 + 1 + 1) used to scale total_signals into [0, 1].
MAX_SCORE = 10.5


def vote_stages(scope: str = "month") -> list[Stage]:
    """Needs Close, Volume, rsi, macd_line, signal_line, macd_histogram and ma_10/50/200."""
    w = bar_window(scope)
    close, prev_close = F.col("Close"), F.lag("Close", 1).over(w)
    vol_up = F.col("Volume") > F.lag("Volume", 1).over(w)
    prev_hist = F.lag("macd_histogram", 1).over(w)
    r, ml, sl, h = F.col("rsi"), F.col("macd_line"), F.col("signal_line"), F.col("macd_histogram")

    def vs(ma: str, weight):
        return ladder([(close > F.col(ma), F.lit(weight)), (close < F.col(ma), F.lit(-weight))], F.lit(0))

    votes = {
        "signal_short_term": vs("ma_10", 2),
        "signal_medium_term": vs("ma_50", 1.5),
        "signal_long_term": vs("ma_200", 1),
        "price_momentum": ladder([(close > prev_close, F.lit(1)), (close < prev_close, F.lit(-1))], F.lit(0)),
        "signal_rsi": ladder(
            [(r < 30, F.lit(2)), (r < 40, F.lit(1)), (r > 70, F.lit(-2)), (r > 60, F.lit(-1))], F.lit(0)),
        "signal_macd": ladder(
            [((ml > sl) & (h > prev_hist), F.lit(2)), (ml > sl, F.lit(1)),
             ((ml < sl) & (h < prev_hist), F.lit(-2)), (ml < sl, F.lit(-1))], F.lit(0)),
        "volume_trend": ladder(
            [(vol_up & (close > prev_close), F.lit(1)), (vol_up & (close < prev_close), F.lit(-1))], F.lit(0)),
    }
    t = sum(F.col(c) for c in votes)
    totals = {
        "total_signals": t,
        "sentiment_strength": (t + MAX_SCORE) / (2 * MAX_SCORE),
        "sentiment": ladder(
            [(t > 3, F.lit("Strongly Bullish")), (t > 0, F.lit("Bullish")),
             (t < -3, F.lit("Strongly Bearish")), (t < 0, F.lit("Bearish"))], F.lit("Neutral")),
    }
    return [votes, totals]


_DROPPED_VOTES = ("price_momentum", "volume_trend")


def scored_signals(df: DataFrame, scope: str = "month") -> DataFrame:
    """Seven weighted votes, their total, strength in [0, 1] and a label.

    Needs ``rsi``, ``macd_line``, ``signal_line``, ``macd_histogram``
    (computed with variant a when absent). Adds ma_5 .. ma_200.
    """
    if "rsi" not in df.columns:
        df = rsi(df, variant="a", scope=scope)
    if "macd_line" not in df.columns:
        df = macd(df, variant="a", scope=scope)
    df = apply_stages(df, ma_set_stages(scope=scope) + vote_stages(scope))
    return df.drop(*_DROPPED_VOTES)


def technical_indicators(df: DataFrame, scope: str = "month", chunk_rows: int | None = None) -> DataFrame:
    """The technical tab's chain: RSI a, MACD a, Bollinger, scored signals.

    The four indicators are merged stage by stage (they do not read each
    other's columns), then the votes: 6 projections and 5 window operators,
    all on the bars' single ``symbol`` partitioning.

    ``chunk_rows`` runs the same chain over bounded chunks of each series
    (``plans.chunks``): identical results, and a symbol with a very long
    history is spread over many tasks instead of one.
    """
    if chunk_rows is not None:
        return over_chunks(df, lambda d: _technical(d, CHUNK_SCOPES[scope], "chunk"), chunk_rows=chunk_rows)
    return _technical(df, scope, "symbol")


def _technical(df: DataFrame, scope: str, bb_scope: str) -> DataFrame:
    stages = merge_stages(
        rsi_stages(variant="a", scope=scope), macd_stages(variant="a", scope=scope),
        bollinger_stages(scope=bb_scope), ma_set_stages(scope=scope),
    )
    return apply_stages(df, stages + vote_stages(scope)).drop(*_DROPPED_VOTES)


def rule_signals(df: DataFrame, scope: str = "month", chunk_rows: int | None = None,
                 include_indicators: Iterable[str] = ("rsi", "macd")) -> DataFrame:
    """RSI b + MACD b, then ``trade_signal`` (NULL inputs fall to Hold).

    ``include_indicators`` names the indicators to compute; those left out are
    taken from the columns ``df`` already has.
    ``chunk_rows`` runs over bounded chunks of each series, as in
    :func:`technical_indicators`.
    """
    if chunk_rows is not None:
        return over_chunks(df, lambda d: rule_signals(d, CHUNK_SCOPES[scope], include_indicators=include_indicators),
                           chunk_rows=chunk_rows)
    compute = {"rsi": rsi_stages(variant="b", scope=scope), "macd": macd_stages(variant="b", scope=scope)}
    wanted = list(include_indicators)
    given = [c for name, c in (("rsi", "rsi"), ("macd", "macd_line"), ("macd", "signal_line")) if name not in wanted]
    missing = [c for c in given if c not in df.columns] + [n for n in wanted if n not in compute]
    if missing:
        raise ValueError(f"neither computed nor given: {missing}")
    stages = merge_stages(*[compute[name] for name in wanted])
    r, ml, sl = F.col("rsi"), F.col("macd_line"), F.col("signal_line")
    sig = ladder(
        [((r < 30) & (ml > sl), F.lit("Strong Buy")), ((r < 40) & (ml > sl), F.lit("Buy")),
         ((r > 70) & (ml < sl), F.lit("Strong Sell")), ((r > 60) & (ml < sl), F.lit("Sell"))],
        F.lit("Hold"),
    )
    helpers = [*RSI_INTERMEDIATE, "ema_fast", "ema_slow"]
    df = apply_stages(df, stages).drop(*[c for c in helpers if c not in df.columns])
    return df.withColumn("trade_signal", sig)


def latest_report(df: DataFrame, scope: str = "month") -> DataFrame:
    """One row per symbol with the labels of its latest bar."""
    if "sentiment" not in df.columns:
        df = technical_indicators(df, scope=scope)
    if not {"bb_lower", "bb_upper"} <= set(df.columns):  # after scored_signals
        df = bollinger_bands(df)
    keep = ["symbol", "Date", "Close", "ma_10", "ma_50", "ma_200", "rsi", "macd_line", "signal_line",
            "bb_lower", "bb_upper", "sentiment", "sentiment_strength", "signal_short_term",
            "signal_medium_term", "signal_long_term", "signal_rsi", "signal_macd"]
    last = latest_row(df.select(*keep))

    def trend(c):
        return F.when(F.col(c) > 0, "Bullish").otherwise("Bearish")

    def side(ma):
        return ladder([(F.col("Close") > F.col(ma), F.lit("Above")), (F.col("Close") <= F.col(ma), F.lit("Below"))])

    r = F.col("rsi")
    mv, sv = F.coalesce(F.col("macd_line"), F.lit(0.0)), F.coalesce(F.col("signal_line"), F.lit(0.0))
    pos = bb_position_expr()
    return last.select(
        "symbol", "Date", "Close", "sentiment", "sentiment_strength",
        trend("signal_short_term").alias("short_term_trend"),
        trend("signal_medium_term").alias("medium_term_trend"),
        trend("signal_long_term").alias("long_term_trend"),
        ladder([(F.col("signal_rsi") > 0, F.lit("Oversold (Bullish)")),
                (F.col("signal_rsi") < 0, F.lit("Overbought (Bearish)"))], F.lit("Neutral")).alias("rsi_signal"),
        trend("signal_macd").alias("macd_signal"),
        side("ma_200").alias("vs_ma_200"), side("ma_50").alias("vs_ma_50"), side("ma_10").alias("vs_ma_10"),
        "rsi",
        F.when(r.isNotNull(), ladder([(r < 30, F.lit("Oversold")), (r > 70, F.lit("Overbought"))],
                                     F.lit("Neutral"))).alias("rsi_level"),
        mv.alias("macd_value"), sv.alias("signal_value"),
        F.when(mv > sv, "Bullish").otherwise("Bearish").alias("macd_cross"),
        pos.alias("bb_position"),
        bb_signal_expr(pos).alias("bb_signal"),
    )
