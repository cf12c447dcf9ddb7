"""Momentum, RSI and MACD.

The reference has two versions of RSI and MACD with different results:

variant ``"a"``  frames of ``period + 1`` rows; MACD coalesces every step and
                 takes the signal over ``ln(|macd| + 1e-5)``, so it is never NULL;
variant ``"b"``  frames of ``period`` rows; the signal averages ``ln(macd)``
                 over positive MACD values only and is NULL when there is none.

Both call their averages "EMA" but compute windowed *geometric means*
``exp(avg(ln(Close)))``; that is what is reproduced here. Both default to
month scope: every calendar month starts cold.

Float noise is judged relative to the values, so that results do not depend
on the unit of the price. Where the fast and slow frames hold the same rows
(the first bars of a month) the line is 0 in exact arithmetic: a difference
below ``LINE_NOISE`` x Close is 0. Where one positive MACD is alone in the
signal frame, ``exp(ln(m))`` differs from ``m`` in the last bits: a signal
within ``SIGNAL_NOISE`` x line of the line equals it. ``noise=False`` keeps the
raw values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.expr import pct_change, safe_div, safe_ln
from tickframe.plans.chunks import chunked
from tickframe.plans.stages import Stage, apply_stages
from tickframe.plans.windows import bar_window

# Relative float noise of a difference of geometric means, and of exp(ln(x)) against x.
LINE_NOISE = 1e-11
SIGNAL_NOISE = 1e-13
# Fixed value of the reference: offset added to |macd| before the log in variant a.
MACD_LOG_OFFSET = 0.00001


def momentum(df: DataFrame, window: int = 10, scope: str = "symbol", chunk_rows: int | None = None) -> DataFrame:
    """``momentum_{window}d`` = percent change vs ``window`` bars back."""
    if chunk_rows is not None:
        return chunked(df, scope, chunk_rows, lambda d, s: momentum(d, window, s))
    prev = F.lag("Close", window).over(bar_window(scope))
    return df.withColumn(f"momentum_{window}d", pct_change("Close", prev))


def _rows(period: int, variant: str) -> int:
    if variant not in ("a", "b"):
        raise ValueError("variant must be 'a' or 'b'")
    return period if variant == "a" else period - 1


def rsi_stages(period: int = 14, variant: str = "a", scope: str = "month") -> list[Stage]:
    rows = _rows(period, variant)
    wf = bar_window(scope, rows)
    pc = F.col("price_change")
    ag, al = F.col("avg_gain"), F.col("avg_loss")
    return [
        {"price_change": F.col("Close") - F.lag("Close", 1).over(bar_window(scope))},
        {"gain": F.when(pc > 0, pc).otherwise(F.lit(0.0)), "loss": F.when(pc < 0, -pc).otherwise(F.lit(0.0))},
        {"avg_gain": F.avg("gain").over(wf), "avg_loss": F.avg("loss").over(wf)},
        {"rs": safe_div(ag, al), "rsi": 100 - 100 / (1 + safe_div(ag, al))},
    ]


RSI_INTERMEDIATE = ("price_change", "gain", "loss", "avg_gain", "avg_loss", "rs")


def rsi(df: DataFrame, period: int = 14, variant: str = "a", scope: str = "month",
        keep_intermediate: bool | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Relative strength index.

    ``avg_loss = 0`` gives NULL (no division), also on the first bar of a
    scope. Variant a keeps price_change, gain, loss, avg_gain, avg_loss and rs
    unless ``keep_intermediate=False``; variant b keeps only ``rsi``.
    """
    if chunk_rows is not None:
        return chunked(df, scope, chunk_rows, lambda d, s: rsi(d, period, variant, s, keep_intermediate))
    if keep_intermediate is None:
        keep_intermediate = variant == "a"
    df = apply_stages(df, rsi_stages(period, variant, scope))
    return df if keep_intermediate else df.drop(*RSI_INTERMEDIATE)


def _geo_mean(x: Column, w) -> Column:
    return F.exp(F.avg(safe_ln(x)).over(w))


def _line(diff: Column, noise: bool) -> Column:
    return F.when(F.abs(diff) <= LINE_NOISE * F.abs("Close"), F.lit(0.0)).otherwise(diff) if noise else diff


def _signal(sig: Column, line: Column, noise: bool) -> Column:
    return F.when(F.abs(sig - line) <= SIGNAL_NOISE * F.abs(line), line).otherwise(sig) if noise else sig


def _ema_names(fast: int, slow: int, variant: str) -> tuple[str, str]:
    return (f"ema_{fast}", f"ema_{slow}") if variant == "a" else ("ema_fast", "ema_slow")


def macd_stages(fast: int = 12, slow: int = 26, signal: int = 9, variant: str = "a", scope: str = "month",
                noise: bool = True) -> list[Stage]:
    rf, rs_, rg = _rows(fast, variant), _rows(slow, variant), _rows(signal, variant)
    ef, es = _ema_names(fast, slow, variant)
    close, m = F.col("Close"), F.col("macd_line")
    if variant == "a":
        ema_f = F.coalesce(_geo_mean(close, bar_window(scope, rf)), close)
        ema_s = F.coalesce(_geo_mean(close, bar_window(scope, rs_)), close)
        sig = F.coalesce(_signal(_geo_mean(F.abs(m) + MACD_LOG_OFFSET, bar_window(scope, rg)), m, noise), m)
        return [
            {ef: ema_f, es: ema_s, "macd_line": F.coalesce(_line(ema_f - ema_s, noise), F.lit(0.0))},
            {"signal_line": sig, "macd_histogram": F.coalesce(m - sig, F.lit(0.0))},
        ]
    ema_f = _geo_mean(close, bar_window(scope, rf))
    ema_s = _geo_mean(close, bar_window(scope, rs_))
    sig = _signal(_geo_mean(m, bar_window(scope, rg)), m, noise)
    return [
        {ef: ema_f, es: ema_s, "macd_line": _line(ema_f - ema_s, noise)},
        {"signal_line": sig, "macd_histogram": m - sig},
    ]


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, variant: str = "a",
         scope: str = "month", noise: bool = True,
         keep_intermediate: bool | None = None, chunk_rows: int | None = None) -> DataFrame:
    """MACD line, signal line and histogram from windowed geometric means.

    Variant a names its averages ``ema_{fast}``/``ema_{slow}`` and keeps them;
    variant b drops them unless ``keep_intermediate=True``.
    """
    if chunk_rows is not None:
        return chunked(df, scope, chunk_rows, lambda d, s: macd(
            d, fast, slow, signal, variant, s, noise, keep_intermediate))
    if keep_intermediate is None:
        keep_intermediate = variant == "a"
    df = apply_stages(df, macd_stages(fast, slow, signal, variant, scope, noise))
    return df if keep_intermediate else df.drop(*_ema_names(fast, slow, variant))
