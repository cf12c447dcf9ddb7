"""DataFrame -> DataFrame operators on the bar table."""

from tickframe.operators.adjust import adjust_prices
from tickframe.operators.all_pairs import all_pairs_correlation
from tickframe.operators.cleaning import (
    complete_calendar, drop_missing, efficiency_ratio, fill_forward, flag_outliers, keep_columns, normalise, relative_volume,
)
from tickframe.operators.correlate import (
    benchmark_correlation, benchmark_pairs, correlation_label, guarded_corr, pair_correlation,
)
from tickframe.operators.explore import exploration_indicators
from tickframe.operators.levels import pivots, support_resistance, volume_divergence
from tickframe.operators.oscillators import macd, momentum, rsi
from tickframe.operators.preview import preview_first, preview_last, recent_ma
from tickframe.operators.profile import (
    basic_stats, data_frequency, high_volume_ratio, missing_counts, sentiment_card, summary_position, volume_profile,
)
from tickframe.operators.quantiles import exact_percentiles
from tickframe.operators.returns import (
    daily_return, intraday_return, period_returns, quote_change, rebase, returns_boxplot, returns_summary,
)
from tickframe.operators.season import seasonality
from tickframe.operators.signals import latest_report, rule_signals, scored_signals, technical_indicators
from tickframe.operators.trend import ma_cross, ma_set, moving_average, moving_averages
from tickframe.operators.volatility import (
    avg_true_range, bollinger_bands, bollinger_position, latest_row, rolling_atr, volatility_metrics,
)

__all__ = [
    "adjust_prices", "all_pairs_correlation", "avg_true_range", "basic_stats", "benchmark_correlation", "benchmark_pairs", "bollinger_bands", "bollinger_position",
    "complete_calendar", "correlation_label", "daily_return", "data_frequency", "drop_missing", "efficiency_ratio", "exact_percentiles", "exploration_indicators",
    "fill_forward", "flag_outliers", "keep_columns", "guarded_corr", "high_volume_ratio", "intraday_return",
    "latest_report", "latest_row", "ma_cross", "ma_set", "macd", "missing_counts", "momentum",
    "moving_average", "moving_averages", "normalise", "pair_correlation", "period_returns", "pivots",
    "preview_first", "preview_last", "quote_change", "rebase", "recent_ma", "relative_volume",
    "returns_boxplot", "returns_summary", "rolling_atr", "rsi", "rule_signals", "scored_signals",
    "seasonality", "sentiment_card", "summary_position", "support_resistance", "technical_indicators", "volatility_metrics",
    "volume_divergence", "volume_profile",
]
