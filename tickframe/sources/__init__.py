from tickframe.sources.bars import (
    bars_from_events,
    bars_from_orders,
    bars_from_ticks,
    load_bars,
    read_table,
)
from tickframe.sources.dimensions import (
    category_bars,
    category_frame,
    normalise_symbol,
    portfolio_bars,
    portfolio_frame,
    tracked_bars,
)
from tickframe.sources.lookback import lookback, lookback_ytd, stored_lookback
from tickframe.sources.sinks import export_indicators

__all__ = [
    "bars_from_events",
    "bars_from_orders",
    "bars_from_ticks",
    "category_bars",
    "category_frame",
    "export_indicators",
    "load_bars",
    "lookback",
    "lookback_ytd",
    "normalise_symbol",
    "portfolio_bars",
    "portfolio_frame",
    "read_table",
    "stored_lookback",
    "tracked_bars",
]
