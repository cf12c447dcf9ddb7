"""tickframe: daily OHLCV bar analytics expressed as Spark DataFrame plans.

Every operator is a ``DataFrame -> DataFrame`` function built from built-in
Spark expressions and windows keyed by ``symbol``; none triggers an action,
changes session configuration or evaluates Python per row.
"""

from tickframe.schema import BAR_COLUMNS, BAR_SCHEMA, PRICE_COLUMNS

__all__ = ["BAR_COLUMNS", "BAR_SCHEMA", "PRICE_COLUMNS"]
