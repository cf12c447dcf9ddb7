"""Indicator export (S8): CSV with a header, one folder per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Fixed value of the reference: the exported indicator columns, in order.
EXPORT_COLUMNS = (
    "Date", "Close", "Volume", "rsi", "macd_line", "signal_line",
    "macd_histogram", "bb_upper", "bb_middle", "bb_lower",
)


def export_indicators(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write the indicator columns as CSV under ``path/symbol=<s>/``.

    ``path`` must be a shared (distributed) folder on a cluster. Writes are
    task-atomic through the output committer, so a lost executor only reruns
    its own tasks.
    """
    (
        df.select("symbol", *EXPORT_COLUMNS)
        .write.mode(mode)
        .option("header", True)
        .partitionBy("symbol")
        .csv(path)
    )
    return path
