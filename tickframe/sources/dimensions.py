"""Category dimension and portfolio selection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's: its stock categories, each
# ticker with its company name, in the reference's order.
STOCK_CATEGORIES: dict[str, dict[str, str]] = {
    "Tech Giants": {
        "AAPL": "Apple Inc.",
        "MSFT": "Microsoft Corporation",
        "GOOGL": "Alphabet Inc.",
        "AMZN": "Amazon.com Inc.",
        "META": "Meta Platforms Inc.",
    },
    "Electric Vehicles": {
        "TSLA": "Tesla Inc.",
        "RIVN": "Rivian Automotive",
        "NIO": "NIO Inc.",
        "LCID": "Lucid Group Inc.",
    },
    "Semiconductors": {
        "NVDA": "NVIDIA Corporation",
        "AMD": "Advanced Micro Devices",
        "INTC": "Intel Corporation",
        "TSM": "Taiwan Semiconductor",
    },
    "Financial": {
        "JPM": "JPMorgan Chase",
        "BAC": "Bank of America",
        "GS": "Goldman Sachs",
        "V": "Visa Inc.",
    },
    "Healthcare": {
        "JNJ": "Johnson & Johnson",
        "PFE": "Pfizer Inc.",
        "MRNA": "Moderna Inc.",
        "UNH": "UnitedHealth Group",
    },
}

# Fixed value of the reference: the ticker used when a portfolio is empty.
DEFAULT_PORTFOLIO = ("AAPL",)

_DIM_SCHEMA = T.StructType(
    [
        T.StructField("category", T.StringType(), False),
        T.StructField("symbol", T.StringType(), False),
        T.StructField("company", T.StringType(), True),
    ]
)


def normalise_symbol(col: Column | str) -> Column:
    """Upper-case, trimmed ticker."""
    c = F.col(col) if isinstance(col, str) else col
    return F.upper(F.trim(c))


def category_frame(
    spark: SparkSession, categories: Mapping[str, Mapping[str, str] | Iterable[str]] | None = None
) -> DataFrame:
    """Dimension ``(category, symbol, company)`` from a category mapping."""
    categories = STOCK_CATEGORIES if categories is None else categories
    rows = []
    for cat, members in categories.items():
        items = members.items() if isinstance(members, Mapping) else ((m, None) for m in members)
        rows.extend((cat, sym, name) for sym, name in items)
    return spark.createDataFrame(rows, _DIM_SCHEMA)


def category_bars(bars: DataFrame, dimension: DataFrame, category: str | None = None) -> DataFrame:
    """Bars of the symbols in ``dimension`` (or one ``category``), with category and company.

    No broadcast hint: the planner and AQE choose the join from measured sizes.
    """
    dim = dimension if category is None else dimension.filter(F.col("category") == category)
    return bars.join(dim, on="symbol", how="inner")


def portfolio_frame(spark: SparkSession, symbols: Iterable[str] | None) -> DataFrame:
    """Tracked tickers, normalised and without duplicates; the default when empty."""
    seen: dict[str, None] = {}
    for s in symbols or ():
        s = s.strip().upper()
        if s:
            seen.setdefault(s, None)
    tickers = list(seen) or list(DEFAULT_PORTFOLIO)
    return spark.createDataFrame([(t,) for t in tickers], "symbol string")


def portfolio_bars(bars: DataFrame, symbols: Iterable[str] | None, normalised: bool = False) -> DataFrame:
    """Keep bars of tracked tickers only, whatever the case their symbols are stored in (left semi join).

    ``normalised``: the stored symbols are upper case and trimmed already (``load_bars(normalise=True)`` before
    writing); the list is then a filter on the column itself, which reaches the scan and prunes partitions.
    """
    port = portfolio_frame(bars.sparkSession, symbols)
    if normalised:
        return bars.filter(F.col("symbol").isin([r.symbol for r in port.collect()]))
    port = port.withColumnRenamed("symbol", "_tracked")
    return bars.join(port, normalise_symbol("symbol") == F.col("_tracked"), how="left_semi")


def tracked_bars(bars: DataFrame, tracked: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Bars of the symbols in a table (a stored portfolio, a watch list chosen by a filter).

    ``bars`` hold normalised symbols; those of ``tracked`` are normalised here. The join is on the stored column, so
    where the bars are partitioned by symbol Spark prunes their partitions at run time by what ``tracked``'s filter leaves
    (dynamic partition pruning); repeated symbols don't repeat bars.
    """
    return bars.join(tracked.select(normalise_symbol(symbol).alias("symbol")), "symbol", "left_semi")
