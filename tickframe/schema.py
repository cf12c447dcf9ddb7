"""The bar table: one row per (symbol, Date)."""

from pyspark.sql import types as T

PRICE_COLUMNS = ("Open", "High", "Low", "Close")
BAR_COLUMNS = ("symbol", "Date", *PRICE_COLUMNS, "Volume")
OPTIONAL_COLUMNS = ("Dividends", "Stock_Splits")

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("Date", T.DateType(), False),
        T.StructField("Open", T.DoubleType(), True),
        T.StructField("High", T.DoubleType(), True),
        T.StructField("Low", T.DoubleType(), True),
        T.StructField("Close", T.DoubleType(), True),
        T.StructField("Volume", T.LongType(), True),
    ]
)

BAR_SCHEMA_WITH_ACTIONS = T.StructType(
    list(BAR_SCHEMA.fields)
    + [
        T.StructField("Dividends", T.DoubleType(), True),
        T.StructField("Stock_Splits", T.DoubleType(), True),
    ]
)


def numeric_columns(schema: T.StructType, exclude=("symbol", "Date")) -> list[str]:
    """Double and bigint columns of ``schema`` in schema order."""
    return [
        f.name
        for f in schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.LongType)) and f.name not in exclude
    ]
