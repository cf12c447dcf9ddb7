import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickframe.plans.session import local_session  # noqa: E402
from tickframe.schema import BAR_SCHEMA  # noqa: E402

SF = "/root/testdata/sf0.01"
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="tickframe-tests")
    yield s


def day(i: int, start: dt.date = dt.date(2024, 1, 1)) -> dt.date:
    return start + dt.timedelta(days=i)


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from (symbol, date, close[, open, high, low, volume]) tuples."""

    def build(rows):
        full = []
        for r in rows:
            sym, d, close = r[0], r[1], r[2]
            o = r[3] if len(r) > 3 else close
            h = r[4] if len(r) > 4 else (None if close is None else max(close, o))
            lo = r[5] if len(r) > 5 else (None if close is None else min(close, o))
            v = r[6] if len(r) > 6 else 100
            full.append((sym, d, o, h, lo, close, v))
        return spark.createDataFrame(full, BAR_SCHEMA)

    return build


def by_key(df, *cols):
    """Collect as {(symbol, Date): row} (or custom key columns)."""
    cols = cols or ("symbol", "Date")
    return {tuple(r[c] for c in cols): r for r in df.collect()}
