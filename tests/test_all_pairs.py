"""All-pairs correlation in tiles equals the pair list."""

import datetime as dt
import itertools
import random

import pytest

from tests.test_carries import same
from tickframe import operators as op
from tickframe.operators import all_pairs


def market(make_bars, symbols=23, days=90, seed=4):
    rnd, rows = random.Random(seed), []
    common = [rnd.gauss(0, 1) for _ in range(days)]
    for s in range(symbols):
        level = 10.0 ** rnd.randint(-3, 6)
        for d in range(days):
            if rnd.random() < 0.3 and s:
                continue
            close = None if rnd.random() < 0.05 else level * (5 + common[d] * (s % 3 - 1) + rnd.gauss(0, 0.5))
            if s == 5:
                close = level
            rows.append((f"S{s:02}", dt.date(2024, 1, 1) + dt.timedelta(days=d), close, level, level * 9 + d, level,
                         rnd.randint(1, 10**6)))
    return make_bars(rows + [("LONE", dt.date(1999, 1, 1), 1.0), ("PAIR", dt.date(2024, 1, 1), 2.0)])


def by_pair(df):
    return {(r.symbol_a, r.symbol_b): tuple(r) for r in df.collect()}


@pytest.mark.parametrize("block,days", [(4, 256), (7, 3), (64, 10)])
def test_equals_the_pair_list(spark, make_bars, monkeypatch, block, days):
    monkeypatch.setattr(all_pairs, "DAYS", days)
    bars = market(make_bars)
    names = sorted(r.symbol for r in bars.select("symbol").distinct().collect())
    pairs = spark.createDataFrame(list(itertools.combinations(names, 2)), "symbol_a string, symbol_b string")
    want = by_pair(op.pair_correlation(bars, pairs))
    df = op.all_pairs_correlation(bars, block=block)
    assert df.columns == op.pair_correlation(bars, pairs).columns
    got = by_pair(df)
    assert got.keys() == want.keys() and ("LONE", "S00") not in got and len(got) > 200
    for k, w in want.items():
        assert same(got[k], w), (got[k], w)


def test_top_partners(make_bars):
    bars = market(make_bars)
    whole = by_pair(op.all_pairs_correlation(bars, block=5))
    for top in (1, 3):
        want = set()
        for name in {s for pair in whole for s in pair}:
            own = [p for p in whole if name in p]
            own.sort(key=lambda p: (whole[p][3] is None, -abs(whole[p][3] or 0), p))
            want |= set(own[:top])
        assert by_pair(op.all_pairs_correlation(bars, top=top, block=5)).keys() == want


def test_empty_and_zero_for_undefined(make_bars):
    assert op.all_pairs_correlation(make_bars([("A", dt.date(2024, 1, 1), 1.0)]).limit(0)).collect() == []
    bars = make_bars([(s, dt.date(2024, 1, d), 1.0) for s in "AB" for d in (1, 2)])
    assert op.all_pairs_correlation(bars, null_as_zero=True).first().corr_close == 0.0
