"""Pivots, levels and divergences against plain loops."""

import datetime as dt

import pytest

from tests.test_carries import same
from tests.test_chunks import _series
from tickframe import operators as op


def plain_pivots(bars, span):
    out = []
    rows = sorted(bars.collect(), key=lambda r: (r.symbol, r.Date))
    for s in {r.symbol for r in rows}:
        own = [r for r in rows if r.symbol == s]
        for i in range(span, len(own) - span):
            near = own[i - span:i + span + 1]
            for kind, c, f in (("high", "High", max), ("low", "Low", min)):
                seen = [r[c] for r in near if r[c] is not None]
                if own[i][c] is not None and own[i][c] == f(seen):
                    out.append((s, own[i].Date, kind, own[i][c], own[i].Volume))
    return sorted(out)


def holes(make_bars, seed=17):
    from pyspark.sql import functions as F
    bars = _series(make_bars, seed)
    return bars.withColumn("High", F.when(F.day("Date") != 9, F.col("High"))).withColumn(
        "Volume", F.when(F.day("Date") != 11, F.col("Volume")))


@pytest.mark.parametrize("span,chunk_rows", [(5, None), (5, 16), (2, 64), (1, None)])
def test_pivots(make_bars, span, chunk_rows):
    bars = holes(make_bars)
    assert sorted(map(tuple, op.pivots(bars, span, chunk_rows).collect())) == plain_pivots(bars, span)


@pytest.mark.parametrize("chunk_rows", [None, 64])
def test_levels(make_bars, chunk_rows):
    bars = holes(make_bars)
    want = {}
    for kind, name in (("high", "resistance"), ("low", "support")):
        for s in "ABC":
            group = []
            found = sorted((p[3], p[1]) for p in plain_pivots(bars, 5) if p[0] == s and p[2] == kind)
            for i, p in enumerate(found):
                if i and not p[0] < found[i - 1][0] * 1.01:
                    want[(s, name, group[0][0])], group = group, []
                group.append(p)
            if group:
                want[(s, name, group[0][0])] = group
    got = {(r.symbol, r.kind, r.low): r for r in op.support_resistance(bars, chunk_rows=chunk_rows).collect()}
    assert got.keys() == want.keys() and len(got) > 10
    for k, group in want.items():
        prices, dates = zip(*group)
        r = got[k]
        assert (r.strength, r.high, r.first_touch, r.last_touch) == (len(group), prices[-1], min(dates), max(dates))
        assert r.level == pytest.approx(sum(prices) / len(prices))


def test_divergence(make_bars):
    bars = holes(make_bars)
    plain, chunked = (sorted(map(tuple, op.volume_divergence(bars, chunk_rows=n).collect()), key=str) for n in (None, 64))
    assert all(same(a, b) for a, b in zip(plain, chunked)) and len(plain) == len(chunked)
    assert {r[-1] for r in plain} == {"Bearish divergence", "Bullish divergence", "Confirmed", "None", None}
    before = {}
    for s, date, kind, price, volume in sorted(plain_pivots(bars, 5), key=lambda p: p[1]):
        r = next(x for x in plain if x[:3] == (s, date, kind))
        last = before.get((s, kind))
        assert (r[5], r[6], r[7]) == ((last[1], last[3], last[4]) if last else (None, None, None))
        if last and None not in (volume, last[4]):
            further = price > last[3] if kind == "high" else price < last[3]
            assert (r[8] in ("Bearish divergence", "Bullish divergence")) == (further and volume < last[4])
        before[(s, kind)] = (s, date, kind, price, volume)


def test_short_and_empty_series(make_bars):
    bars = make_bars([("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(10)])
    assert op.pivots(bars).collect() == [] and op.support_resistance(bars).collect() == []
    assert op.volume_divergence(bars.limit(0)).collect() == []
    flat = make_bars([("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(12)])
    assert [r.strength for r in op.support_resistance(flat).collect()] == [2, 2]
    free = make_bars([("A", dt.date(2024, 1, 1) + dt.timedelta(days=i), 0.0) for i in range(12)])
    assert op.support_resistance(free).collect() == []


def test_volume_profile(make_bars):
    bars = make_bars([("A", dt.date(2024, 1, 1 + i), c, c, c, c, v) for i, (c, v) in enumerate(
        [(10.0, 5), (20.0, 7), (11.0, 5), (None, 9), (15.0, 3), (12.5, 10)])] + [
        ("B", dt.date(2024, 1, 1), 4.0, 4.0, 4.0, 4.0, 0), ("C", dt.date(2024, 1, 1), None)])
    got = sorted(map(tuple, op.volume_profile(bars, bins=4).collect()))
    assert got == [("A", 0, 10.0, 12.5, 2, 10, 10 / 30 * 100, True), ("A", 1, 12.5, 15.0, 1, 10, 10 / 30 * 100, False),
                   ("A", 2, 15.0, 17.5, 1, 3, 10.0, False), ("A", 3, 17.5, 20.0, 1, 7, 7 / 30 * 100, False),
                   ("B", 0, 4.0, 4.0, 1, 0, None, True)]
    assert op.volume_profile(bars.limit(0)).collect() == []
    with pytest.raises(ValueError):
        op.volume_profile(bars, bins=0)
