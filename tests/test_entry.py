import __spark_entry__ as se


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.count() > 0
    assert df.columns[:4] == ["symbol", "Date", "Close", "Volume"]
    assert dict(df.dtypes)["sentiment"] == "string"
