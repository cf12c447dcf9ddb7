import os
import tempfile

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tickframe.jobs import dashboard_job
from tickframe.sources import bars_from_events, bars_from_orders, read_table
from tickframe.streaming import late_rows, stream_daily_bars, write_bar_stream


def test_stream_bars_equal_batch_bars(spark):
    events = read_table(spark, SF_SMALL, "events")
    src = tempfile.mkdtemp(prefix="tf-events-")  # the file source watches a directory
    os.symlink(f"{SF_SMALL}/events.parquet", f"{src}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(src)
    ckpt = tempfile.mkdtemp(prefix="tf-stream-")
    q = (stream_daily_bars(stream).writeStream.outputMode("append").format("memory")
         .queryName("tf_bars").option("checkpointLocation", ckpt).start())
    q.processAllAvailable()
    assert late_rows(q) == 0
    q.stop()
    got = spark.sql("SELECT * FROM tf_bars")
    want = bars_from_events(events)
    # append mode emits a day once the watermark (max event time - 1 day) passes its end
    last = want.agg(F.max("Date")).first()[0]
    want = want.filter(F.col("Date") < F.date_sub(F.lit(last), 1))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 0


def test_dashboard_job_writes_all_outputs(spark):
    out = tempfile.mkdtemp(prefix="tf-job-")
    paths = dashboard_job(bars_from_orders(read_table(spark, SF_SMALL, "orders")), out)
    for name, path in paths.items():
        assert os.path.isdir(path), name
    assert spark.read.parquet(paths["latest_report"]).count() == 5
    assert spark.read.option("header", True).csv(paths["indicators"]).count() > 0


def test_bar_stream_to_parquet_table(spark):
    events = read_table(spark, SF_SMALL, "events")
    src = tempfile.mkdtemp(prefix="tf-events-")
    os.symlink(f"{SF_SMALL}/events.parquet", f"{src}/events.parquet")
    out, ckpt = tempfile.mkdtemp(prefix="tf-bars-"), tempfile.mkdtemp(prefix="tf-ckpt-")
    q = write_bar_stream(spark.readStream.schema(events.schema).parquet(src), out + "/t", ckpt)
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(out + "/t")
    assert got.count() > 0
    assert set(got.columns) == {"symbol", "Date", "Open", "High", "Low", "Close", "Volume"}
