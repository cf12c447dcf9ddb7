"""Batch job behind the reference's three dashboard tabs, run for all symbols.

Bars are built once from the raw rows and cut from their lineage with a
reliable checkpoint in the cluster's shared ``spark.checkpoint.dir``; every
output is then written from the checkpointed bars. A lost executor reruns
only its own tasks of the current output, never the raw scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickframe import operators as op
from tickframe.plans.session import cut_lineage
from tickframe.sources.sinks import export_indicators

OUTPUTS = ("profile", "summary", "latest_report", "seasonality", "exploration", "indicators")


def dashboard_job(bars: DataFrame, out_dir: str, mode: str = "overwrite") -> dict[str, str]:
    """Write the exploration, technical and analysis tables under ``out_dir`` (shared storage)."""
    bars = cut_lineage(bars)
    out = out_dir.rstrip("/")
    paths = {name: f"{out}/{name}" for name in OUTPUTS}
    profile = op.basic_stats(bars).join(op.data_frequency(bars), "symbol").join(op.high_volume_ratio(bars), "symbol")
    profile.write.mode(mode).parquet(paths["profile"])
    card = op.sentiment_card(bars).drop("avg_volume")
    op.summary_position(bars).join(card, "symbol").write.mode(mode).parquet(paths["summary"])
    signals = cut_lineage(op.technical_indicators(bars))  # built once for the report and the export
    op.latest_report(signals).write.mode(mode).parquet(paths["latest_report"])
    op.seasonality(bars, named=True).write.mode(mode).parquet(paths["seasonality"])
    op.exploration_indicators(op.period_returns(bars)).write.mode(mode).partitionBy("symbol").parquet(
        paths["exploration"])
    export_indicators(signals, paths["indicators"], mode=mode)
    return paths
