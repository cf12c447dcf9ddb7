"""Session defaults for local runs (tests, bench) and a lineage cut.

Library operators never touch configuration; only the local entry points in
``tests/`` and ``bench.py`` build a session through :func:`local_session`.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tickframe",
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # PySpark 4 records the Python call site of every Column call (several
        # JVM round trips each) to decorate error messages; deep indicator
        # chains spend most of their build time there.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_checkpoint_dir(spark)
    return spark


def _named_checkpoint_dir(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir`` of the session, else the SparkContext's checkpoint folder."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def scratch_checkpoint_dir(spark: SparkSession) -> str:
    """For local sessions (tests, bench): the named checkpoint folder, else a scratch folder, set on the context."""
    path = _named_checkpoint_dir(spark)
    if not path:
        path = tempfile.mkdtemp(prefix="tickframe-ckpt-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir`` (required)."""
    path = _named_checkpoint_dir(spark)
    if not path:
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared (distributed) folder")
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared ``spark.checkpoint.dir``.

    Used when one expensive intermediate (bars over the raw orders) feeds
    several outputs: a lost executor then recomputes from the checkpoint,
    not from the raw scan. Never ``localCheckpoint``: executor-local blocks
    die with the executor.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)
