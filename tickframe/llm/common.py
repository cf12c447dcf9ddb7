"""Helpers shared by the operators: shared-folder tables, connected components, text columns."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``.

    Only a single-process local session (``local[...]``: tests, oracle runs)
    that names none gets a scratch folder; anything else raises, because a
    machine-local folder would lose rows on a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set; set it to a folder that all executors share")
        import tempfile
        base = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of stored tables that no later step reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


_held: list = [None, None]


def worker_state(name, make: Callable):
    """What an operator keeps in a Python worker between tasks (a table of bounded size).

    Workers are shared by all operators: the state of another one is let go first, and its memory given back.
    """
    if _held[0] != name:
        if _held[0] is not None:
            _held[:] = [None, None]
            gc.collect()
            pa.default_memory_pool().release_unused()
            _trim()
        _held[:] = [name, make()]
    return _held[1]


def _trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_size(batches: Iterator[pa.RecordBatch], column: str | int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of a text column (one row at least), to bound a task's memory.

    Parts are copies: some string functions of Arrow misread slices that start inside a batch.
    """
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows] if b.num_rows else [0, 0]
        for lo, hi in zip(cuts, cuts[1:]):
            yield b if hi - lo == b.num_rows else b.take(pa.array(np.arange(lo, hi)))
    pa.default_memory_pool().release_unused()


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def named_classes(classes: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """``classes(key, rep, ...)`` with a ``node`` that no two classes share, and whether it is ``rep`` itself.

    ``rep`` (the smallest id) names a class unless rows of other contents repeat it, or ids pass 62 bits. Then a class
    is named by a 62-bit hash of its key, drawn anew until all differ.
    """
    wide = (F.col("rep") >= 1 << 62) | (F.col("rep") < -(1 << 62))
    if classes.groupBy("rep").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | wide).isEmpty():
        return classes.withColumn("node", F.col("rep")), True
    seed = 0
    while True:
        named = stored(classes.withColumn("node", F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 2)), name)
        if named.groupBy("node").count().filter("count > 1").isEmpty():
            return named, False
        seed += 1


def component_ids(classes: DataFrame, component: DataFrame) -> DataFrame:
    """``classes`` with ``root``, the smallest node of their component, and ``component``, its smallest ``rep``."""
    own = classes.join(component.withColumnRenamed("component", "root"), "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = own.groupBy("root").agg(F.min("rep").alias("component"))
    return own.join(least, "root")


def smallest_reachable(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: the smallest node reachable from it.

    Alternating large-star and small-star steps: every step moves links
    towards smaller neighbours until each component is a star around its
    minimum. A node's neighbours are only ever reduced to their minimum by a
    map-side combined ``min``; the minima are stored before they are joined
    back, so that both join sides are plain exchanges and AQE can split a hub.
    """
    spark = edges.sparkSession
    links = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while not _stars(links):
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), name)
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), name)
        # small star: u and its smaller neighbours are linked to the smallest of them
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stored(small.filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        dropped(spark, links, low, large, least)
        links = small
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether every ``u`` has one link, and no ``v`` is a ``u``: then each component is a star around its minimum."""
    sides = links.select(F.col("u").alias("x"), F.lit(1).alias("out")).unionByName(
        links.select(F.col("v").alias("x"), F.lit(0).alias("out")))
    node = sides.groupBy("x").agg(F.sum("out").alias("out"), F.min("out").alias("low"))
    return node.filter("out > 1 or out = 1 and low = 0").isEmpty()
