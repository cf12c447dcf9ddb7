"""Exact percentiles without a buffer per group.

``percentile`` holds every distinct value of a group in one task. Here the wanted order
statistics are found by refining a histogram over the bit order of doubles: a double's
64 bits, seen as a signed integer (negative numbers mirrored), sort as the numbers do. Each pass
counts the values that share a target's leading bits by their next ``STEP`` bits, combined
map side, and picks the bin that holds the target's rank: 64 / STEP passes find the exact value. A group
costs at most ``2 ** STEP`` counters for each of its targets, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.plans.session import cut_lineage

STEP = 16
_MAX = (1 << 63) - 1


def _mirrored(bits: Column) -> Column:
    """Bits that sort as the numbers do (-0.0 just before 0.0, NaN last), and back: negative ones turned around."""
    return bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit(_MAX)))


def from_sort_bits(key: str) -> Column:
    return F.call_function("reflect", F.lit("java.lang.Double"), F.lit("longBitsToDouble"),
                           _mirrored(F.col(key))).cast("double")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """``keys, n, q``: the non-null values of each group and their percentiles (linear interpolation).

    Equal to ``percentile(value, shares)``. Groups without a value don't appear; null keys form a group.
    """
    keys = list(keys)
    own = [f"_key{i}" for i in range(len(keys))]
    data = df.filter(F.col(value).isNotNull()).select(
        *[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(value).cast("double").alias("_v"))
    bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col("_v")).cast("bigint")
    data = cut_lineage(data.select(*own, bits.alias("_bits")).withColumn("_bits", _mirrored(F.col("_bits"))))
    sizes = data.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    sides = [e for s in shares for at in [(F.col("_n") - 1) * F.lit(float(s))] for e in (F.floor(at), F.ceil(at))]
    # one target per wanted rank: the bits known so far, and how many values of the group are below those bits
    targets = sizes.withColumn("_rank", F.explode(F.array_distinct(F.array(*sides)))).withColumns(
        {"_bits": F.lit(0).cast("bigint"), "_below": F.lit(0).cast("bigint")})
    for known in range(0, 64, STEP):
        targets = cut_lineage(targets)
        prefix = F.shiftright("_bits", 64 - known) if known else F.lit(0).cast("bigint")
        rows = data.select(*own, prefix.alias("_prefix"), F.shiftright("_bits", 64 - known - STEP).alias("_bin"))
        if known:  # at first every row counts
            wanted = targets.select(*[F.col(c).alias(f"_t{c}") for c in own], F.col("_bits").alias("_t_bits")).distinct()
            rows = rows.join(wanted, [F.col(c).eqNullSafe(F.col(f"_t{c}")) for c in own] + [
                F.col("_prefix") == F.col("_t_bits")], "left_semi")
        bins = rows.groupBy(*own, "_prefix", "_bin").agg(F.count(F.lit(1)).alias("_count"))
        line = Window.partitionBy(*own, "_prefix").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_lower", F.coalesce(F.sum("_count").over(line), F.lit(0).cast("bigint")))
        bins = bins.withColumnsRenamed({c: f"_b{c}" for c in own})
        at = F.col("_rank") - F.col("_below")
        on = [F.col(c).eqNullSafe(F.col(f"_b{c}")) for c in own] + [
            F.col("_bits") == F.col("_prefix"), at >= F.col("_lower"), at < F.col("_lower") + F.col("_count")]
        targets = targets.join(bins, on).select(
            *own, "_n", "_rank", F.col("_bin").alias("_bits"), (F.col("_below") + F.col("_lower")).alias("_below"))
    found = targets.withColumn("_value", from_sort_bits("_bits")).groupBy(*own, "_n").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))

    def interpolated(share: float) -> Column:
        at = (F.col("_n") - 1) * F.lit(float(share))
        low, high = F.col("_at")[F.floor(at)], F.col("_at")[F.ceil(at)]
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], F.col("_n").alias("n"),
                        F.array(*[interpolated(s) for s in shares]).alias("q"))
