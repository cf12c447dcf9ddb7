"""Column stages: dependency-ordered groups of column expressions.

An indicator is a list of stages; every expression in a stage reads only
columns that existed before the stage. Applying a stage is one ``withColumns``
(one projection, one analysis pass; its window expressions with equal
partition and order share one ``Window`` operator). Independent indicators
are merged level by level, so a chain of N indicators costs max(levels)
projections, not the sum.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import zip_longest

from pyspark.sql import Column, DataFrame

Stage = dict[str, Column]


def apply_stages(df: DataFrame, stages: Iterable[Stage]) -> DataFrame:
    for stage in stages:
        if stage:
            df = df.withColumns(stage)
    return df


def merge_stages(*indicators: list[Stage]) -> list[Stage]:
    """Union stage k of every indicator (they must not read each other's columns)."""
    merged = []
    for level in zip_longest(*indicators, fillvalue={}):
        out: Stage = {}
        for stage in level:
            clash = set(out) & set(stage)
            if clash:
                raise ValueError(f"columns defined twice in one stage: {sorted(clash)}")
            out.update(stage)
        merged.append(out)
    return merged
