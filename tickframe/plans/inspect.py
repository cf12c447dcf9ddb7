"""Plan checks used by tests and the bench: read the physical plan text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def plan_problems(df: DataFrame) -> list[str]:
    """Patterns that must not appear in any plan of this library."""
    plan = physical_plan(df)
    problems = []
    if "SinglePartition" in plan:
        problems.append("SinglePartition exchange")
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        if node in plan:
            problems.append(f"Python evaluation node {node}")
    if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
        problems.append("cross join")
    return problems
