"""What a physical plan does: exchanges, joins, Python nodes and what reaches the scan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def summary(df: DataFrame) -> dict[str, int]:
    """Counts of the nodes that matter for scale in the executed plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    names = ("Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "Window")
    return {n: len(re.findall(rf"(?<![A-Za-z]){n}\b", text)) for n in names}


def pushed_filters(df: DataFrame) -> list[str]:
    text = df._jdf.queryExecution().executedPlan().toString()
    return [x for m in re.findall(r"PushedFilters: \[([^\]]*)\]", text) for x in m.split(", ") if x]
