"""Plans as text, JSON and DOT."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What `explain` prints."""
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def plan_json(df: DataFrame) -> list[dict]:
    """The optimised plan: a dictionary a node, in pre-order, `num-children` telling how many follow."""
    return json.loads(df._jdf.queryExecution().optimizedPlan().toJSON())


def plan_dot(df: DataFrame) -> str:
    """The optimised plan as a DOT graph, from each node to its children."""
    lines, open_ = ["digraph plan {"], []
    for i, node in enumerate(plan_json(df)):
        lines.append(f'  n{i} [label="{node["class"].rsplit(".", 1)[-1]}"];')
        if open_:
            lines.append(f"  n{open_[-1][0]} -> n{i};")
            open_[-1][1] -= 1
        open_.append([i, node["num-children"]])
        while open_ and not open_[-1][1]:
            open_.pop()
    return "\n".join([*lines, "}"])
