"""Plans as text, and EXPLAIN ANALYZE: run the query, then read every operator's metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

KINDS = {"indent": "extended", "tree": "formatted", "formatted": "formatted", "simple": "simple", "extended": "extended", "cost": "cost", "codegen": "codegen"}


def text(df: DataFrame, kind: str = "formatted") -> str:
    if kind == "graphviz":
        return graphviz(df)
    if kind == "pgjson":
        return pgjson(df)
    if kind not in KINDS:
        raise ValueError(f"no explain format {kind}")
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), KINDS[kind])


def _final(node):
    """The plan below an adaptive root, a stage or a reused part."""
    for method in ("executedPlan", "plan", "child"):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec" and method == "executedPlan" or name.endswith("QueryStageExec") and method == "plan":
            return _final(getattr(node, method)())
    return node


def _walk(node, depth: int = 0):
    node = _final(node)
    metrics = {}
    it = node.metrics().iterator()
    while it.hasNext():
        pair = it.next()
        metrics[pair._2().name().get() if pair._2().name().isDefined() else pair._1()] = int(pair._2().value())
    yield depth, node.nodeName().strip(), node.simpleString(200).strip(), metrics
    children = node.children().iterator()
    while children.hasNext():
        yield from _walk(children.next(), depth + 1)


def analyze(df: DataFrame) -> DataFrame:
    """Runs df (its rows are counted by a sink that drops them) and returns stage, depth, operator, detail, metrics."""
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan()
    plan.execute().count()
    rows, stage = [], 0
    for depth, name, detail, metrics in _walk(plan):
        stage += name.startswith(("Exchange", "BroadcastExchange"))
        rows.append((len(rows), stage, depth, name, detail, {k: v for k, v in metrics.items() if v >= 0}))
    return df.sparkSession.createDataFrame(rows, "id int, stage int, depth int, operator string, detail string, metrics map<string,bigint>")


def graphviz(df: DataFrame) -> str:
    """The physical plan as a DOT graph, an edge from each child to its parent."""
    lines, stack = ["digraph plan {", "  rankdir=BT;"], []
    for k, (depth, name, _, _) in enumerate(_walk(df._jdf.queryExecution().executedPlan())):
        lines.append(f'  n{k} [label="{name}", shape=box];')
        del stack[depth:]
        if stack:
            lines.append(f"  n{k} -> n{stack[-1]};")
        stack.append(k)
    return "\n".join([*lines, "}"])


def pgjson(df: DataFrame) -> str:
    """The physical plan as JSON: a node's type, its output line and the nodes below it."""
    above: list[dict] = []
    for depth, name, detail, _ in _walk(df._jdf.queryExecution().executedPlan()):
        node = {"Node Type": name, "Output": detail, "Plans": []}
        del above[depth:]
        if above:
            above[-1]["Plans"].append(node)
        above.append(node)
    return json.dumps([{"Plan": above[0]}], indent=2)
