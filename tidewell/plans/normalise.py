"""Plan payloads (JSON) to views: nodes in preorder with depth, and a summary by operator.

The JSON is recursive and comes in two shapes, so one Python function per payload does it, in Arrow batches."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES, SUMMARY, TEXT, PROPERTY = 200, 50, 80, 240
NODE = "id string, depth int, operator string, name string, rows bigint, cost bigint, property string"
ROW = "operator string, count bigint, rows bigint, cost bigint"
VIEW = f"uid string, sql_id string, roots array<string>, nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>, summary array<struct<{ROW.replace(' ', ':').replace(',:', ',')}>>, node_count int, truncated boolean"


def number(value) -> int | None:
    """Lenient: numbers and numeric strings, cut towards zero."""
    if type(value) is int:
        return value
    if type(value) is str and len(value) <= 15 and value.isascii() and value.isdigit():
        return int(value)
    if isinstance(value, bool) or value is None:
        return None
    try:
        x = float(value)
    except (TypeError, ValueError):
        return None
    return int(value) if isinstance(value, int) else int(x) if math.isfinite(x) else None


def field(item: dict, *names: str):
    for n in names:
        if (v := item.get(n)) is not None:
            return v
    return None


def cut(value, limit: int = TEXT) -> str:
    s = "" if value is None else str(value)
    return s if len(s) <= limit else s[:limit] + "…"


def shown(item: dict, *names: str, limit: int = TEXT) -> str:
    """First field with content; the word NULL is none."""
    for n in names:
        if (v := item.get(n)) is not None:
            t = v if type(v) is str else str(v)
            if (s := t.strip()) and s.upper() != "NULL":
                return s if len(t) <= limit else cut(t, limit).strip()
    return ""


class Graph:
    """Nodes by key in order of arrival, and the keys of each one's children (given inline or by id)."""

    def __init__(self, items: list):
        self.nodes: dict[str, dict] = {}
        self.kids: dict[str, list[str]] = {}
        self.top: list[str] = []
        todo = [(x, f"node-{i}", self.top, i) for i, x in enumerate(items)]
        # depth first without recursion: a node is registered before its children, the children before its next sibling
        todo.reverse()
        while todo:
            item, name, into, _ = todo.pop()
            if not isinstance(item, dict):
                if into is not self.top:
                    into.append(str(item))
                continue
            own = field(item, "id", "Id")
            key = name if own is None else str(own)
            into.append(key)
            if key in self.nodes:
                continue
            self.nodes[key], self.kids[key] = item, []
            below = field(item, "children", "Children") or []
            todo += [(c, f"{key}.{i}", self.kids[key], i) for i, c in reversed(list(enumerate(below)))]

    def roots(self, declared) -> list[str]:
        named = [str(r) for r in declared if str(r) in self.nodes] if isinstance(declared, list) else []
        if named:
            return named
        below = {k for ks in self.kids.values() for k in ks}
        return [k for k in self.nodes if k not in below] or self.top

    def preorder(self, roots: list[str]) -> list[tuple[str, int]]:
        """Every node once; what the roots do not reach comes last, at depth 0."""
        out: dict[str, int] = {}
        todo = [(k, 0) for k in [*roots, *self.nodes]][::-1]
        while todo:
            key, depth = todo.pop()
            if key in self.nodes and key not in out:
                out[key] = depth
                todo += [(c, depth + 1) for c in reversed(self.kids[key])]
        return list(out.items())


def summary(raw, nodes: list[dict]) -> list[dict]:
    """Declared rows completed: row by row if they name the nodes one by one, else from sums per operator; declared numbers win."""
    rows = [x for x in raw[:SUMMARY] if isinstance(x, dict)] if isinstance(raw, list) else []
    name = lambda x: shown(x, "operator", "Operator")
    get = lambda x, *names: number(field(x, *names))
    one_by_one = len(rows) == len(nodes) and all(name(a) == name(b) for a, b in zip(rows, nodes, strict=True))
    sums: dict[str, list[int]] = {}
    for n in nodes:
        s = sums.setdefault(name(n), [0, 0, 0])
        for i, v in enumerate((1, get(n, "rows", "Rows") or 0, get(n, "cost", "Cost") or 0)):
            s[i] += v
    out = []
    for i, r in enumerate(rows):
        operator = name(r)
        if one_by_one:
            other = [1, get(nodes[i], "rows", "Rows"), get(nodes[i], "cost", "Cost")]
        else:
            other = sums.get(operator, [None] * 3) if operator else [None] * 3
        own = [get(r, "count", "Count"), get(r, "rows", "Rows"), get(r, "cost", "Cost")]
        out.append({"operator": operator} | {k: o if v is None else v for k, v, o in zip(("count", "rows", "cost"), own, other, strict=True)})
    return out


def _read(payload, whole_property: bool) -> tuple[Graph, list[str], list[tuple[str, int]], list[dict]] | None:
    """The graph of a payload, its roots, all keys in preorder with depth, and the nodes of a view."""
    if not isinstance(payload, dict):
        return None
    declared = field(payload, "rootOperations", "root_operations")
    tree = [x for x in declared if isinstance(x, dict)] if isinstance(declared, list) else []
    nested = any(field(x, "children", "Children") for x in tree)
    items = tree if nested else field(payload, "data", "plan_data")
    if not isinstance(items, list) or not items:
        return None
    g = Graph(items)
    if not g.nodes:
        return None
    roots = list(dict.fromkeys(g.top)) if nested else g.roots(declared)
    order = g.preorder(roots)
    limit = 1 << 30 if whole_property else PROPERTY
    nodes = []
    for key, depth in order[:NODES]:
        n = g.nodes[key]
        nodes.append(
            {
                "id": key, "depth": depth, "operator": shown(n, "operator", "Operator"), "name": shown(n, "name", "objectName", "ObjectName"), "rows": number(field(n, "rows", "Rows")),
                "cost": number(field(n, "cost", "Cost")), "property": shown(n, "property", "Property", limit=limit),
            }
        )
    return g, roots, order, nodes


def plan_nodes(payload) -> list[dict]:
    """The nodes of a payload's view with whole properties; none if it has no plan."""
    read = _read(payload, True)
    return read[3] if read else []


def view(payload, whole_property: bool = False) -> dict | None:
    """The view of one payload; None if it has no plan.  ``whole_property`` leaves properties uncut, for comparing."""
    if (read := _read(payload, whole_property)) is None:
        return None
    g, roots, order, nodes = read
    return {
        "uid": cut(payload.get("uid")), "sql_id": cut(field(payload, "sqlId", "sql_id")), "roots": roots, "nodes": nodes,
        "summary": summary(field(payload, "planOperationSummery", "plan_operation_summery"), list(g.nodes.values())), "node_count": len(order), "truncated": len(order) > NODES,
    }


def _loads(text) -> object:
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def views(plans: DataFrame, whole_property: bool = False) -> DataFrame:
    """``plans``: plan_id, payload (JSON text).  Adds the view's columns; payloads without a plan are left out."""
    kind = plans.schema["plan_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"plan_id": i} | v for i, p in zip(f["plan_id"], f["payload"], strict=True) if (v := view(_loads(p), whole_property))]
            yield pd.DataFrame(rows, columns=["plan_id", "uid", "sql_id", "roots", "nodes", "summary", "node_count", "truncated"])

    return plans.select("plan_id", "payload").mapInPandas(run, f"plan_id {kind}, {VIEW}")


def nodes(viewed: DataFrame) -> DataFrame:
    """One row per node: plan_id, position (from 0), and the node's fields."""
    return viewed.select("plan_id", F.posexplode("nodes").alias("position", "n")).select("plan_id", "position", "n.*")


def operator_totals(nodes: DataFrame) -> DataFrame:
    """Per plan and operator: count, rows, cost (missing as 0)."""
    z = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return nodes.groupBy("plan_id", "operator").agg(F.count(F.lit(1)).alias("count"), z("rows"), z("cost"))


def plan_stats(nodes: DataFrame) -> DataFrame:
    """Per plan: total of costs, largest row count, and the first node of the greatest cost with its share."""
    best = F.max_by(F.struct("id", "cost"), F.struct(F.coalesce("cost", F.lit(-1)), -F.col("position")))
    out = nodes.groupBy("plan_id").agg(F.sum("cost").alias("total_cost"), F.max("rows").alias("max_rows"), best.alias("b"))
    share = F.when(F.col("total_cost") > 0, F.col("b.cost") / F.col("total_cost"))
    return out.select("plan_id", "total_cost", "max_rows", F.when(F.col("b.cost").isNotNull(), F.col("b.id")).alias("hottest_id"), F.round(share, 4).alias("hottest_share"))


def plan_rows(nodes: DataFrame) -> DataFrame:
    """Nodes as they are listed: indented label, share of the plan's cost, whether hottest."""
    stats = plan_stats(nodes).select("plan_id", "total_cost", "hottest_id")
    label = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("operator"), F.when(F.col("name") != "", F.concat(F.lit("("), F.col("name"), F.lit(")"))).otherwise(""))
    out = nodes.join(stats, "plan_id", "left").withColumn("label", label).withColumn("share", F.when(F.col("total_cost") > 0, F.round(F.col("cost") / F.col("total_cost"), 4)))
    return out.withColumn("hottest", F.col("id").eqNullSafe(F.col("hottest_id"))).drop("total_cost", "hottest_id")
