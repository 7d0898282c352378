"""Plan views and comparisons."""

import json

import pytest

from tidewell.catalogue.plans import AFTER, BEFORE
from tidewell.plans import diff, normalise


def shape(v):
    return [(n["id"], n["depth"]) for n in v["nodes"]]


def test_view_shapes():
    assert normalise.view(None) is None and normalise.view({}) is None and normalise.view({"data": []}) is None and normalise.view({"data": ["x"]}) is None
    v = normalise.view(BEFORE)
    assert shape(v) == [("0", 0), ("1", 1), ("2", 1)] and v["roots"] == ["0"] and v["nodes"][0]["cost"] == 100
    flat = normalise.view({"plan_data": [{"id": 1, "children": [2]}, {"id": 2, "children": []}], "root_operations": [1]})
    assert shape(flat) == [("1", 0), ("2", 1)]
    # no id, a cycle, a child that is not there, a node that nothing reaches
    v = normalise.view({"data": [{"operator": "A", "children": [{"operator": "B"}]}, {"id": "x", "children": ["y"]}, {"id": "y", "children": ["x", "z"]}]})
    assert shape(v) == [("node-0", 0), ("node-0.0", 1), ("x", 0), ("y", 1)]
    # a repeated id: the first counts
    v = normalise.view({"data": [{"id": 1, "operator": "A"}, {"id": 1, "operator": "B"}]})
    assert [n["operator"] for n in v["nodes"]] == ["A"]


def test_view_limits():
    v = normalise.view({"data": [{"id": i, "operator": "x" * 100, "property": "p" * 300, "rows": "NaN", "cost": True} for i in range(205)], "planOperationSummery": [{"operator": "q"}] * 60})
    assert len(v["nodes"]) == 200 and v["truncated"] and v["node_count"] == 205 and len(v["summary"]) == 50
    n = v["nodes"][0]
    assert n["operator"] == "x" * 80 + "…" and n["property"] == "p" * 240 + "…" and n["rows"] is None and n["cost"] is None
    chain = {"id": 0, "operator": "A"}
    for i in range(1, 3000):
        chain = {"id": i, "operator": "A", "children": [chain]}
    assert normalise.view({"rootOperations": [chain]})["node_count"] == 3000


def test_summary():
    nodes = [{"id": 1, "operator": "S", "rows": 2, "cost": 3}, {"id": 2, "operator": "S", "rows": "5", "cost": None}, {"id": 3, "operator": "J", "rows": 1, "cost": 9}]
    one = normalise.view({"data": nodes, "planOperationSummery": [{"operator": "  S"}, {"operator": "S", "count": 7}, {"operator": "J", "cost": 1}]})["summary"]
    assert [(s["count"], s["rows"], s["cost"]) for s in one] == [(1, 2, 3), (7, 5, None), (1, 1, 1)]
    some = normalise.view({"data": nodes, "planOperationSummery": [{"operator": "S"}, {"operator": "?"}]})["summary"]
    assert [(s["count"], s["rows"], s["cost"]) for s in some] == [(2, 7, 3), (None, None, None)]


def test_regression_and_improvement():
    a, b = normalise.view(BEFORE, True), normalise.view(AFTER, True)
    d = diff.compare(a, b)
    assert d["verdict"] == "regressed" and d["cost_ratio"] == 9.6 and d["counts"] == {"changed": 1, "added": 1, "removed": 0, "same": 2}
    assert d["regressions"][0]["name"] == "t2" and diff.NO_INDEX in d["regressions"][0]["notes"] and d["access_changes"]
    [root] = d["node_tree"]
    assert [(k["operator"], k["status"]) for k in root["children"]] == [("TABLE SCAN", "changed"), ("LIMIT", "changed")]
    assert diff.compare(b, a)["verdict"] == "improved" and diff.compare(a, a)["verdict"] == "unchanged"
    with pytest.raises(ValueError):
        diff.compare(a, {})


def test_alignment():
    n = lambda *names: [diff.Node(str(i), x, "", 1, 1, "") for i, x in enumerate(names)]
    assert diff.aligned(n("a", "b", "c"), n("B", "c", "d")) == [(1, 0), (2, 1)]
    assert diff.aligned(n("a", "b"), n("b", "a")) == [(1, 0)] and diff.aligned([], n("a")) == []
    found, marked = diff.entries(n("a", "b"), n("b", "x"))
    assert [(e["status"], e["operator"]) for e in found] == [("removed", "a"), ("added", "x"), ("same", "b")] and marked == {"1"}


def test_self_cost_and_depth():
    roots = diff.forest([{"id": 1, "depth": 0, "cost": 10}, {"id": 2, "depth": 1, "cost": None}, {"id": 3, "depth": 2, "cost": 4}, {"id": 4, "depth": None, "cost": 9}, {"id": 5, "depth": 0, "cost": 1}])
    assert [r.self_cost for r in roots] == [6, 1] and roots[0].kids[0].self_cost is None and roots[0].kids[0].kids[0].self_cost == 0


@pytest.mark.parametrize("a,b,want", [(None, None, False), (None, 0, True), (5, 5, False), (5, 6, True), (100, 102, False), (100, 125, True), (0, 2, True)])
def test_material(a, b, want):
    assert diff.material(a, b) is want


def test_one_sided_lists():
    assert list(diff.property_notes("", "unstable_index_name[a,b]")) == ["统计信息不稳定索引 无 → a、b"]
    assert list(diff.property_notes("is_index_back:1", "")) == ["index_back 1 → 无"]


def test_frames(spark):
    pairs = spark.createDataFrame([(0, json.dumps(BEFORE), json.dumps(AFTER)), (1, "x", None)], "pair_id bigint, before string, after string")
    found = diff.diffs(pairs)
    assert {r.pair_id for r in found.collect()} == {0}
    assert diff.access_changes(found).count() == 1 and diff.regressions(found, worse=False).count() == 0
    rows = normalise.plan_rows(normalise.nodes(normalise.views(spark.createDataFrame([(0, json.dumps(BEFORE))], "plan_id bigint, payload string")))).orderBy("position").collect()
    assert [r.label for r in rows] == ["HASH JOIN", "  TABLE GET(t1)", "  TABLE SCAN(t2)"] and [r.hottest for r in rows] == [True, False, False]


FLAT = {"uid": "u3", "data": [{"Id": "a", "Operator": " SORT", "ObjectName": "NULL", "Rows": "3.7", "Cost": 9, "children": ["b", "c"]}, {"Id": "b", "Operator": "TABLE SCAN", "ObjectName": "t", "Rows": 3, "Cost": 4, "children": ["a"]}, {"Operator": "VALUES"}], "planOperationSummery": [{"operator": "TABLE SCAN"}, {"operator": "SORT", "cost": 1}]}


def test_whole_plans(spark):
    """Nested and flat plans, a ring of children, a plan that is none; differences both ways with their notes."""
    from tidewell.plans import normalise

    rows = [(i, json.dumps(p)) for i, p in enumerate((BEFORE, AFTER, FLAT))] + [(3, "no plan")]
    views = normalise.views(spark.createDataFrame(rows, "plan_id bigint, payload string"))
    nodes = {(r.plan_id, r.position): (r.id, r.depth, r.operator, r.name, r.rows, r.cost) for r in normalise.nodes(views).collect()}
    assert [nodes[2, k] for k in range(3)] == [("node-2", 0, "VALUES", "", None, None), ("a", 0, "SORT", "", 3, 9), ("b", 1, "TABLE SCAN", "t", 3, 4)] and len(nodes) == 10
    assert [nodes[1, k][2:] for k in range(4)] == [("HASH JOIN", "", 10, 960), ("TABLE GET", "t1", 5, 20), ("TABLE SCAN", "t2", 9000, 920), ("LIMIT", "", None, None)]
    told = views.where("plan_id = 2").selectExpr("inline(summary)").collect()
    assert [(s.operator, s["count"], s["rows"], s.cost) for s in told] == [("TABLE SCAN", 1, 3, 4), ("SORT", 1, 3, 1)]
    pairs = [(0, BEFORE, AFTER), (1, AFTER, BEFORE), (2, FLAT, FLAT)]
    found = diff.diffs(spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, a, b in pairs], "pair_id bigint, before string, after string"))
    notes = {(r.pair_id, r.path): (r.status, "; ".join(r.notes)) for r in found.collect()}
    assert notes[0, "HASH JOIN > TABLE SCAN(t2)"] == ("changed", "行数估计 10 → 9000; 自身代价 60 → 920; 可用索引 [i1, i2] → 无; 索引不可用，已退化为全表扫描; 扫描行数 10 → 9000")
    assert notes[1, "HASH JOIN > TABLE SCAN(t2)"] == ("changed", "行数估计 9000 → 10; 自身代价 920 → 60; 可用索引 无 → [i1, i2]; 扫描行数 9000 → 10")
    assert notes[0, "HASH JOIN > LIMIT"] == ("added", "新增算子") and notes[1, "HASH JOIN > LIMIT"] == ("removed", "该算子在新计划中消失") and notes[2, "SORT > TABLE SCAN(t)"] == ("same", "")
    words = {r.pair_id: (r.verdict, r.cost_ratio) for r in diff.verdicts(found).collect()}
    assert words == {0: ("regressed", 9.6), 1: ("improved", 0.104), 2: ("unchanged", 1.0)}
    assert [(r.name, r.delta) for r in diff.regressions(found).collect()] == [("t2", 860)]


def test_pairs_are_told_where_they_are_made(spark):
    """Verdicts and regressions take what a pair's entries say together from the rows: no shuffle; of the columns asked for the same values."""
    scan = lambda i, cost: {"id": i, "operator": "SCAN", "name": f"t{i}", "rows": 1, "cost": cost}
    plan = lambda *costs: json.dumps({"rootOperations": [{"id": 0, "operator": "JOIN", "rows": 1, "cost": sum(costs), "children": [scan(i, c) for i, c in enumerate(costs, 1)]}]})
    rows = [(0, plan(5, 5, 5), plan(9, 2, 9, 1)), (1, plan(5), plan(5)), (2, plan(7, 7), plan(6)), (3, "x", plan(1)), (4, plan(1), None)]
    pairs = spark.createDataFrame(rows, "pair_id bigint, before string, after string")
    whole = diff.diffs(pairs)
    ranks = {(r.pair_id, r.name): (r.worse, r.better) for r in whole.where("name <> ''").collect()}
    assert ranks == {(0, "t1"): (1, None), (0, "t2"): (None, 1), (0, "t3"): (2, None), (0, "t4"): (3, None), (1, "t1"): (None, None), (2, "t1"): (None, 2), (2, "t2"): (None, 1)}
    words = sorted((r.pair_id, r.old_cost, r.new_cost, r.changed, r.added, r.removed, r.same, r.verdict) for r in diff.verdicts(whole).collect())
    assert words == [(0, 15, 21, 3, 1, 0, 1, "regressed"), (1, 5, 5, 0, 0, 0, 2, "unchanged"), (2, 14, 6, 1, 0, 1, 1, "improved")]
    for out, some in ((diff.verdicts, diff.OF_VERDICTS), (lambda f: diff.regressions(f, limit=2).select("pair_id", "name", "delta"), diff.OF_REGRESSIONS)):
        few = out(diff.diffs(pairs, some))
        assert sorted(few.collect(), key=str) == sorted(out(whole).collect(), key=str) and "Exchange" not in few._jdf.queryExecution().executedPlan().toString()


def test_trees_read_at_once_are_those_of_the_view():
    """Inline nodes are read at once, others (flat, repeated ids, no ids, many nodes) by way of the view."""
    from tidewell.plans import normalise

    many = {"rootOperations": [{"id": 0, "operator": "A", "children": [{"id": i, "operator": " B ", "name": "NULL", "cost": str(i)} for i in range(1, 300)]}]}
    twice = {"rootOperations": [{"id": 0, "children": [{"id": 1, "cost": 2, "children": [{"id": 0}]}, {"id": 1}, {"name": "x"}]}]}
    for p in (BEFORE, AFTER, FLAT, many, twice, {}, None, [], {"rootOperations": []}, {"rootOperations": [{"id": 1}]}):
        assert diff.planted(p) == diff.forest(normalise.plan_nodes(p))
