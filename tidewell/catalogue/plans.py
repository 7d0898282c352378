"""Plan views, comparisons and operator sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import diff as D
from ..plans import normalise as N
from ..sources.tables import table


def _node(i, op, rows, cost, name="", prop="", kids=()):
    return {"id": i, "operator": op, "name": name, "rows": rows, "cost": str(cost), "property": prop, "children": list(kids)}


#: One join over two scans; after the change the second scan has lost its index.
BEFORE = {"uid": "u1", "sqlId": "s1", "rootOperations": [_node(0, "HASH JOIN", 10, 100, kids=[_node(1, "TABLE GET", 5, 20, "t1"), _node(2, "TABLE SCAN", 10, 60, "t2", "available_index_name[i1, i2] physical_range_rows:10 access(a, b)")])]}
AFTER = {"uid": "u2", "sqlId": "s1", "rootOperations": [_node(0, "HASH JOIN", 10, 960, kids=[_node(1, "TABLE GET", 5, 20, "t1"), _node(2, "TABLE SCAN", 9000, 920, "t2", "available_index_name[] physical_range_rows:9000 access(a, b)"), _node(3, "LIMIT", "NULL", None)])]}


def _lines(spark, d):
    """Line items as nodes: a plan per flag, an operator per status."""
    item = table(spark, d, "lineitem")
    return item.select(
        F.col("l_returnflag").alias("plan_id"), F.col("l_linestatus").alias("operator"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.col("l_quantity").cast("bigint").alias("rows"), F.when(F.col("l_linenumber") != 3, F.col("l_partkey")).alias("cost"), F.lit("").alias("name"), F.lit(0).alias("depth"),
    )


def operator_summary(spark, d):
    return N.operator_totals(_lines(spark, d))


def plan_stats(spark, d):
    return N.plan_stats(_lines(spark, d))


def plan_self_cost(spark, d):
    """Cumulative costs over region, nation and customer: each node's own share, by edges to its parent."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    leaf = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("inner"))
    nations = n.join(leaf, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), (F.coalesce("inner", F.lit(0)) * 2 + F.col("n_nationkey")).alias("cost"), F.coalesce("inner", F.lit(0)).alias("below"))
    per = nations.groupBy("parent").agg(F.sum("cost").alias("below"))
    regions = per.select(F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent"), (F.col("below") + 100).alias("cost"), "below")
    return nations.unionByName(regions).select("id", "cost", F.greatest(F.col("cost") - F.col("below"), F.lit(0)).alias("self_cost"))


def property_fields(spark, d):
    from ..functions.text import index_list, property_numbers

    o = table(spark, d, "orders")
    text = F.concat(F.lit("table_rows:"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(", avaiable_index_name[i1, i"), F.col("o_custkey").cast("string"), F.lit("]"))).otherwise(""), F.lit(" output_rows : 7"))
    p = property_numbers(text)
    return o.select("o_orderkey", p["table_rows"].alias("table_rows"), p["output_rows"].alias("output_rows"), p["use_das"].alias("use_das"), F.array_join(index_list(text), "+").alias("indexes"))


QUERIES = {f.__name__: f for f in (operator_summary, plan_stats, plan_self_cost, property_fields)}

SQL = {
    "operator_summary": """SELECT l_returnflag AS plan_id, l_linestatus AS operator, count(*) AS count, sum(l_quantity::BIGINT)::BIGINT AS rows, sum(CASE WHEN l_linenumber <> 3 THEN l_partkey ELSE 0 END)::BIGINT AS cost FROM lineitem GROUP BY 1, 2""",
    "plan_stats": """WITH n AS (SELECT l_returnflag AS plan_id, l_orderkey || '-' || l_linenumber AS id, l_orderkey * 10 + l_linenumber AS pos, l_quantity::BIGINT AS rows, CASE WHEN l_linenumber <> 3 THEN l_partkey END AS cost FROM lineitem),
        t AS (SELECT plan_id, sum(cost)::BIGINT AS total_cost, max(rows) AS max_rows, max(cost) AS top FROM n GROUP BY 1), f AS (SELECT n.plan_id, arg_min(id, pos) AS hottest_id FROM n JOIN t ON n.plan_id = t.plan_id AND n.cost = t.top GROUP BY 1)
        SELECT plan_id, total_cost, max_rows, hottest_id, round(top / total_cost::DOUBLE, 4) AS hottest_share FROM t JOIN f USING (plan_id)""",
    "plan_self_cost": """WITH l AS (SELECT n_nationkey AS k, n_regionkey AS r, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS inner_ FROM nation), n AS (SELECT *, inner_ * 2 + k AS cost FROM l)
        SELECT 'n' || k AS id, cost, greatest(cost - inner_, 0) AS self_cost FROM n UNION ALL SELECT 'r' || r, (sum(cost) + 100)::BIGINT, 100 FROM n GROUP BY r""",
    "property_fields": """SELECT o_orderkey, o_orderkey AS table_rows, 7::BIGINT AS output_rows, NULL::BIGINT AS use_das, CASE WHEN o_orderkey % 2 = 0 THEN 'i1+i' || o_custkey END AS indexes FROM orders""",
}
