"""Tenants, clusters, resources, slow statements, guarded SQL and definitions, over the fixture tables.

nation and region stand for tenants and clusters, orders and supplier for resources, events for statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import bounded, ddl, errors, filters
from ..operators import metadata as M
from ..sources.tables import table, views

TENANT_LABELS = [("MYSQL", "MySQL tenant"), ("ORACLE", "Oracle tenant")]


def tenants(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    mode = F.when(F.col("n_nationkey") % 2 == 0, "MYSQL").otherwise("ORACLE")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("id"), F.col("r_regionkey").alias("clusterId"), F.col("r_name").alias("clusterName"), mode.alias("mode"), F.col("n_name").alias("name"), F.lit("x").alias("secret")
    )


def tenant_list(spark, d):
    return M.labelled(M.tenants(tenants(spark, d)), spark.createDataFrame(TENANT_LABELS, "name string, label string"), "mode")


def tenant_detail(spark, d):
    own = table(spark, d, "nation").where("n_nationkey = 2").first()
    return M.tenant(tenants(spark, d), own.n_regionkey, own.n_nationkey)


def cluster_list(spark, d):
    servers = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("id")).agg(F.count(F.lit(1)).alias("serverCount"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("RUNNING").alias("status"))
    return M.clusters(M.of_known(r.join(servers, "id", "left"), table(spark, d, "nation").select(F.col("n_regionkey").alias("id")), "id"))


def water_level(spark, d):
    s = F.col("o_orderstatus")
    per = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("clusterName")).agg(
        F.count_if(s == "F").alias("cpuAssigned"), F.count(F.lit(1)).alias("cpuTotal"), F.count_if(s == "O").alias("memoryAssignedByte"), F.count_if(s != "P").alias("memoryTotalByte"),
        F.count_if(s == "P").alias("dataDiskUsedByte"), F.count_if(s == "none").alias("dataDiskTotalByte"), F.lit("x").alias("timestamp"),
    )
    return M.water_levels(per, M.CLUSTER_STATS)


def node_skew(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    per = rows.join(table(spark, d, "supplier"), "s_suppkey").groupBy(F.col("s_nationkey").alias("zone")).agg(F.sum("n").alias("assigned"), F.max("n").alias("most"))
    total = F.broadcast(per.agg(F.sum("assigned").alias("total")))  # one row
    return per.join(total).select("zone", "assigned", "most", N.pct(F.col("assigned"), F.col("total")).alias("share"))


def statements(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").cast("string").alias("sqlId"), F.concat(F.lit("SELECT * FROM "), "event_type", F.lit(" WHERE user_id = "), F.col("user_id").cast("string")).alias("sqlTextShort"),
        F.col("event_type").alias("dbName"), (F.col("user_id") % 10 == 0).alias("inner"), F.get_json_object("props", "$.k").cast("bigint").alias("executions"), F.col("value").alias("avgElapsedTime"),
        (F.col("user_id") % 3).alias("failCount"), F.col("user_id").alias("userName"), "ts", F.lit("x").alias("hidden"),
    )


def slow_sql_topn(spark, d):
    return M.slow_sql(statements(spark, d), limit=20, text_length=30)


def slow_sql_keyword(spark, d):
    return M.slow_sql(statements(spark, d), inner=True, text="From PURCHASE", limit=15)


def slow_sql_filter_expr(spark, d):
    return M.slow_sql(statements(spark, d), expression="@avgElapsedTime > 50 and @executions >= 40", limit=1000)


def slow_sql_window(spark, d):
    return M.slow_sql(statements(spark, d), begin=F.expr("timestamp_ntz'2024-01-10 00:00:00'"), end=F.expr("timestamp_ntz'2024-01-10 12:00:00'"), limit=1000)


def top_plan_latest(spark, d):
    p = table(spark, d, "events").select(F.col("event_type").alias("sqlId"), F.col("event_id").alias("uid"), F.col("value").alias("avgElapsedTime"), F.col("ts").alias("firstLoadTime"))
    return M.top_plans(p, "error").limit(50)


def user_sql_bounded(spark, d):
    views(spark, d, "orders", "customer")
    got = bounded.run(spark, "select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey order by o_totalprice desc, o_orderkey")
    return spark.createDataFrame([(*r, got.truncated) for r in got.rows], "o_orderkey bigint, c_name string, o_totalprice double, truncated boolean")


def equality_where(spark, d):
    o = table(spark, d, "orders")
    return o.where(filters.equals_as_text(o["o_custkey"], "7")).select("o_orderkey", "o_custkey", "o_orderstatus")


def table_columns(spark, d):
    return ddl.columns(table(spark, d, "orders"), "orders")


def error_classify(spark, d):
    origins = F.array(*[F.lit(x) for x in ("guard", "sql", "source", "payload", "tool")])
    e = table(spark, d, "events").select("event_id", F.get(origins, (F.col("event_id") % 5).cast("int")).alias("origin"), F.concat(
        F.when(F.col("event_id") % 2 == 0, "Connection lost").otherwise("unknown column"), F.lit(" at 10.0.0."), (F.col("event_id") % 256).cast("string"), F.lit(":2881 by app@t1#c1 password=s3 id "), F.col("event_id").cast("string")
    ).alias("message"))
    return errors.classified(e).select("event_id", "kind", "shown")


def lenient_numbers(spark, d):
    o = table(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("NaN")).when(F.col("o_orderkey") % 5 == 1, F.lit("abc")).when(F.col("o_orderkey") % 5 == 2, F.lit(None)).otherwise(F.col("o_totalprice").cast("string"))
    x, y = (F.col("o_custkey") % 7), (F.col("o_orderkey") % 5)
    return o.select(
        "o_orderkey", N.lenient_int(raw).alias("as_int"), N.ms_to_us(F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise((F.col("o_custkey") % 100).cast("string"))).alias("us"),
        N.material(x, y).alias("material"), F.round(N.ratio(F.when(x == 0, F.lit(None)).otherwise(x), y), 6).alias("ratio"),
    )


QUERIES = {f.__name__: f for f in (tenant_list, tenant_detail, cluster_list, water_level, node_skew, slow_sql_topn, slow_sql_keyword, slow_sql_filter_expr, slow_sql_window, top_plan_latest, user_sql_bounded, equality_where, table_columns, error_classify, lenient_numbers)}

_TENANTS = """t AS (SELECT n_nationkey AS id, r_regionkey AS "clusterId", r_name AS "clusterName", CASE WHEN n_nationkey % 2 = 0 THEN 'MYSQL' ELSE 'ORACLE' END AS mode, n_name AS name
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_STATEMENTS = """s AS (SELECT event_id::VARCHAR AS "sqlId", 'SELECT * FROM ' || event_type || ' WHERE user_id = ' || user_id AS "sqlTextShort", event_type AS "dbName", user_id % 10 = 0 AS inner_,
  json_extract(props, '$.k')::BIGINT AS executions, value AS "avgElapsedTime", user_id % 3 AS "failCount", user_id AS "userName", ts FROM events)"""
_FIELDS = '"sqlId", "avgElapsedTime", "dbName", executions, "failCount", "userName"'

SQL = {
    "tenant_list": f"""WITH {_TENANTS} SELECT id AS "tenantId", "clusterId", "clusterName", mode, name, CASE mode WHEN 'MYSQL' THEN 'MySQL tenant' ELSE 'Oracle tenant' END AS label FROM t""",
    "tenant_detail": f"""WITH {_TENANTS} SELECT id AS "tenantId", "clusterId", "clusterName", mode, name, 'x' AS secret FROM t WHERE id = 2""",
    "cluster_list": """SELECT r_regionkey AS "clusterId", r_name AS name, 'RUNNING' AS status, c AS "serverCount" FROM region
        LEFT JOIN (SELECT n_regionkey AS k, count(*) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) ON k = r_regionkey WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""",
    "water_level": """SELECT *, CASE WHEN "cpuTotal" <> 0 THEN round_even("cpuAssigned" * 100.0::DOUBLE / "cpuTotal", 2) END AS "cpuAssignedPct",
        CASE WHEN "memoryTotalByte" <> 0 THEN round_even("memoryAssignedByte" * 100.0::DOUBLE / "memoryTotalByte", 2) END AS "memoryAssignedPct", NULL::DOUBLE AS "dataDiskUsedPct"
        FROM (SELECT o_orderpriority AS "clusterName", count(*) FILTER (WHERE o_orderstatus = 'F') AS "cpuAssigned", count(*) AS "cpuTotal", count(*) FILTER (WHERE o_orderstatus = 'O') AS "memoryAssignedByte",
              count(*) FILTER (WHERE o_orderstatus <> 'P') AS "memoryTotalByte", count(*) FILTER (WHERE o_orderstatus = 'P') AS "dataDiskUsedByte", 0::BIGINT AS "dataDiskTotalByte" FROM orders GROUP BY 1)""",
    "node_skew": """WITH r AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT s_nationkey AS zone, sum(n)::BIGINT AS assigned, max(n) AS most FROM r JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
        SELECT *, round_even((assigned * 100.0::DOUBLE / (SELECT sum(assigned) FROM p)::DOUBLE)::DECIMAL(18, 10), 2)::DOUBLE AS share FROM p""",
    "slow_sql_topn": f"""WITH {_STATEMENTS} SELECT {_FIELDS}, left("sqlTextShort", 30) AS "sqlTextShort" FROM s WHERE NOT inner_ ORDER BY "avgElapsedTime" DESC, "sqlId" LIMIT 20""",
    "slow_sql_keyword": f"""WITH {_STATEMENTS} SELECT {_FIELDS}, left("sqlTextShort", 100) AS "sqlTextShort" FROM s WHERE inner_ AND contains(lower("sqlTextShort"), 'from purchase') ORDER BY "avgElapsedTime" DESC, "sqlId" LIMIT 15""",
    "slow_sql_filter_expr": f"""WITH {_STATEMENTS} SELECT {_FIELDS}, left("sqlTextShort", 100) AS "sqlTextShort" FROM s WHERE NOT inner_ AND "avgElapsedTime" > 50 AND executions >= 40 ORDER BY "avgElapsedTime" DESC, "sqlId" LIMIT 1000""",
    "slow_sql_window": f"""WITH {_STATEMENTS} SELECT {_FIELDS}, left("sqlTextShort", 100) AS "sqlTextShort" FROM s WHERE NOT inner_ AND ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-10 12:00:00'
        ORDER BY "avgElapsedTime" DESC, "sqlId" LIMIT 1000""",
    "top_plan_latest": "SELECT event_type AS sql_id, event_id AS uid, value AS avg_elapsed_time, ts AS first_load_time FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50",
    "user_sql_bounded": """SELECT o_orderkey, c_name, o_totalprice, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) > 200 AS truncated
        FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 200""",
    "equality_where": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey::VARCHAR = '7'",
    "table_columns": """SELECT 'orders' AS table_name, i AS column_id, c AS column_name, t AS data_type FROM (VALUES (1::BIGINT, 'o_orderkey', 'bigint(20)'), (2, 'o_custkey', 'bigint(20)'), (3, 'o_orderstatus', 'varchar(64)'),
        (4, 'o_totalprice', 'decimal(10,2)'), (5, 'o_orderdate', 'datetime'), (6, 'o_orderpriority', 'varchar(64)')) v(i, c, t)""",
    "error_classify": r"""WITH m AS (SELECT event_id, ['guard', 'sql', 'source', 'payload', 'tool'][event_id % 5 + 1] AS origin,
          CASE WHEN event_id % 2 = 0 THEN 'Connection lost' ELSE 'unknown column' END || ' at 10.0.0.' || event_id % 256 || ':2881 by app@t1#c1 password=s3 id ' || event_id AS message FROM events),
        k AS (SELECT *, CASE origin WHEN 'guard' THEN 'read_only' WHEN 'sql' THEN CASE WHEN contains(lower(message), 'connect') OR contains(message, '2003') OR contains(message, '10060') OR contains(message, '10061')
          THEN 'connection' ELSE 'sql' END WHEN 'source' THEN 'ocp' WHEN 'payload' THEN 'payload' ELSE 'internal' END AS kind FROM m)
        SELECT event_id, kind, CASE kind WHEN 'connection' THEN 'connection failed or query timed out' WHEN 'internal' THEN 'internal error' ELSE
          regexp_replace(regexp_replace(regexp_replace(message, '\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b', '<host>', 'g'), '(?i)\b(password|passwd|pwd)\b\s*[=:]\s*\S+', '\1=<redacted>', 'g'),
            '\b[A-Za-z0-9_.\-]+@[A-Za-z0-9_.\-]+(?:#[A-Za-z0-9_.\-]+)?', '<account>', 'g') END AS shown FROM k""",
    "lenient_numbers": """WITH o AS (SELECT o_orderkey, o_totalprice, o_custkey % 7 AS x, o_orderkey % 5 AS y, o_custkey FROM orders)
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (3, 4) THEN trunc(o_totalprice)::BIGINT END AS as_int, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 100 * 1000 END::BIGINT AS us,
          CASE WHEN abs(y - x) <= 1 THEN abs(y - x) = 1 WHEN x = 0 THEN true ELSE abs(y / x::DOUBLE - 1) >= 0.2::DOUBLE END AS material, CASE WHEN x <> 0 THEN round(y / x::DOUBLE, 6) END AS ratio FROM o""",
}
