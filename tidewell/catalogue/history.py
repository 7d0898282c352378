"""Threads, messages and the audit trail, over conversations (conv_id: thread, turn: id) and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import errors
from ..operators import history as H
from ..sources.tables import table
from ..streaming import events as E

TYPES = ["click", "error", "purchase", "signup", "view"]


def messages(spark, d):
    c = table(spark, d, "conversations")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, conv_id * 1000 + turn)")
    return c.select(F.col("conv_id").cast("string").alias("thread_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"), at.alias("created_at"))


def audit(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("thread_id"), F.col("event_type").alias("tool"), "value", F.col("ts").alias("created_at"))


def thread_list(spark, d):
    return H.threads(messages(spark, d), 500)


def thread_messages(spark, d):
    return H.thread_messages(messages(spark, d), "1", 3)


def thread_delete(spark, d):
    return H.without_thread(messages(spark, d), "1").groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))


def valid_messages(spark, d):
    own = messages(spark, d).withColumn("thread_id", F.when(F.col("id") == 3, F.concat("thread_id", F.lit("/x"))).otherwise(F.col("thread_id")))
    return H.valid_messages(own).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


def audit_list(spark, d):
    return H.audit_list(audit(spark, d), tool="error", limit=200)


def audit_thread(spark, d):
    return H.audit_list(audit(spark, d), thread_id=8, limit=50)


def audit_prune(spark, d):
    return H.audit_kept(audit(spark, d), 7, F.expr("timestamp_ntz'2024-01-31 00:00:00'")).groupBy("tool").agg(F.count(F.lit(1)).alias("kept"), F.min("id").alias("first_id"))


def args_truncate(spark, d):
    m = F.create_map(F.lit("text"), F.col("text"), F.lit("lang"), F.col("lang"))
    out = table(spark, d, "documents").select("doc_id", T.cut_values(m).alias("m"))
    return out.select("doc_id", F.length(F.col("m")["text"]).cast("bigint").alias("chars"), F.md5(F.col("m")["text"]).alias("digest"), F.col("m")["lang"].alias("lang"))


def partial_answers(spark, d):
    c = table(spark, d, "conversations")
    e = c.select(F.col("conv_id").alias("thread_id"), F.lit(0).alias("turn"), F.col("turn").alias("seq"), F.when(F.col("role") == "system", "status").otherwise("delta").alias("type"), "text")
    return H.answers(e).select("thread_id", F.length("content").cast("bigint").alias("chars"), F.md5("content").alias("digest"))


def status_changes(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("seq"), F.lit("status").alias("type"), F.col("event_type").alias("text"))
    return H.new_status(e).select("thread_id", "seq", "text")


def payload_decode(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 4
    p = F.when(k == 0, F.to_json(F.struct(F.lit(True).alias("ok"), F.col("user_id").alias("row_count"), F.lit(True).alias("truncated")))).when(k == 1, F.to_json(F.struct(F.lit(False).alias("ok"), F.col("event_type").alias("error"))))
    p = p.when(k == 2, F.concat(F.lit("Error: "), "event_type")).otherwise(F.lit("plain text"))
    return errors.decoded(e.select("event_id", p.alias("payload"))).drop("payload")


def event_kinds(spark, d):
    e = table(spark, d, "events").withColumn("event", F.when(F.col("event_type") == "click", "tool_start").when(F.col("event_type") == "view", "text").otherwise(F.col("event_type")))
    return e.select("event_id", E.kind_of(F.col("event"), F.col("value") > 10).alias("kind")).where("kind is not null")


def sse_round_trip(spark, d):
    e = table(spark, d, "events").select(F.concat(T.sse_frame(F.col("event_type")), F.lit(": ping\n\n"), T.sse_frame(F.col("props"))).alias("s"), "event_id")
    return e.select("event_id", F.array_join(T.sse_events(F.col("s")), "|").alias("events"))


def trace_pairing(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "purchase"))
    own = e.select(F.col("user_id").cast("string").alias("run_id"), F.when(F.col("event_type") == "click", "start").otherwise("end").alias("phase"), "ts", F.col("event_type").alias("tool"), F.col("props").alias("args"))
    return E.paired_batch(own)


def approval_timeout(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("signup", "click", "error"))
    kind = F.when(F.col("event_type") == "signup", "request").when(F.col("event_type") == "click", "approve").otherwise("deny")
    own = e.select(F.concat_ws("-", F.col("user_id").cast("string"), F.day("ts").cast("string")).alias("request_id"), kind.alias("type"), "ts")
    return E.approvals_batch(own, F.expr("timestamp_ntz'2024-01-30 00:00:00'"), 7200)


QUERIES = {
    f.__name__: f
    for f in (thread_list, thread_messages, thread_delete, valid_messages, audit_list, audit_thread, audit_prune, args_truncate, partial_answers, status_changes, payload_decode, event_kinds, sse_round_trip, trace_pairing, approval_timeout)
}

_M = "m AS (SELECT conv_id::VARCHAR AS thread_id, turn AS id, role, text AS content, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 1000 + turn) AS created_at FROM conversations)"
_A = "a AS (SELECT event_id AS id, user_id AS thread_id, event_type AS tool, value, ts AS created_at FROM events)"

SQL = {
    "thread_list": f"""WITH {_M}, t AS (SELECT thread_id, min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS message_count, arg_min(content, id) FILTER (WHERE role = 'user') AS u FROM m GROUP BY 1)
        SELECT thread_id, created_at, updated_at, message_count, CASE WHEN coalesce(trim(u), '') = '' THEN 'untitled' ELSE trim(left(trim(regexp_replace(u, '\\s+', ' ', 'g')), 40)) END AS title FROM t ORDER BY updated_at DESC, thread_id LIMIT 500""",
    "thread_messages": f"WITH {_M} SELECT * FROM (SELECT * FROM m WHERE thread_id = '1' ORDER BY id DESC LIMIT 3) ORDER BY id",
    "thread_delete": f"WITH {_M} SELECT thread_id, count(*) AS n FROM m WHERE thread_id <> '1' GROUP BY 1",
    "valid_messages": f"WITH {_M} SELECT role, count(*) AS n, sum(length(content))::BIGINT AS chars FROM m WHERE id <> 3 AND role IN ('user', 'assistant') GROUP BY 1",
    "audit_list": f"WITH {_A} SELECT * FROM a WHERE tool = 'error' ORDER BY id DESC LIMIT 200",
    "audit_thread": f"WITH {_A} SELECT * FROM a WHERE thread_id = 8 ORDER BY id DESC LIMIT 50",
    "audit_prune": f"WITH {_A} SELECT tool, count(*) AS kept, min(id) AS first_id FROM a WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1",
    "args_truncate": """SELECT doc_id, length(t)::BIGINT AS chars, md5(t) AS digest, lang FROM (SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END AS t, lang FROM documents)""",
    "partial_answers": "SELECT conv_id AS thread_id, sum(length(text))::BIGINT AS chars, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations WHERE role <> 'system' GROUP BY 1",
    "status_changes": """SELECT user_id AS thread_id, event_id AS seq, event_type AS text FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)""",
    "payload_decode": """SELECT event_id, event_id % 4 IN (0, 3) AS ok, CASE WHEN event_id % 4 IN (1, 2) THEN event_type ELSE '' END AS error, CASE WHEN event_id % 4 = 0 THEN user_id END AS rows, event_id % 4 = 0 AS truncated FROM events""",
    "event_kinds": "SELECT event_id, CASE event_type WHEN 'click' THEN 'status' ELSE 'delta' END AS kind FROM events WHERE event_type = 'click' OR event_type = 'view' AND value > 10",
    "sse_round_trip": "SELECT event_id, event_type || '|' || props AS events FROM events",
    "trace_pairing": """WITH e AS (SELECT user_id::VARCHAR AS run_id, event_type AS tool, event_type = 'purchase' AS is_end, ts, props AS args,
          lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS t0, lag(props) OVER (PARTITION BY user_id ORDER BY ts) AS a0
          FROM events WHERE event_type IN ('click', 'purchase'))
        SELECT run_id, CASE WHEN before = 'click' THEN 'click' ELSE tool END AS tool, CASE WHEN before = 'click' THEN a0 END AS args, CASE WHEN before = 'click' THEN t0 END AS started, ts AS ended,
          CASE WHEN before = 'click' THEN (epoch_us(ts) - epoch_us(t0)) // 1000 END AS duration_ms FROM e WHERE is_end""",
    "approval_timeout": """WITH e AS (SELECT user_id::VARCHAR || '-' || day(ts)::VARCHAR AS request_id, event_type, ts FROM events WHERE event_type IN ('signup', 'click', 'error')),
        q AS (SELECT request_id, min(ts) AS requested FROM e WHERE event_type = 'signup' GROUP BY 1),
        x AS (SELECT q.request_id, requested, min(e.ts) AS got, arg_min(event_type, e.ts) AS kind FROM q LEFT JOIN e ON e.request_id = q.request_id AND event_type <> 'signup' AND e.ts >= requested AND e.ts <= requested + INTERVAL 7200 SECOND GROUP BY ALL)
        SELECT request_id, CASE kind WHEN 'click' THEN 'approved' WHEN 'error' THEN 'denied' ELSE 'timeout' END AS outcome, requested, coalesce(got, requested + INTERVAL 7200 SECOND) AS settled
        FROM x WHERE got IS NOT NULL OR requested + INTERVAL 7200 SECOND < TIMESTAMP '2024-01-30'""",
}
