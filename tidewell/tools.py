"""The public calls: each takes plain arguments and gives a JSON text, ``{"ok": true, ...}`` or ``{"ok": false, error, error_kind}``.

Data come from a ``Provider``; every call is one bounded query."""

from __future__ import annotations

import datetime as dt
import inspect
import json
from collections.abc import Callable
from typing import Protocol
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import bounded, chunks, ddl, dialects, errors, rerank, search
from .operators import metadata as M
from .operators.errors import DocumentError, failed, fail, ok
from .operators.postings import Stored
from .plans import diff, normalise
from .sources.corpus import safe_path

ZONE = ZoneInfo("Asia/Shanghai")
WINDOW = dt.timedelta(minutes=30)

# The calls and their labels.
LABELS = {
    "list_tenants": "获取租户列表",
    "get_tenant_info": "获取租户详情",
    "get_cluster_list": "获取集群列表",
    "get_cluster_resource_stats": "获取集群资源水位",
    "get_server_resource_stats": "获取OBServer资源水位",
    "get_slow_sql": "拉取慢SQL列表",
    "get_full_sql_text": "拉取完整SQL文本",
    "get_sql_top_plan": "拉取SQL计划uid",
    "get_sql_explain": "拉取执行计划结构",
    "compare_plans": "对比执行计划",
    "execute_sql": "执行只读 SQL",
    "get_table_ddl": "获取表结构",
    "search_docs": "检索官方文档",
    "read_doc": "精读官方文档小节",
    "read_file": "读取官方文档",
    "list_directory": "列出文档目录",
}


class Provider(Protocol):
    """Where the data are.  Each frame is lazy; ``sql`` runs a guarded statement of a tenant."""

    def tenants(self) -> DataFrame: ...
    def clusters(self) -> DataFrame: ...
    def cluster_stats(self) -> DataFrame: ...
    def server_stats(self) -> DataFrame: ...
    def slow_sql(self) -> DataFrame: ...
    def sql_text(self) -> DataFrame: ...
    def top_plans(self) -> DataFrame: ...
    def plans(self) -> DataFrame: ...
    def chunks(self) -> DataFrame | None: ...
    def postings(self) -> Stored | None: ...
    def files(self) -> DataFrame: ...
    def sql(self, tenant: str, cluster: str, database: str, kind: str, statement: str) -> bounded.Result: ...

    #: True for a provider whose statements run on Spark's own catalogue.
    local: bool = False


def window(now: dt.datetime | None = None) -> tuple[str, str]:
    """The last half hour, at the time of the call."""
    now = now or dt.datetime.now(ZONE)
    return (now - WINDOW).isoformat(timespec="seconds"), now.isoformat(timespec="seconds")


MOST, DIRECTORY = 500, 1000


def items(df: DataFrame, most: int = MOST) -> list[dict]:
    return [{k: v for k, v in r.asDict(True).items() if v is not None} for r in df.limit(most).collect()]


def listed(df: DataFrame, *order: str) -> dict:
    """The first ``MOST`` items in a stated order, and whether there are more."""
    by = [F.col(c) for c in order if c in df.columns] or [F.col(c) for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    got = items(df.orderBy(*by), MOST + 1)
    return {"items": got[:MOST], "truncated": len(got) > MOST}


class Tools:
    def __init__(self, spark: SparkSession, provider: Provider, settings: Settings | None = None, scorer: rerank.Scorer | None = None, embed_query: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.provider, self.settings, self.scorer, self.embed_query = spark, provider, settings or Settings(), scorer, embed_query

    def names(self) -> list[str]:
        return list(LABELS)

    def signature(self, name: str) -> inspect.Signature:
        return inspect.signature(getattr(self, name))

    def call(self, name: str, **args) -> str:
        if name not in LABELS:
            return fail(f"unknown call {name!r}")
        try:
            return getattr(self, name)(**args)
        except Exception as e:
            return failed(e)

    # ---- metadata ----
    def list_tenants(self) -> str:
        return ok(**listed(M.tenants(self.provider.tenants()), "clusterId", "tenantId"))

    def get_tenant_info(self, cluster_id: int, tenant_id: int) -> str:
        got = items(M.tenant(self.provider.tenants(), cluster_id, tenant_id), 1)
        return ok(**got[0]) if got else fail("no such tenant", "not_found")

    def get_cluster_list(self) -> str:
        got = listed(M.clusters(self.provider.clusters()), "clusterId")
        return ok(**got) if got["items"] else fail("no cluster", "not_found")

    def _stats(self, df: DataFrame, fields: list[str], cluster_id: int) -> str:
        key = "clusterId" if "clusterId" in df.columns else "id"
        got = listed(M.water_levels(df.where(F.col(key).cast("string") == str(cluster_id)), fields), "ip", "port")
        return ok(**got) if got["items"] else fail("no such cluster", "not_found")

    def get_cluster_resource_stats(self, cluster_id: int) -> str:
        return self._stats(self.provider.cluster_stats(), M.CLUSTER_STATS, cluster_id)

    def get_server_resource_stats(self, cluster_id: int) -> str:
        return self._stats(self.provider.server_stats(), M.SERVER_STATS, cluster_id)

    def _own(self, df: DataFrame, cluster_id, tenant_id) -> DataFrame:
        for name, value in (("clusterId", cluster_id), ("tenantId", tenant_id)):
            if name in df.columns:
                df = df.where(F.col(name).cast("string") == str(value))
        return df

    def _during(self, df: DataFrame, start: str | None, end: str | None, *columns: str) -> DataFrame:
        """Rows of a window by the first of ``columns`` that is there; an open side is open, and rows without a time stay."""
        at = next((F.col(c) for c in columns if c in df.columns), None)
        for bound, test in ((start, lambda c, t: c >= t), (end, lambda c, t: c <= t)):
            if bound and at is not None:
                df = df.where(at.isNull() | test(at, F.to_timestamp(F.lit(bound))))
        return df

    def get_slow_sql(self, cluster_id: int, tenant_id: int, start_time: str | None = None, end_time: str | None = None, server_id: int | None = None, inner: bool = False, sql_text: str | None = None, filter_expression: str | None = None, limit: int = 5, sql_text_length: int = 100) -> str:
        df = self._own(self.provider.slow_sql(), cluster_id, tenant_id)
        if server_id is not None and "serverId" in df.columns:
            df = df.where(F.col("serverId") == server_id)
        begin, end = window()
        timed = "ts" in df.columns
        at = lambda s: F.to_timestamp(F.lit(s))
        span = {"begin": at(start_time or begin), "end": at(end_time or end)} if timed else {}
        return ok(items=items(M.slow_sql(df, inner=inner, text=sql_text, expression=filter_expression, limit=limit, text_length=sql_text_length, **span)))

    def get_full_sql_text(self, cluster_id: int, tenant_id: int, sql_id: str, start_time: str | None = None, end_time: str | None = None) -> str:
        texts = self._during(self._own(self.provider.sql_text(), cluster_id, tenant_id), start_time, end_time, "ts")
        got = listed(M.sql_text(texts, sql_id), "dbName", "sqlText")
        return ok(**got) if got["items"] else fail("no such statement", "not_found")

    def get_sql_top_plan(self, cluster_id: int, tenant_id: int, sql_id: str, start_time: str | None = None, end_time: str | None = None) -> str:
        plans = M.top_plans(self._during(self._own(self.provider.top_plans(), cluster_id, tenant_id), start_time, end_time, "ts"), sql_id)
        got = items(plans, MOST + 1)
        return ok(items=got[:MOST], truncated=len(got) > MOST) if got else fail("no plan of this statement", "not_found")

    def _plan(self, uid: str, cluster_id=None, tenant_id=None, start: str | None = None, end: str | None = None) -> dict | None:
        plans = self._during(self._own(M.plan_of(self.provider.plans(), uid), cluster_id, tenant_id), start, end, "ts")
        row = plans.select("payload").first()
        return {"uid": uid} | json.loads(row.payload) if row else None

    def get_sql_explain(self, cluster_id: int, tenant_id: int, uid: str, start_time: str | None = None, end_time: str | None = None) -> str:
        p = self._plan(uid, cluster_id, tenant_id, start_time, end_time)
        if p is None:
            return fail("no such plan", "not_found")
        get = lambda *n: normalise.field(p, *n)
        return ok(items=[{"uid": p["uid"], "sql_id": get("sqlId", "sql_id"), "plan_data": get("data", "plan_data"), "plan_operation_summery": get("planOperationSummery", "plan_operation_summery"), "root_operations": get("rootOperations", "root_operations")}])

    def compare_plans(self, cluster_id: int, tenant_id: int, uid_before: str, uid_after: str, start_time: str | None = None, end_time: str | None = None, start_time_before: str | None = None, end_time_before: str | None = None, start_time_after: str | None = None, end_time_after: str | None = None) -> str:
        if uid_before == uid_after:
            return fail("the two plans are one")
        spans = ((start_time_before or start_time, end_time_before or end_time), (start_time_after or start_time, end_time_after or end_time))
        a, b = (self._plan(uid, cluster_id, tenant_id, *span) for uid, span in zip((uid_before, uid_after), spans, strict=True))
        if a is None or b is None:
            return fail("no such plan", "not_found")
        return ok(**diff.compare(normalise.view(a, True) or {}, normalise.view(b, True) or {}))

    # ---- SQL ----
    def _result(self, r: bounded.Result) -> str:
        rows = r.rows if self.settings.send_row_data else []
        return ok(columns=r.columns, rows=rows, row_count=r.row_count, truncated=r.truncated)

    def execute_sql(self, tenant_name: str, cluster_name: str, db_name: str, sql: str, tenant_type: str) -> str:
        return self._result(self.provider.sql(tenant_name, cluster_name, db_name, tenant_type, sql))

    def get_table_ddl(self, tenant_name: str, cluster_name: str, db_name: str, tenant_type: str, table_name: str) -> str:
        if getattr(self.provider, "local", False):  # its tables are Spark's own
            return self._result(ddl.show_create(self.spark, table_name))
        return self._result(dialects.table_ddl(lambda s: self.provider.sql(tenant_name, cluster_name, db_name, tenant_type, s), tenant_type, db_name, table_name))

    # ---- documents ----
    def search_docs(self, query: str, limit: int = 5, mode: str | None = None, version: str | None = None, include_index: bool = False) -> str:
        if not (query or "").strip():
            return fail("a query is needed")
        out, ledger = search.ask(
            self.provider.chunks(), query, self.spark, mode=mode, version=version, limit=limit, include_index=include_index, settings=self.settings, scorer=self.scorer, embed_query=self.embed_query,
            postings=self.provider.postings() if hasattr(self.provider, "postings") else None,
        )
        hits = [] if out is None else items(out.orderBy("position").drop("query_id", "pk", "kind"))
        more = {"degraded": ledger.degraded, "hint": dict(errors.HINTS)[ledger.degraded]} if ledger.degraded else {}
        return ok(query=query, hits=hits, hit_count=len(hits), **more)

    def read_doc(self, path: str, section: str | None = None, max_chars: int = 6000) -> str:
        index = self.provider.chunks()
        if index is None:
            raise DocumentError("the document index has not been built yet")
        got = items(chunks.read(index, safe_path(path), section, max_chars), 1)
        if not got:
            return fail("no such document or section", "not_found")
        return ok(**got[0])

    def read_file(self, file_path: str) -> str:
        row = self.provider.files().where(F.col("path") == safe_path(file_path)).select("text").first()
        return row.text if row else f"Error: no such file or directory: {file_path}"

    def list_directory(self, dir_path: str = ".") -> str:
        base = "" if dir_path in ("", ".") else safe_path(dir_path).rstrip("/") + "/"
        names = self.provider.files().where(F.startswith(F.col("path"), F.lit(base))).select(F.substring_index(F.substring("path", len(base) + 1, 1 << 20), "/", 1).alias("n")).distinct().orderBy("n")
        got = [r.n for r in names.limit(DIRECTORY + 1).collect()]
        return "\n".join([*got[:DIRECTORY], "…"][: len(got)]) or f"No files found in directory {dir_path}"


def registered(tools: Tools) -> dict[str, Callable[..., str]]:
    return {n: lambda n=n, **a: tools.call(n, **a) for n in tools.names()}
