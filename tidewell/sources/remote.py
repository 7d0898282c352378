"""Remote sources: a control plane over HTTP (a Python data source) and SQL over JDBC; services for vectors and re-ranking."""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.errors import SourceError

BODY = 200


def fetch(url: str, params: dict | None = None, headers: dict | None = None, timeout: float = 30.0) -> dict:
    """The ``data`` of a successful envelope; anything else is one kind of error with the head of the body.  Null parameters are left out."""
    asked = {k: v for k, v in (params or {}).items() if v is not None}
    full = f"{url}?{urllib.parse.urlencode(asked)}" if asked else url
    try:
        with urllib.request.urlopen(urllib.request.Request(full, headers=headers or {}), timeout=timeout) as r:
            body = r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        raise SourceError(f"status {e.code}: {e.read().decode('utf-8', 'replace')[:BODY]}") from e
    except OSError as e:
        raise SourceError(f"unreachable: {e}") from e
    return envelope(body)


def envelope(body: str) -> dict:
    try:
        got = json.loads(body)
    except ValueError as e:
        raise SourceError(f"not JSON: {body[:BODY]}") from e
    if not isinstance(got, dict) or got.get("successful") is not True or not isinstance(got.get("data"), dict):
        raise SourceError(f"not a success: {body[:BODY]}")
    return got["data"]


def contents(data: dict) -> list:
    if not isinstance(data.get("contents"), list):
        raise SourceError("data.contents is not a list")
    return data["contents"]


class ControlPlane(DataSource):
    """format("tidewell_http"), options url, many (true: a row per item of data.contents, false: one), params (JSON), header (JSON).  One column: payload, JSON text."""

    @classmethod
    def name(cls) -> str:
        return "tidewell_http"

    def schema(self) -> str:
        return "payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        o = self.options
        data = fetch(o["url"], json.loads(o.get("params", "{}")), json.loads(o.get("header", "{}")), float(o.get("timeout", "30")))
        for item in contents(data) if o.get("many", "true") == "true" else [data]:
            yield (json.dumps(item, ensure_ascii=False),)


# Paths of the control plane, and whether a call gives a list; ids stand in braces.
CALLS = {
    "tenants": ("/api/v2/ob/tenants", True),
    "tenant": ("/api/v2/ob/clusters/{cluster_id}/tenants/{tenant_id}", False),
    "clusters": ("/api/v2/ob/clusters", True),
    "cluster_stats": ("/api/v2/ob/clusters/{cluster_id}/stats", False),
    "server_stats": ("/api/v2/ob/clusters/{cluster_id}/serverStats", True),
    "slow_sql": ("/api/v2/ob/clusters/{cluster_id}/tenants/{tenant_id}/slowSql", True),
    "sql_text": ("/api/v2/ob/clusters/{cluster_id}/tenants/{tenant_id}/sqls/{sql_id}/text", False),
    "top_plans": ("/api/v2/ob/clusters/{cluster_id}/tenants/{tenant_id}/sqls/{sql_id}/topPlan", True),
    "plan": ("/api/v2/ob/clusters/{cluster_id}/tenants/{tenant_id}/plans/{uid}/explain", False),
}


@dataclass
class Span(InputPartition):
    """What one task asks for: a tenant of a cluster, over a part of the time asked for."""

    cluster_id: int
    tenant_id: int
    begin: dt.datetime | None
    end: dt.datetime | None


class Windowed(DataSource):
    """format("tidewell_window"): a call for each of several tenants, in parallel, over a span of time.

    Options: base, call (a name of ``CALLS`` with both ids), tenants (JSON list of [cluster_id, tenant_id]), time_field (of an item), windows (parts of a span with two
    ends), header.  Columns: cluster_id, tenant_id, at, payload.  Filters on the ids choose the tasks; the latest lower and the earliest upper bound on ``at``
    go to the server as startTime and endTime, and are tested again here, as the server rounds."""

    @classmethod
    def name(cls) -> str:
        return "tidewell_window"

    def schema(self) -> str:
        return "cluster_id bigint, tenant_id bigint, at timestamp, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _WindowedReader(dict(self.options))


class _WindowedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.ids: dict[str, set] = {}
        self.begin: dt.datetime | None = None
        self.end: dt.datetime | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(f.attribute) == 1 else None
            if column in ("cluster_id", "tenant_id") and isinstance(f, EqualTo | In):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.ids[column] = self.ids[column] & values if column in self.ids else values
                continue
            if column == "at" and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                self.begin = f.value if self.begin is None else max(self.begin, f.value)
            if column == "at" and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                self.end = f.value if self.end is None else min(self.end, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        pairs = [(c, t) for c, t in json.loads(self.options["tenants"]) if c in self.ids.get("cluster_id", {c}) and t in self.ids.get("tenant_id", {t})]
        cuts: list[tuple] = [(self.begin, self.end)]
        if self.begin is not None and self.end is not None:
            n = max(1, int(self.options.get("windows", "1"))) if self.begin < self.end else 1
            step = (self.end - self.begin) / n
            edges = [self.begin + k * step for k in range(n)] + [self.end]
            cuts = list(zip(edges, edges[1:], strict=False)) if self.begin <= self.end else []
        return [Span(c, t, a, b) for c, t in pairs for a, b in cuts]

    def read(self, span: Span) -> Iterator[tuple]:
        if not isinstance(span, Span):  # no partition is left: Spark asks once all the same
            return
        o = self.options
        path, many = CALLS[o["call"]]
        shown = lambda x: None if x is None else x.isoformat(timespec="milliseconds")
        data = fetch(
            o["base"].rstrip("/") + path.format(cluster_id=span.cluster_id, tenant_id=span.tenant_id), json.loads(o.get("params", "{}")) | {"startTime": shown(span.begin), "endTime": shown(span.end)},
            json.loads(o.get("header", "{}")), float(o.get("timeout", "30")),
        )
        last = span.end is None or span.end == self.end
        for item in contents(data) if many else [data]:
            at = item.get(o.get("time_field", "requestTime"))
            at = dt.datetime.fromisoformat(at) if isinstance(at, str) else None
            if at is not None and at.tzinfo is None:
                at = at.replace(tzinfo=dt.UTC)
            # an item on the edge of two parts is of the later
            if at is not None and not last and span.end is not None and at >= _aware(span.end):
                continue
            yield (span.cluster_id, span.tenant_id, at, json.dumps(item, ensure_ascii=False))


def _aware(t: dt.datetime) -> dt.datetime:
    return t if t.tzinfo is not None else t.astimezone()


def windowed(spark: SparkSession, base: str, name: str, tenants: list[tuple[int, int]], windows: int = 1, time_field: str = "requestTime", header: dict | None = None) -> DataFrame:
    """A call of the control plane for several tenants: filters on cluster_id, tenant_id and at decide what is asked of the server."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Windowed)
    reader = spark.read.format("tidewell_window").option("base", base).option("call", name).option("tenants", json.dumps([list(t) for t in tenants]))
    return reader.option("windows", str(windows)).option("time_field", time_field).option("header", json.dumps(header or {})).load()


def call(spark: SparkSession, base: str, name: str, ids: dict | None = None, params: dict | None = None, header: dict | None = None) -> DataFrame:
    """One call of the control plane as a DataFrame of payloads."""
    spark.dataSource.register(ControlPlane)
    path, many = CALLS[name]
    url = base.rstrip("/") + path.format(**(ids or {}))
    reader = spark.read.format("tidewell_http").option("url", url).option("many", str(many).lower())
    return reader.option("params", json.dumps({k: v for k, v in (params or {}).items() if v is not None})).option("header", json.dumps(header or {})).load()


def login(user: str, tenant: str, cluster: str) -> str:
    """user@tenant#cluster, unless the user names a tenant already."""
    return user if "@" in user else f"{user}@{tenant}#{cluster}"


def route(hosts: dict[str, str], tenant: str, cluster: str, database: str, kind: str, user: str, password: str, port: int = 2883) -> dict[str, str]:
    """JDBC options for a tenant of a cluster; an unknown cluster or kind is an error that names the known ones."""
    if kind not in ("MYSQL", "ORACLE"):
        raise ValueError(f"unknown tenant type {kind!r}: MYSQL or ORACLE")
    if cluster not in hosts:
        raise ValueError(f"unknown cluster {cluster!r}: {', '.join(sorted(hosts)) or 'none is configured'}")
    at = hosts[cluster] if ":" in hosts[cluster] else f"{hosts[cluster]}:{port}"
    url = f"jdbc:mysql://{at}/{database}" if kind == "MYSQL" else f"jdbc:oracle:thin:@//{at}/{database}"
    return {"url": url, "user": login(user, tenant, cluster), "password": password}


def jdbc(spark: SparkSession, options: dict[str, str], sql: str, max_rows: int = 200) -> DataFrame:
    """A guarded statement run by the remote server, of which one row more than ``max_rows`` is fetched."""
    from ..operators.sqlguard import check

    return spark.read.format("jdbc").options(**options).option("query", check(sql).strip().rstrip(";")).option("fetchsize", str(max_rows + 1)).load().limit(max_rows + 1)


# ---- vectors and re-ranking ----
RETRY_STATUS, WAITS, BATCH = (403, 429), (5, 20, 60, 120), 20


def post(url: str, payload: dict, key: str = "", timeout: float = 30.0, waits: tuple[int, ...] = ()) -> dict:
    """A JSON call; throttling and server errors are tried again after ``waits`` or the server's own Retry-After."""
    return tried(url, payload, key, timeout, waits)[0]


def tried(url: str, payload: dict, key: str = "", timeout: float = 30.0, waits: tuple[int, ...] = ()) -> tuple[dict, int]:
    """The answer of a JSON call, and how often it was tried again."""
    header = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    for again, wait in enumerate((*waits, None)):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(payload).encode(), header), timeout=timeout) as r:
                return json.loads(r.read()), again
        except urllib.error.HTTPError as e:
            if wait is None or e.code not in RETRY_STATUS and e.code < 500:
                raise SourceError(f"status {e.code}") from e
            time.sleep(float(e.headers.get("Retry-After") or wait))
        except (OSError, ValueError) as e:
            raise SourceError(str(e)) from e
    raise SourceError("no answer")


def vectors_of(answer: dict, n: int, dims: int) -> list[list[float]]:
    """Vectors of an answer in the order of the texts; a wrong count or length is an error."""
    items = sorted(answer.get("data") or [], key=lambda x: x["index"])
    out = [x["embedding"] for x in items]
    if len(out) != n or any(len(v) != dims for v in out):
        raise SourceError("the answer has other vectors than asked for")
    return out


def embedder(url: str, model: str, dims: int, key: str = "", batch: int = BATCH, waits: tuple[int, ...] = WAITS):
    """A function from (pk, canonical) to (pk, vector, requests, retries), in batches where the rows are; a batch's first row tells what it took."""

    def embed(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, min(batch, BATCH)):
                    part = b.slice(at, min(batch, BATCH))
                    texts = part.column(1).to_pylist()
                    answer, again = tried(url, {"model": model, "input": texts, "dimensions": dims}, key, waits=waits)
                    got, rest = vectors_of(answer, len(texts), dims), [0] * (len(texts) - 1)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.float32())), pa.array([1, *rest], pa.int32()), pa.array([again, *rest], pa.int32())], ["pk", "vector", "requests", "retries"])

        return rows.select("pk", "canonical").mapInArrow(run, "pk bigint, vector array<float>, requests int, retries int")

    return embed


def hashed_vectors(dims: int = 64):
    """A deterministic embedder without a model: signed hashes of the text's tokens."""

    def embed(rows: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F

        from ..functions.text import tokens

        t = tokens(F.col("canonical"))
        h = lambda x, k: F.xxhash64(x, F.lit(k))
        one = lambda k: F.aggregate(t, F.lit(0.0), lambda a, x: a + F.when(F.pmod(h(x, 0), F.lit(dims)) == k, F.when(h(x, 1) > 0, 1.0).otherwise(-1.0)).otherwise(0.0))
        return rows.select("pk", F.array(*[one(k) for k in range(dims)]).cast("array<float>").alias("vector"))

    return embed


def rerank_payload(protocol: str, model: str, query: str, passages: list[str], top_n: int) -> dict:
    if protocol == "dashscope":
        return {"model": model, "input": {"query": query, "documents": passages}, "parameters": {"top_n": top_n, "return_documents": False}}
    return {"model": model, "query": query, "documents": passages, "top_n": top_n, "return_documents": False}


def rerank_answer(answer: dict, n: int) -> list[tuple[int, float]]:
    """(index, score), best first; made-up positions are left out, an empty answer is an error."""
    raw = answer.get("results") or (answer.get("output") or {}).get("results") or []
    got = []
    for r in raw:
        score = r.get("relevance_score", r.get("score"))
        if isinstance(r.get("index"), int) and 0 <= r["index"] < n and score is not None:
            got.append((r["index"], float(score)))
    if not got:
        raise SourceError("nothing was ranked")
    return sorted(got, key=lambda x: (-x[1], x[0]))


def api_scorer(url: str, model: str, key: str = "", protocol: str = "jina", timeout: float = 3.0):
    """A scorer that asks a service once per query."""

    def score(query: str, passages: list[str]) -> list[tuple[int, float]]:
        return rerank_answer(post(url, rerank_payload(protocol, model, query, passages, len(passages)), key, timeout), len(passages))

    return score
