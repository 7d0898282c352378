"""Sources, settings and the public calls."""

import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidewell import config, tools
from tidewell.catalogue.plans import AFTER, BEFORE
from tidewell.operators import bounded, chunks, dialects, errors
from tidewell.sources import corpus, fixtures, remote


# ---- sources ----
def test_documents_of_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"uid": "x", "n": {"k": [1]}}, {"uid": "y"}]))
    assert fixtures.json_document(spark, str(tmp_path / "a.json"), "uid string").count() == 2
    got = {r.uid: json.loads(r.payload) for r in fixtures.text_document(spark, str(tmp_path / "a.json"), "uid").collect()}
    assert got == {"x": {"uid": "x", "n": {"k": [1]}}, "y": {"uid": "y"}}


def test_sample_tables(spark):
    fixtures.sample_views(spark, {"Orders7": {"columns": ["id", "at", "day", "ok", "price", "note"], "rows": [[1, "2024-01-02 03:04:05", "2024-01-02", True, 1.5, None], [2, None, None, None, None, "x"]]}})
    assert [t for _, t in spark.table("orders7").dtypes] == ["bigint", "timestamp_ntz", "date", "boolean", "double", "string"]
    assert bounded.run(spark, "select id from ORDERS7 where ok").rows == [[1]]
    assert fixtures.audit_view(spark.sql("select 'i' sql_id, 's' sql_text, 'd' db_name, 1 avg_elapsed_us, 2 exec_count, 3 other")).columns[-1] == "exec_count"
    plans = [{"match": "orders"}, {"match": ""}]
    assert fixtures.canned_plan(plans, "select * from ORDERS") is plans[0] and fixtures.canned_plan(plans, "from preorders") is plans[1]
    with pytest.raises(errors.SqlError):
        fixtures.canned_plan(plans[:1], "x")


def test_corpus(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_bytes(b"# A\nbad \xff byte")
    (tmp_path / "b.md").write_text("b")
    (tmp_path / "c.txt").write_text("c")
    files = corpus.markdown(spark, str(tmp_path))
    assert {r.path: r.text for r in files.collect()} == {"d/a.md": "# A\nbad \ufffd byte", "b.md": "b"}
    assert [r.path for r in corpus.markdown(spark, str(tmp_path), 1).collect()] == ["b.md"] and corpus.paths(files).where("path = 'ob_wiki/b.md'").count() == 1
    assert corpus.safe_path("doc/ob_wiki/d/./a.md") == "d/a.md"
    for bad in ("", "/etc/passwd", "../x", "a/../../b", "C:\\x", "a\\..\\b"):
        with pytest.raises(errors.DocumentPathError):
            corpus.safe_path(bad)


def test_cases(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('# note\n\n{"id": "a", "query": "q", "expect": "x", "tag": "t"}\n{"id": "b", "query": "q", "expect": ["x", "y"], "include_index": true}\n')
    assert [(r.case_id, r.expect, r.tag, r.include_index) for r in corpus.cases(spark, str(p)).collect()] == [("a", ["x"], "t", False), ("b", ["x", "y"], "", True)]
    for text, line in (('{"id": "a"}', 1), ('\n{"id": "a", "query": "q", "expect": "x"}\n{"id": "a", "query": "q", "expect": "x"}', 3), ("{", 1)):
        p.write_text(text)
        with pytest.raises(ValueError, match=f"line {line}"):
            corpus.cases(spark, str(p))


def test_unpack(tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for n in ("top/a.md", "top/sub/b.md", "top/.hidden", "__MACOSX/top/a.md"):
            z.writestr(n, n)
    assert fixtures.unpack(str(tmp_path / "z.zip"), str(tmp_path / "out")) == 2 and (tmp_path / "out/sub/b.md").read_text() == "top/sub/b.md"
    assert fixtures.unpack(str(tmp_path / "z.zip"), str(tmp_path / "out")) == 0
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../../x", "x")
    with pytest.raises(ValueError):
        fixtures.unpack(str(tmp_path / "bad.zip"), str(tmp_path / "out"))


class Server(BaseHTTPRequestHandler):
    answers = {
        "/api/v2/ob/tenants": (200, {"successful": True, "data": {"contents": [{"id": 1, "name": "t"}, {"id": 2}]}}), "/api/v2/ob/clusters/7/stats": (200, {"successful": True, "data": {"cpuTotal": 4}}), "/bad": (200, {"successful": False}), "/gone": (500, {}),
        "/vec": (200, {"data": [{"index": 1, "embedding": [0, 1]}, {"index": 0, "embedding": [1, 0]}]}), "/rank": (200, {"output": {"results": [{"index": 0, "relevance_score": 0.1}, {"index": 1, "score": 0.9}, {"index": 9, "score": 1}]}}),
    }

    def do_GET(self):
        code, body = self.answers[self.path.split("?")[0]]
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_POST(self):
        self.rfile.read(int(self.headers["Content-Length"]))
        self.do_GET()

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def server():
    s = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_control_plane(spark, server):
    got = remote.call(spark, server, "tenants", params={"a": None})
    assert sorted(json.loads(r.payload)["id"] for r in got.collect()) == [1, 2]
    assert json.loads(remote.call(spark, server, "cluster_stats", {"cluster_id": 7}).first().payload) == {"cpuTotal": 4}
    for path in ("/bad", "/gone"):
        with pytest.raises(errors.SourceError):
            remote.fetch(server + path)
    for body in ("x", "[]", "{}", '{"successful": true}', '{"successful": true, "data": []}'):
        with pytest.raises(errors.SourceError):
            remote.envelope(body)
    with pytest.raises(errors.SourceError):
        remote.contents({"contents": {}})


@pytest.fixture()
def statements():
    """A slow-statement service that answers by its parameters and keeps what it was asked."""
    import datetime as dt
    from urllib.parse import parse_qs, urlsplit

    asked = []
    rows = [(c, t, dt.datetime(2024, 1, 1, h, tzinfo=dt.UTC)) for c in (1, 2) for t in (10, 20) for h in range(24)]

    def aware(s):
        x = dt.datetime.fromisoformat(s)
        return x if x.tzinfo else x.replace(tzinfo=dt.UTC)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            u = urlsplit(self.path)
            q = {k: v[0] for k, v in parse_qs(u.query).items()}
            asked.append((u.path, q))
            c, t = (int(u.path.split("/")[k]) for k in (5, 7))
            got = [{"sqlId": f"{c}-{t}-{at.hour}", "requestTime": at.isoformat()} for a, b, at in rows if (a, b) == (c, t) and ("startTime" not in q or aware(q["startTime"]) <= at) and ("endTime" not in q or at <= aware(q["endTime"]))]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"successful": True, "data": {"contents": got}}).encode())

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_filters_arrive_at_the_server(spark, statements):
    url, asked = statements
    tenants = [(c, t) for c in (1, 2) for t in (10, 20)]
    every = remote.windowed(spark, url, "slow_sql", tenants, windows=3)
    assert every.count() == 96 and len(asked) == 4 and all(not q for _, q in asked)
    asked.clear()
    # ids choose the calls, bounds go into the address in three parts, and what the server cannot know is tested here
    some = every.where("cluster_id = 2 and tenant_id in (20, 30) and at >= timestamp'2024-01-01 03:00:00' and at < timestamp'2024-01-01 09:00:00' and payload not like '%-5%'")
    assert sorted(r["at"].hour for r in some.selectExpr("at").collect()) == [3, 4, 6, 7, 8]
    assert {p for p, _ in asked} == {"/api/v2/ob/clusters/2/tenants/20/slowSql"} and sorted(q["startTime"][11:16] for _, q in asked) == ["03:00", "05:00", "07:00"] and sorted(q["endTime"][11:16] for _, q in asked) == ["05:00", "07:00", "09:00"]
    asked.clear()
    assert every.where("cluster_id = 9").count() == 0 and every.where("at > timestamp'2024-01-02' and at < timestamp'2024-01-01'").count() == 0 and not asked
    assert every.where("at = timestamp'2024-01-01 07:00:00'").count() == 4


def test_services(spark, server):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "pk bigint, canonical string").coalesce(1)
    assert {r.pk: r.vector for r in remote.embedder(server + "/vec", "m", 2)(rows).collect()} == {1: [1.0, 0.0], 2: [0.0, 1.0]}
    assert remote.api_scorer(server + "/rank", "m")("q", ["a", "b"]) == [(1, 0.9), (0, 0.1)]
    for bad in ({}, {"results": []}, {"results": [{"index": 5, "score": 1}]}):
        with pytest.raises(errors.SourceError):
            remote.rerank_answer(bad, 2)
    with pytest.raises(errors.SourceError):
        remote.vectors_of({"data": [{"index": 0, "embedding": [1]}]}, 1, 2)
    assert remote.rerank_payload("dashscope", "m", "q", ["p"], 1)["input"]["documents"] == ["p"]


def test_routing():
    assert remote.login("u", "t", "c") == "u@t#c" and remote.login("u@x#y", "t", "c") == "u@x#y"
    o = remote.route({"c": "h"}, "t", "c", "db", "MYSQL", "u", "p")
    assert o["url"] == "jdbc:mysql://h:2883/db" and o["user"] == "u@t#c"
    assert remote.route({"c": "h:1"}, "t", "c", "s", "ORACLE", "u", "p")["url"].endswith("//h:1/s")
    for args in (({"c": "h"}, "t", "other", "db", "MYSQL", "u", "p"), ({"c": "h"}, "t", "c", "db", "X", "u", "p")):
        with pytest.raises(ValueError):
            remote.route(*args)


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"pool_k": 7, "max_rows": 9}')
    s = config.load(str(tmp_path / "s.json"), {"TIDEWELL_POOL_K": "8", "TIDEWELL_SEND_ROW_DATA": "off", "TIDEWELL_RRF_K": "  "})
    assert (s.pool_k, s.max_rows, s.send_row_data, s.rrf_k) == (8, 9, False, 60)
    (tmp_path / "s.yaml").write_text("pool_k: 6\n")
    assert config.load(str(tmp_path / "s.yaml"), {}).pool_k == 6
    for bad in ({"TIDEWELL_MAX_ROWS": "0"}, {"TIDEWELL_SEND_ROW_DATA": "maybe"}, {"TIDEWELL_DEFAULT_RETRIEVER": "x"}, {"TIDEWELL_WEIGHT_SPARSE": "-1"}):
        with pytest.raises(ValueError):
            config.load(None, bad)


# ---- calls ----
class Local:
    local = True

    def __init__(self, spark):
        self.spark = spark

    def _df(self, rows):
        return self.spark.createDataFrame(rows)

    def tenants(self):
        return self._df([{"id": 1, "clusterId": 5, "name": "a", "mode": "MYSQL", "extra": "x"}, {"id": 2, "clusterId": 5, "name": "b", "mode": "ORACLE", "extra": "y"}])

    def clusters(self):
        return self._df([{"id": 5, "name": "c", "other": 1}])

    def cluster_stats(self):
        return self._df([{"clusterId": 5, "cpuAssigned": 2.0, "cpuTotal": 4.0, "memoryAssignedByte": 1.0, "memoryTotalByte": 0.0, "timestamp": 1}])

    def server_stats(self):
        return self._df([{"clusterId": 5, "ip": "h1", "cpuAssigned": 7.0, "cpuTotal": 8.0}, {"clusterId": 5, "ip": "h2", "cpuAssigned": 2.0, "cpuTotal": 3.0}])

    def slow_sql(self):
        return self._df([{"sqlId": f"s{i}", "sqlTextShort": f"select {i} from T", "inner": i == 0, "avgElapsedTime": float(i), "executions": i, "clusterId": 5, "tenantId": 1, "secret": 1} for i in range(9)])

    def sql_text(self):
        return self._df([{"sqlId": "s1", "fulltext": "select 1", "dbName": "d", "tables": ["t"]}])

    def top_plans(self):
        return self._df([{"sqlId": "s1", "uid": u, "avgElapsedTime": 1.0, "firstLoadTime": t} for u, t in (("old", "2024-01-01"), ("new", "2024-01-02"))])

    def plans(self):
        return self._df([{"uid": u, "payload": json.dumps(p)} for u, p in (("u1", BEFORE), ("u2", AFTER))])

    def files(self):
        return self.spark.createDataFrame([("a/lock.md", "---\ntitle: Lock waits\n---\n## Cause\nA lock waits for another session.\n## Cure\nEnd the session."), ("index.md", "# lock lock lock"), ("a/v.md", "## New in V4.2\nlock table syntax")], "path string, text string")

    def chunks(self):
        return chunks.payloads(self.files())

    def sql(self, tenant, cluster, database, kind, statement):
        return bounded.run(self.spark, statement)


@pytest.fixture(scope="module")
def calls(spark):
    return tools.Tools(spark, Local(spark))


def ask(calls, name, **args):
    return json.loads(calls.call(name, **args))


def test_metadata_calls(calls):
    assert ask(calls, "list_tenants")["items"][0] == {"tenantId": 1, "clusterId": 5, "name": "a", "mode": "MYSQL"}
    assert ask(calls, "get_tenant_info", cluster_id="5", tenant_id="2")["extra"] == "y" and ask(calls, "get_tenant_info", cluster_id=5, tenant_id=9)["error_kind"] == "not_found"
    assert ask(calls, "get_cluster_list")["items"] == [{"clusterId": 5, "name": "c"}]
    assert ask(calls, "get_cluster_resource_stats", cluster_id=5)["items"] == [{"clusterId": 5, "cpuTotal": 4.0, "cpuAssigned": 2.0, "memoryTotalByte": 0.0, "memoryAssignedByte": 1.0, "cpuAssignedPct": 50.0}]
    assert [i["cpuAssignedPct"] for i in ask(calls, "get_server_resource_stats", cluster_id=5)["items"]] == [87.5, 66.67]
    assert ask(calls, "get_server_resource_stats", cluster_id=6)["ok"] is False
    assert [i["sqlId"] for i in ask(calls, "get_slow_sql", cluster_id=5, tenant_id=1, filter_expression="@executions < 8", limit=2)["items"]] == ["s7", "s6"]
    assert "secret" not in ask(calls, "get_slow_sql", cluster_id=5, tenant_id=1, sql_text="FROM t")["items"][0]
    assert ask(calls, "get_full_sql_text", cluster_id=5, tenant_id=1, sql_id="s1")["items"] == [{"sqlText": "select 1", "dbName": "d", "tables": ["t"]}]
    assert [i["uid"] for i in ask(calls, "get_sql_top_plan", cluster_id=5, tenant_id=1, sql_id="s1")["items"]] == ["new", "old"]
    assert ask(calls, "get_sql_explain", cluster_id=5, tenant_id=1, uid="u1")["items"][0]["sql_id"] == "s1"


def test_plan_and_sql_calls(calls, spark):
    assert ask(calls, "compare_plans", cluster_id=5, tenant_id=1, uid_before="u1", uid_after="u2")["verdict"] == "regressed"
    assert ask(calls, "compare_plans", cluster_id=5, tenant_id=1, uid_before="u1", uid_after="u1")["ok"] is False
    where = {"tenant_name": "t", "cluster_name": "c", "db_name": "d", "tenant_type": "MYSQL"}
    assert ask(calls, "execute_sql", sql="select 1 as x", **where) == {"ok": True, "columns": ["x"], "rows": [[1]], "row_count": 1, "truncated": False}
    assert ask(calls, "execute_sql", sql="drop table x", **where)["error_kind"] == "read_only" and ask(calls, "execute_sql", sql="select nothing", **where)["error_kind"] == "sql"
    spark.range(1).createOrReplaceTempView("one")
    assert ask(calls, "get_table_ddl", table_name="one", **where)["row_count"] == 1
    assert ask(calls, "nothing")["ok"] is False and set(calls.names()) == set(tools.registered(calls)) and "sql" in str(calls.signature("execute_sql"))


def test_document_calls(calls):
    got = ask(calls, "search_docs", query="lock waits session")
    assert got["hits"][0]["path"] == "a/lock.md" and all(h["path"] != "index.md" for h in got["hits"]) and got["hit_count"] == len(got["hits"])
    assert {h["path"] for h in ask(calls, "search_docs", query="lock", include_index=True)["hits"]} >= {"index.md"}
    assert ask(calls, "search_docs", query="lock", version="4.2")["hit_count"] >= 1 and ask(calls, "search_docs", query="lock V9.9 syntax")["hit_count"] >= 1 and ask(calls, "search_docs", query=" ")["ok"] is False
    doc = ask(calls, "read_doc", path="doc/a/lock.md", section="cure")
    assert doc["text"] == "End the session." and doc["sections"] == ["Cure"]
    assert ask(calls, "read_doc", path="../x")["ok"] is False and ask(calls, "read_doc", path="none.md")["error_kind"] == "not_found"
    assert calls.call("read_file", file_path="index.md") == "# lock lock lock" and calls.call("read_file", file_path="no.md").startswith("Error:") and calls.call("list_directory") == "a\nindex.md" and calls.call("list_directory", dir_path="a") == "lock.md\nv.md"


def test_errors():
    assert errors.kind_of_exception(errors.ReadOnlyViolation("x"))[0] == "read_only" and errors.kind_of_exception(errors.SqlError("Timed out"))[0] == "connection" and errors.kind_of_exception(errors.SourceError("at 1.2.3.4"))[1] == "at <host>"
    assert errors.kind_of_exception(KeyError("k"))[0] == "payload" and errors.kind_of_exception(OSError("secret"))[1] == "internal error (OSError)"
    assert json.loads(errors.failed(ValueError("x")))["error_kind"] == "internal"


def test_hints(spark):
    df = spark.createDataFrame([("index_missing",), (None,), ("other",)], "degraded string")
    assert [bool(r.hint) for r in errors.with_hints(df).orderBy(F.col("degraded").desc_nulls_last()).collect()] == [False, True, False]


class Timed(Local):
    """Rows with times, clusters and tenants; statements are asked of the tenant."""

    local = False

    def __init__(self, spark):
        super().__init__(spark)
        self.asked = []

    def _at(self, rows):
        return self._df([r | {"clusterId": 5, "tenantId": 1} for r in rows]).withColumn("ts", F.to_timestamp("ts"))

    def sql_text(self):
        return self._at([{"sqlId": "s1", "fulltext": f"select {h}", "dbName": "d", "tables": ["t"], "ts": f"2024-01-01 {h:02}:00:00"} for h in (1, 5)])

    def top_plans(self):
        return self._at([{"sqlId": "s1", "uid": f"p{h}", "avgElapsedTime": 1.0, "firstLoadTime": f"2024-01-01 {h:02}", "ts": f"2024-01-01 {h:02}:00:00"} for h in (1, 5)])

    def plans(self):
        return self._at([{"uid": u, "payload": json.dumps(p), "ts": t} for u, p, t in (("u1", BEFORE, "2024-01-01 01:00:00"), ("u2", AFTER, "2024-01-01 05:00:00"))])

    def tenants(self):
        return self.spark.range(tools.MOST + 3).select("id", F.lit(5).alias("clusterId"), F.lit("n").alias("name"))

    def sql(self, tenant, cluster, database, kind, statement):
        self.asked.append((tenant, kind, statement))
        return bounded.Result(["c"], [["x"]])


def test_windows_narrow_every_call(spark):
    own = tools.Tools(spark, Timed(spark))
    where = {"cluster_id": 5, "tenant_id": 1}
    late = {"start_time": "2024-01-01 03:00:00", "end_time": "2024-01-01 09:00:00"}
    assert [x["sqlText"] for x in ask(own, "get_full_sql_text", sql_id="s1", **where)["items"]] == ["select 1", "select 5"]
    assert [x["sqlText"] for x in ask(own, "get_full_sql_text", sql_id="s1", **where, **late)["items"]] == ["select 5"]
    assert [x["uid"] for x in ask(own, "get_sql_top_plan", sql_id="s1", **where, **late)["items"]] == ["p5"]
    assert ask(own, "get_sql_explain", uid="u1", **where)["ok"] and ask(own, "get_sql_explain", uid="u1", **where, **late)["error_kind"] == "not_found"
    assert ask(own, "get_sql_explain", uid="u1", cluster_id=6, tenant_id=1)["error_kind"] == "not_found"
    both = {"uid_before": "u1", "uid_after": "u2"} | where
    assert ask(own, "compare_plans", **both)["ok"] and not ask(own, "compare_plans", **both, **late)["ok"]
    assert ask(own, "compare_plans", **both, **late, start_time_before="2024-01-01 00:00:00", end_time_before="2024-01-01 02:00:00")["ok"]
    got = ask(own, "list_tenants")
    assert len(got["items"]) == tools.MOST and got["truncated"] and [x["tenantId"] for x in got["items"][:3]] == [0, 1, 2]


def test_definitions_are_asked_of_the_tenant(spark):
    source = Timed(spark)
    own = tools.Tools(spark, source)
    where = {"tenant_name": "t", "cluster_name": "c", "db_name": "d"}
    assert ask(own, "get_table_ddl", table_name="s.one", tenant_type="MYSQL", **where)["row_count"] == 1
    assert ask(own, "get_table_ddl", table_name="s.one", tenant_type="ORACLE", **where)["ok"]
    assert source.asked[0] == ("t", "MYSQL", "SHOW CREATE TABLE `s`.`one`") and source.asked[1][2] == "SELECT dbms_metadata.get_ddl('TABLE', 'ONE', 'D') AS ddl FROM dual"
    for bad in ({"table_name": "x; drop table y", "tenant_type": "MYSQL"}, {"table_name": "x", "tenant_type": "OTHER"}):
        assert not ask(own, "get_table_ddl", **bad, **where)["ok"]
    assert len(source.asked) == 2


def test_definitions_fall_back_to_columns():
    """Where the package is closed the columns are asked for; a connection that fails is not asked twice."""
    asked = []

    def run(closed, error=RuntimeError):
        def one(statement):
            asked.append(statement)
            if any(c in statement for c in closed):
                raise error("ORA-00904: closed")
            return bounded.Result(["c"], [["x"]])

        return one

    assert dialects.table_ddl(run(["dbms_metadata"]), "ORACLE", "own", "other.t1").rows == [["x"]]
    assert asked[1] == "SELECT column_name, data_type, data_length, data_precision, data_scale, nullable FROM all_tab_columns WHERE owner = 'OWN' AND table_name = 'T1' ORDER BY column_id"
    with pytest.raises(errors.SqlError, match="neither"):
        dialects.table_ddl(run(["dbms_metadata", "all_tab"]), "ORACLE", "own", "t1")
    asked.clear()
    for kind, error in (("ORACLE", errors.SourceError), ("ORACLE", errors.SqlError), ("MYSQL", RuntimeError)):
        with pytest.raises((errors.SourceError, errors.SqlError)):
            dialects.table_ddl(run(["t1", "T1"], error), kind, "own", "t1")
    assert len(asked) == 3


def test_the_pointer_moves_in_one_step(spark, tmp_path):
    from tidewell.operators.pointer import Pointer

    p = Pointer(spark, str(tmp_path / "x"))
    assert p.read() is None
    p.move("v1")
    (tmp_path / "x" / "CURRENT.next").write_text("half")  # what a crash may leave
    assert p.read() == "v1"
    p.move("v2")
    assert p.read() == "v2" and not (tmp_path / "x" / "CURRENT.next").exists()
