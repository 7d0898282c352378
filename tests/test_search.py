"""The whole search, its ledger, stores, SQL functions and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell import sqlfunctions
from tidewell.__main__ import main
from tidewell.catalogue.plans import BEFORE
from tidewell.operators import chunks, rerank, search, stores
from tidewell.sources.remote import hashed_vectors

TEXTS = {
    "lock.md": "---\ntitle: Lock waits\nkeywords: lock\n---\n## Cause\nA lock waits for another session.\n## Cure\nEnd the session that holds the lock.\n## 相关文档\nlock lock lock", "backup.md": "## Full\nTake a backup every night.\n## Restore\nRestore from the last backup.",
    "index.md": "# All about lock and backup lock lock", "mode.md": "## Use\nOnly in MySQL 模式: show the lock view.", "v/new.md": "## New in V4.2.1\nThe lock view is new.",
}


@pytest.fixture(scope="module")
def index(spark):
    rows = chunks.payloads(spark.createDataFrame(sorted(TEXTS.items()), "path string, text string"))
    return rows.join(hashed_vectors(16)(rows.where("kind = 'doc'")), "pk", "left").cache()


def embed(q):
    return hashed_vectors(16)(q.selectExpr("query_id as pk", "query as canonical")).withColumnRenamed("pk", "query_id")


def paths(out):
    return [r.path for r in out.orderBy("position").collect()]


def test_routes_and_ledger(spark, index):
    out, ledger = search.ask(index, "lock session", spark)
    assert ledger.ok and ledger.retriever == "sparse" and paths(out)[0] == "lock.md" and "index.md" not in paths(out)
    top = out.orderBy("position").first()
    assert top.source == "sparse" and top.dense_rank is None and "lock" in top.snippet.lower() and out.where("section = '相关文档'").count() == 0 or paths(out).count("lock.md") <= 2
    out, ledger = search.ask(index, "lock session", spark, retriever="hybrid", embed_query=embed, scorer=rerank.term_share)
    assert ledger.ok and ledger.rerank_skipped == "retriever_hybrid" and {r.source for r in out.collect()} & {"dense+sparse"}
    out, ledger = search.ask(index, "lock session", spark, retriever="hybrid")
    assert ledger.degraded == "dense_unavailable" and {r.source for r in out.collect()} == {"sparse"}
    assert search.ask(index, "lock", spark, retriever="dense", meta={}, embed_query=embed)[1].degraded == "dense_unavailable"
    assert search.ask(None, "lock", spark) [1].degraded == "index_missing"
    out, _ = search.ask(index, "the lock view", spark, scorer=rerank.term_share)
    assert out.where("rerank_rank = 1").count() == 1
    for bad in ({"retriever": "x"}, {"rerank_mode": "x"}):
        with pytest.raises(ValueError):
            search.ask(index, "lock", spark, **bad)


def test_failures_degrade(spark, index):
    """What fails while embedding or reading leaves the route out, and is told."""
    def broken(q):
        raise RuntimeError("service down")

    late = lambda q: q.select("query_id", F.raise_error(F.lit("down")).cast("array<float>").alias("vector"))
    for f in (broken, late):
        out, ledger = search.ask(index, "lock session", spark, retriever="hybrid", embed_query=f)
        assert ledger.degraded == "dense_unavailable" and {r.source for r in out.collect()} == {"sparse"}
    gone = index.withColumn("text", F.raise_error(F.lit("gone")))
    out, ledger = search.ask(gone, "lock session", spark)
    assert out is None and ledger.degraded == "index_unavailable" and not ledger.ok


@pytest.mark.parametrize("options", [{}, {"mode": "MySQL"}, {"include_index": True}, {"version": "4.2"}])
def test_a_stored_index_gives_the_same_entries(spark, index, tmp_path, options):
    """Counts are those of the whole index with either; filters only tell which rows may be hits."""
    from tidewell.operators import postings

    postings.build(index, str(tmp_path / "p"), buckets=4)
    stored = postings.Stored(spark, str(tmp_path / "p"))
    for question in ("backup", "the lock view"):
        q = spark.createDataFrame([(0, question)], "query_id bigint, query string")
        want, got = (search.search(index, q, postings=p, **options)[0].orderBy("position").collect() for p in (None, stored))
        assert got == want


def test_questions_without_spaces(spark, tmp_path):
    """Chinese questions find pages by pairs of characters, not by whole clauses."""
    from tidewell.functions import text as T
    from tidewell.operators import postings

    terms = lambda s: spark.range(1).select(T.tokens(F.lit(s)).alias("t")).first().t
    assert terms("执行计划，索引x2") == ["执行", "行计", "计划", "索引", "x2"] and terms("锁 Lock") == ["锁", "lock"] and terms("") == [] and terms("plain 4.2") == ["plain", "4", "2"]
    rows = chunks.payloads(spark.createDataFrame([("a.md", "## 说明\n数据库的执行计划缓存可以被清除。"), ("b.md", "## 说明\n备份与恢复需要足够的磁盘空间。"), ("c.md", "## 说明\n租户资源隔离。")], "path string, text string"))
    postings.build(rows, str(tmp_path / "p"), buckets=2)
    for p in (None, postings.Stored(spark, str(tmp_path / "p"))):
        for question, path in (("如何查看执行计划？", "a.md"), ("磁盘空间不足时怎样备份", "b.md")):
            out, _ = search.ask(rows, question, spark, postings=p)
            assert paths(out)[0] == path


def test_filters_of_a_question(spark, index):
    out, ledger = search.ask(index, "mysql 模式 lock", spark)
    assert "mode.md" in paths(out) and not ledger.relaxed
    out, ledger = search.ask(index, "V9.9 Oracle 模式 restore backup", spark)
    assert paths(out)[0] == "backup.md"
    out, _ = search.ask(index, "lock", spark, include_index=True)
    assert "index.md" in paths(out)
    assert search.detected("系统租户 V4.2.1", spark) == ("sys", "4.2.1")


def test_evaluate(spark, index):
    cases = spark.createDataFrame([("a", "lock session", ["lock.md"], "x", False), ("b", "restore backup", ["backup.md"], "y", False), ("c", "nothing here", ["none"], "", False)], "case_id string, query string, expect array<string>, tag string, include_index boolean")
    hits, whole, by_tag, by_source, _ = search.evaluate(index, cases)
    assert whole.first().hit_at_1 == 0.6667 and {r.tag: r.hit_at_1 for r in by_tag.collect()} == {"x": 1.0, "y": 1.0} and by_source.count() == 1 and hits.count() == 3


def test_logs(spark, tmp_path):
    log = stores.messages(spark, str(tmp_path / "m"))
    assert log.read().count() == 0
    at = F.lit("2024-01-01").cast("timestamp")
    rows = spark.createDataFrame([(1, "t1", "user", "a"), (2, "t1", "assistant", "b"), (3, "t2", "user", None), (4, "bad id!", "user", "x"), (5, "t2", "system", "x")], "id bigint, thread_id string, role string, content string").withColumn("created_at", at)
    stores.append_messages(log, rows)
    stores.append_messages(log, rows.where("id = 1").withColumn("id", F.lit(9).cast("bigint")))
    assert sorted(r.id for r in log.read().collect()) == [1, 2, 3, 9]
    assert stores.delete_thread(log, "t1") == 3 and [r.content for r in log.read().collect()] == [""] and stores.delete_thread(log, "none") == 0
    trail = stores.audit(spark, str(tmp_path / "a"))
    events = spark.range(4).select(F.col("id"), F.lit("t").alias("thread_id"), F.when(F.col("id") == 0, "search_docs").otherwise("other").alias("tool"), F.lit("{}").alias("args"), F.lit(True).alias("ok"), F.lit("").alias("error"), F.col("id").alias("rows"), F.lit(False).alias("truncated"), F.lit(True).alias("approved"), F.col("id").alias("duration_ms"), F.timestamp_add("DAY", F.col("id").cast("int"), at).alias("created_at"))
    trail.append(events)
    assert stores.prune(trail, 0) == 0 and stores.prune(trail, 1, F.lit("2024-01-03").cast("timestamp")) == 1
    assert {r.tool: r.label for r in stores.audit_view(trail.read(), {"search_docs": "s"}).collect()} == {"other": "other"}


def test_sql_functions(spark):
    sqlfunctions.register(spark)
    spark.createDataFrame([(json.dumps(BEFORE),)], "p string").createOrReplaceTempView("plans1")
    assert [r.operator for r in spark.sql("select n.* from plans1, lateral plan_nodes(p) n order by id").collect()] == ["HASH JOIN", "TABLE GET", "TABLE SCAN"]
    assert spark.sql("select * from doc_sections('## A\\nx')").collect()[0].section == "A"
    assert json.loads(spark.sql("select plan_diff(p, p) d from plans1").first().d)["verdict"] == "unchanged" and spark.sql("select read_only_refusal('drop table t') r").first().r


def test_command_line(spark, tmp_path, capsys):
    docs = tmp_path / "docs"
    for name, text in TEXTS.items():
        (docs / name).parent.mkdir(parents=True, exist_ok=True)
        (docs / name).write_text(text)
    at = str(tmp_path / "index")
    last = lambda: json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert main(["index", at, "--corpus", str(docs), "--vectors", "8"]) == 0 and last()["chunks"] == 8
    assert main(["index", at, "--corpus", str(docs), "--vectors", "8"]) == 0 and last() == {"skipped_all": True}
    assert main(["stats", at]) == 0 and last()["nav_rows"] == 1
    (tmp_path / "c.jsonl").write_text('{"id": "a", "query": "lock session", "expect": "lock.md", "tag": "t"}')
    assert main(["eval", at, str(tmp_path / "c.jsonl"), "--retriever", "hybrid", "--json", str(tmp_path / "r.json")]) == 0 and json.load(open(tmp_path / "r.json"))["hit_at_k"] == 1.0
    (tmp_path / "d.jsonl").write_text('{"id": "a", "query": "lock session", "expect": "gone.md"}')
    assert main(["eval", at, str(tmp_path / "d.jsonl")]) == 3 and main(["eval", str(tmp_path / "no"), str(tmp_path / "c.jsonl")]) == 3
    (tmp_path / "e.jsonl").write_text('{"id": "a", "query": "restore", "expect": "lock.md"}')
    assert main(["eval", at, str(tmp_path / "e.jsonl")]) == 2


def test_a_failure_is_no_result(spark, sf, index, monkeypatch):
    """What failed is told; a query that needs every route fails with it and does not return the hits of one."""
    from tidewell.catalogue.retrieval import QUERIES
    from tidewell.operators.errors import SearchDegraded

    def broken(q):
        raise RuntimeError("service down")

    out, ledger = search.ask(index, "lock session", spark, retriever="hybrid", embed_query=broken)
    assert ledger.degraded == "dense_unavailable" and ledger.failure == "RuntimeError: service down"
    with pytest.raises(SearchDegraded, match="service down"):
        ledger.whole()
    search.ask(index, "lock session", spark, retriever="hybrid", embed_query=embed)[1].whole()

    def full(df, name, f=search.written):
        if name == "query-vectors":
            raise OSError("no space left")
        return f(df, name)

    monkeypatch.setattr(search, "written", full)
    with pytest.raises(SearchDegraded, match="no space left"):
        QUERIES["hybrid_search"](spark, sf)
