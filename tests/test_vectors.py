"""The vector cache and its counters against a stub service; the dense index against the exact route."""

import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import numbers as N
from tidewell.operators import index as I
from tidewell.operators import retrieval as R
from tidewell.operators import vectors as V
from tidewell.sources import remote


@pytest.fixture()
def service():
    """Vectors from the texts' digests; every third request is refused once."""
    seen = {"requests": 0, "refused": 0, "texts": []}
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            with lock:
                refuse = (seen["requests"] + seen["refused"]) % 3 == 2 and seen.get("last") != asked
                seen["last"] = asked
                seen["refused" if refuse else "requests"] += 1
                if not refuse:
                    seen["texts"] += asked
            self.send_response(429 if refuse else 200)
            self.end_headers()
            if not refuse:
                self.wfile.write(json.dumps({"data": [{"index": i, "embedding": [b / 255 for b in hashlib.md5(t.encode()).digest()[:4]]} for i, t in enumerate(asked)]}).encode())

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/vec", seen
    s.shutdown()


def test_texts_are_sent_once(spark, service, tmp_path):
    url, seen = service
    embed = V.Cached(spark, str(tmp_path / "c"), "m", remote.embedder(url, "m", 4, batch=5, waits=(0, 0)))
    make = lambda n: spark.createDataFrame([(i, f"text {i % 17}") for i in range(n)], "pk bigint, canonical string").repartition(2)
    first = {r.pk: r.vector for r in embed(make(40)).collect()}
    assert len(first) == 40 and first[1] == first[18] and sorted(seen["texts"]) == sorted(f"text {i}" for i in range(17))
    assert embed.served == V.Served(40, 0, 17, seen["requests"], seen["refused"]) and seen["refused"] > 0
    # again, with one text more, and as a question
    before = seen["requests"]
    more = make(40).union(spark.createDataFrame([(99, "new")], "pk bigint, canonical string"))
    again = {r.pk: r.vector for r in embed(more).collect()}
    assert {k: v for k, v in again.items() if k != 99} == first and seen["requests"] == before + 1
    assert embed.served.hits == 40 and embed.served.sent == 18 and embed.report["vector_texts"] == 81
    q = embed.queries(spark.createDataFrame([(5, "text 3"), (6, "new")], "query_id bigint, query string")).collect()
    assert {r.query_id: r.vector for r in q} == {5: first[3], 6: again[99]} and seen["requests"] == before + 1
    # another session finds what was kept; another model does not
    assert V.Cached(spark, str(tmp_path / "c"), "m", None)(make(9)).count() == 9
    assert V.Cached(spark, str(tmp_path / "c"), "other", remote.hashed_vectors(4))(make(3)).count() == 3


def test_a_second_build_asks_for_nothing(spark, service, tmp_path):
    from tidewell.operators import chunks as C

    url, seen = service
    embed = V.Cached(spark, str(tmp_path / "c"), "m", remote.embedder(url, "m", 4, waits=(0, 0)))
    files = spark.createDataFrame([(f"{k}.md", f"## S\nbody {k}") for k in range(5)], "path string, text string")
    one = I.build(I.Store(spark, str(tmp_path / "a")), files, C.payloads(files), embed, model="m")
    assert one.counts["vector_sent"] == 5 and one.counts["vector_requests"] == seen["requests"] and one.counts["vector_retries"] == seen["refused"]
    n = seen["requests"]
    two = I.build(I.Store(spark, str(tmp_path / "b")), files, C.payloads(files), embed, model="m")
    assert seen["requests"] == n and two.counts["vector_hits"] == 5 and json.loads(I.Store(spark, str(tmp_path / "b")).meta()["counts"])["vector_hits"] == 5


def test_a_dense_index_finds_what_is_near(spark, tmp_path):
    r = np.random.default_rng(1)
    hearts = r.normal(size=(30, 16))
    rows = [(i, (hearts[i % 30] + 0.4 * r.normal(size=16)).tolist()) for i in range(3000)] + [(3000, None), (3001, [0.0] * 16)]
    vectors = spark.createDataFrame(rows, "pk bigint, vector array<float>").repartition(4).cache()
    queries = vectors.where("pk % 50 = 0 and pk < 3000").selectExpr("pk as query_id", "vector")
    exact = R.dense_route(vectors, queries).cache()
    assert V.build(vectors, str(tmp_path / "d")) == 54
    index = V.Dense(spark, str(tmp_path / "d"))
    found = index.search(queries).cache()
    row = V.recall(found, exact).first()
    assert row.queries == 60 and row.recall >= 0.9 and index.take < 27
    # a hit has its exact score; with all cells the lists are exact; every row is in one cell
    assert found.join(exact, ["query_id", "pk", "score"]).count() == round(row.recall * 3000)
    assert sorted(index.search(queries, probed=1.0).collect()) == sorted(exact.collect())
    assert spark.read.parquet(str(tmp_path / "d/vectors")).count() == 3000
    plan = spark.read.parquet(str(tmp_path / "d/vectors")).where("cell in (1, 2)")._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan


def test_vectors_without_clusters_read_more_cells(spark, tmp_path):
    """The index tells by itself how many cells nine of ten hits need."""
    r = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, r.normal(size=12).tolist()) for i in range(2000)], "pk bigint, vector array<float>").cache()
    queries = vectors.where("pk % 50 = 0").selectExpr("pk as query_id", "vector")
    V.build(vectors, str(tmp_path / "d"))
    index = V.Dense(spark, str(tmp_path / "d"))
    assert index.take > 11 and V.recall(index.search(queries), R.dense_route(vectors, queries)).first().recall >= 0.9


def test_large_query_sets_are_asked_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "pk bigint, vector array<float>")
    q = vectors.selectExpr("pk as query_id", "vector")
    want = sorted(R.dense_route(vectors, q, 4).collect())
    monkeypatch.setattr(R, "QUERY_FLOATS", 400)
    assert sorted(R.dense_route(vectors, q, 4).collect()) == want and len(want) == 240


def test_few_rows_are_one_cell(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "pk bigint, vector array<float>")
    assert V.build(vectors, str(tmp_path / "d")) == 1
    q = vectors.limit(3).selectExpr("pk as query_id", "vector")
    assert sorted(V.Dense(spark, str(tmp_path / "d")).search(q, 5).collect()) == sorted(R.dense_route(vectors, q, 5).collect())
    assert V.build(vectors.where("false"), str(tmp_path / "e")) == 1 and V.Dense(spark, str(tmp_path / "e")).search(q, 5).count() == 0


def test_a_task_gives_on_the_best_alone(spark):
    """However many vectors a task reads, and of however many equal ones, it gives on as many rows as are wanted of each query."""
    rng = np.random.default_rng(3)
    some = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(k, [float(x) for x in some[0 if k % 3 == 0 else k % 300]]) for k in range(3000)] + [(9000, None), (9001, [0.0] * 8), (9002, [1.0] * 7)]
    vectors = spark.createDataFrame(rows, "pk bigint, vector array<float>").coalesce(1)
    asked = vectors.where("pk < 40 or pk > 8999").selectExpr("pk as query_id", "vector")
    given = R._cosines(vectors, asked, 5)
    assert given.count() == 40 * 5 + 1
    cosine = F.round(N.cosine(F.col("vector"), F.col("_q")), 6)
    pairs = vectors.where("vector is not null").crossJoin(asked.where("vector is not null").withColumnRenamed("vector", "_q"))
    every = R.ranked(pairs.select("query_id", "pk", cosine.alias("score")).where("score is not null"), 5)
    assert sorted(R.dense_route(vectors, asked, 5).collect()) == sorted(every.collect())
