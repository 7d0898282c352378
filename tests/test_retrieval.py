"""Routes, fusion, adjustment, re-ranking, evaluation."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import evaluation as E
from tidewell.operators import filters
from tidewell.operators import rerank as X
from tidewell.operators import retrieval as R

ROUTE = "query_id bigint, pk bigint, score double, rank bigint"


def route(spark, *pks):
    return spark.createDataFrame([(0, p, 1.0 / (i + 1), i + 1) for i, p in enumerate(pks)], ROUTE)


def test_fusion(spark):
    out = R.fused([("sparse", 1.0, route(spark, 1, 2, 3)), ("dense", 1.0, route(spark, 3, 4))]).orderBy("fused_rank").collect()
    assert [(r.pk, r.source) for r in out] == [(3, "dense+sparse"), (1, "sparse"), (2, "sparse"), (4, "dense")]
    assert out[0].score == round(1 / 63 + 1 / 61, 6) and (out[0].sparse_rank, out[0].dense_rank) == (3, 1)
    off = R.fused([("sparse", 1.0, route(spark, 1)), ("dense", 0.0, route(spark, 2))]).collect()
    assert [r.pk for r in off] == [1]


def test_overlap(spark):
    cols = [F.lit(x) for x in ("lock wait", "lock deadlock", "wait section", "body")]
    score = lambda *t: round(spark.range(1).select(R.overlap(F.array(*[F.lit(x) for x in t]), *cols).alias("x")).first().x * 21, 6)
    assert [score("lock"), score("deadlock"), score("wait"), score("body"), score("lock", "body"), score("none")] == [10, 6, 14, 1, 11, 0]


def test_adjustment(spark):
    rows = [(0, 1, 10.0, "t", "k", "a > b", "b", "doc", ""), (0, 2, 8.0, "t", "k", "a > 相关文档", "b", "doc", "4.2"), (0, 3, 9.0, "t", "k", "a", "b", "nav", ""), (0, 4, 0.0, "t", "k", "a", "b", "doc", "4.2")]
    hits = spark.createDataFrame(rows, "query_id bigint, pk bigint, score double, title string, keywords string, section string, body string, kind string, version string")
    order = lambda **k: [r.pk for r in R.adjusted(hits, **k).orderBy("rank").collect()]
    assert order() == [1, 2, 4, 3] and order(version="4") == [1, 2, 4, 3] and order(include_index=True) == [1, 3, 2, 4]
    one = R.adjusted(hits.where("pk = 1")).first()
    assert (one.base, one.rank) == (0.0, 1)


def test_cap(spark):
    hits = spark.createDataFrame([(0, i, "p" if i < 4 else f"q{i}", i) for i in range(8)], "query_id bigint, pk bigint, path string, fused_rank bigint")
    assert [r.pk for r in R.capped(hits).orderBy("position").collect()] == [0, 1, 4, 5, 6]
    assert R.capped(hits, limit=99).count() == 6


def test_expansion(spark):
    q = lambda s: spark.range(1).select(R.expanded(F.lit(s)).alias("x")).first().x
    assert q("nothing") == "nothing" and q("查 死锁") == "查 死锁 deadlock 锁等待" and q("备份 和 恢复") == "备份 和 恢复 backup 备份恢复 restore" and q("索引 INDEX") == "索引 INDEX 局部索引 全局索引"


def test_dense_skips_missing_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0])], "pk bigint, vector array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, vector array<float>")
    assert [(r.pk, r.score) for r in R.dense_route(v, q).orderBy("rank").collect()] == [(1, 1.0), (4, 0.707107)]


def fused_rows(spark, n):
    return spark.createDataFrame([(0, "alpha beta", i, i, "t", "s", f"alpha {i}" if i % 2 else f"alpha beta {i}") for i in range(1, n + 1)], "query_id bigint, query string, pk bigint, fused_rank bigint, title string, section string, body string")


def test_rerank(spark):
    order = lambda scorer, **k: [r.pk for r in X.apply(fused_rows(spark, 6), scorer, **k).orderBy("position").collect()]
    assert order(X.term_share) == [2, 4, 6, 1, 3, 5] and order(X.term_share, top_n=3) == [2, 1, 3, 4, 5, 6]
    assert order(lambda q, p: [(2, 1.0), (2, 5.0), (99, 9.0), (-1, 3.0)]) == [3, 1, 2, 4, 5, 6]

    def broken(q, p):
        raise OSError("down")

    rows = X.apply(fused_rows(spark, 3), broken).orderBy("position").collect()
    assert [r.pk for r in rows] == [1, 2, 3] and all(r.degraded and r.rerank_rank is None for r in rows)
    assert X.guarded("auto", "hybrid") == ("off", "retriever_hybrid") and X.guarded("api", "hybrid") == ("api", "") and X.guarded("auto", "sparse") == ("auto", "")
    assert X.mode("", "api") == "api"
    with pytest.raises(ValueError):
        X.mode("other")


def test_filters(spark):
    df = spark.createDataFrame([(1, 5.0, "doc", "MySQL", "4.1.2"), (2, None, "nav", "", ""), (3, 9.0, "doc", "Oracle", "3.2")], "id bigint, t double, kind string, mode string, version string")
    ids = lambda c: [r.id for r in df.where(c).collect()]
    assert ids(filters.comparison(df, "@t > 4 and @t <= 5")) == [1] and ids(filters.comparison(df, "@nothing > 1")) == [] and ids(filters.comparison(df, " ")) == [1, 2, 3]
    s = lambda *a: ids(filters.scalar(F.col("kind"), F.col("mode"), F.col("version"), *a))
    assert s() == [1, 3] and s("", "", True) == [1, 2, 3] and s("MySQL", "", True) == [1, 2] and s("", "4.1", True) == [1, 2] and s("", "4_1") == []
    with pytest.raises(ValueError):
        filters.comparison(df, "@t == 4")


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, ["a/x"], "t", False), (2, ["none", "b.md"], "t", False), (3, ["z"], "", False), (4, ["x"], "u", True)], "case_id bigint, expect array<string>, tag string, include_index boolean")
    results = spark.createDataFrame([(1, 1, "d/a/x.md", "sparse"), (2, 1, "d/index.md", "dense"), (2, 2, "d/b.md", "sparse"), (4, 1, "x/README.md", "sparse")], "case_id bigint, rank bigint, path string, source string")
    hits = E.first_hits(results, cases)
    assert {r.case_id: (r.hit_rank, r.nav_top1) for r in hits.collect()} == {1: (1, False), 2: (2, True), 3: (None, False), 4: (1, False)}
    m = E.metrics(hits, k=1, deep=5).first()
    assert (m.cases, m.hit_at_1, m.hit_at_k, m.hit_at_deep, m.mrr) == (4, 0.5, 0.5, 0.75, 0.625)
    assert {r.tag: r.cases for r in E.metrics(hits, by="tag").collect()} == {"t": 2, "u": 1}
    times = spark.createDataFrame([(float(x),) for x in range(1, 12)], "ms double")
    lat = E.latency(times).first()
    assert (lat.mean, lat.p50, lat.p95) == (6.0, 6.0, 11.0) and {r.q: r.value for r in E.percentiles(times, "ms").collect()} == {0.5: 6.0, 0.95: 11.0}
    paths = spark.createDataFrame([("d/a/x.md",), ("d/b.md",)], "path string")
    assert sorted((r.case_id, r.expect) for r in E.expired(cases, paths).collect()) == [(2, "none"), (3, "z")]
    good = {"hit_at_k": 0.8, "mrr": 0.7, "hit_at_1": 0.6}
    assert E.verdict(good, E.Gates()) == (0, []) and E.verdict(good, E.Gates(min_mrr=0.9))[0] == 2 and E.verdict(good, E.Gates(), nav_top1=1)[0] == 2 and E.verdict(good, E.Gates(), broken_cases=1)[0] == 3
    assert E.needs_vectors("hybrid") and not E.needs_vectors("sparse") and "hit_at_k: 0.8" in E.render(good)
    assert spark.range(1).select(E.source_label(F.array(F.lit("b"), F.lit("a"))).alias("x")).first().x == "a+b" and T.passage is not None


def test_stored_postings(spark, tmp_path, monkeypatch):
    from tidewell.operators import postings

    chunks = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 12))) for i in range(60)] + [(99, None), (98, "")], "pk bigint, text string")
    queries = spark.createDataFrame([(1, "w1 w2 W3"), (2, "none"), (3, "w5 w5")], "query_id bigint, query string")
    postings.build(chunks, str(tmp_path / "p"), buckets=4)
    want = sorted(R.sparse_route(chunks, queries).collect())
    found = postings.search(spark, str(tmp_path / "p"), queries)
    assert want and sorted(found.collect()) == want
    plan = postings.Stored(spark, str(tmp_path / "p")).scores(spark.createDataFrame([(1, "w1")], "query_id bigint, query string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1][:60]
    assert "EqualTo(term,w1)" in plan or "In(term" in plan
    monkeypatch.setattr(postings, "PUSHED", 1)
    assert sorted(postings.search(spark, str(tmp_path / "p"), queries).collect()) == want


@pytest.mark.parametrize("kept", [False, True])
def test_many_terms_meet_chunks_where_they_are_counted(spark, monkeypatch, kept):
    """The lists are those of the full sum, equal texts and empty ones among the chunks; a task gives on only what can be in them."""
    rows = [(k, " ".join(f"w{(k * j) % (7 + j)}" for j in range(1 + k % 23)) if k % 10 else "w1 w2 w2") for k in range(600)] + [(600, ""), (601, None)]
    chunks = spark.createDataFrame(rows, "pk bigint, text string").coalesce(2)
    queries = spark.createDataFrame([(str(q), " ".join(f"w{(q * j) % 31}" for j in range(9)) + " nowhere") for q in range(40)] + [("none", ""), ("null", None)], "query_id string, query string")
    may = F.col("pk") % 3 != 1 if kept else None
    want = sorted(R.ranked(R.sparse_scores(chunks, queries, kept=may), 4).collect())
    monkeypatch.setattr(R, "SPELT", 0)
    seen, best = [], R._best
    monkeypatch.setattr(R, "_best", lambda *a: (seen.append(best(*a)), seen[-1])[1])
    assert sorted(R.sparse_route(chunks, queries, 4, kept=may).collect()) == want
    assert seen[0].count() <= 2 * 40 * 4
    monkeypatch.setattr("tidewell.operators.best.CELLS", 50)
    assert sorted(R.sparse_route(chunks, queries, 4, kept=may).collect()) == want


@pytest.mark.parametrize("bound", ["QUERY_TERMS", "WANTED"])
def test_large_query_sets_meet_chunks_in_blocks(spark, monkeypatch, bound):
    """No pair of a query and a chunk is shuffled for a query set of any size, few as its distinct terms may be: the lists are those of the full sum, and a task holds a block's hits alone."""
    chunks = spark.createDataFrame([(k, " ".join(f"w{(k * j) % (7 + j)}" for j in range(1 + k % 23))) for k in range(300)], "pk bigint, text string").coalesce(2)
    queries = spark.createDataFrame([(str(q), " ".join(f"w{(q * j) % 31}" for j in range(9))) for q in range(40)] + [("none", "")], "query_id string, query string")
    want = sorted(R.ranked(R.sparse_scores(chunks, queries), 4).collect())
    monkeypatch.setattr(R, bound, 100)
    monkeypatch.setattr(R, "sparse_scores", lambda *a: pytest.fail("all pairs are shuffled"))
    asked, best = [], R._best
    monkeypatch.setattr(R, "_best", lambda rows, questions, *a: (asked.append(questions), best(rows, questions, *a))[1])
    assert sorted(R.sparse_route(chunks, queries, 4).collect()) == want
    assert len(asked) > 2 and sum(len(q.ids) for q in asked) == 40 and all(len(q.ids) * 4 <= 100 for q in asked)


def test_fused_first_searches_expanded_questions(spark, sf):
    """Both routes are searched and fused: a chunk that only other words find is found, and the query names both routes."""
    from tidewell.catalogue.inputs import QUERIES

    chunks = spark.createDataFrame([(1, "motion"), (2, "tion tion"), (3, "x")], "pk bigint, text string")
    asked = spark.createDataFrame([(0, "tion")], "query_id bigint, query string")
    assert {r.pk for r in R.sparse_route(chunks, asked).collect()} == {2}
    assert {r.pk for r in R.sparse_route(chunks, asked, expand={"tion": ["ACTION", "motion"]}).collect()} == {1, 2}
    assert {r.source for r in QUERIES["fused_first"](spark, sf).collect()} & {"expanded", "expanded+sparse"}
