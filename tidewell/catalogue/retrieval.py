"""Hybrid retrieval, re-ranking and evaluation: documents are chunks (path: source and id), benchmark items are questions, embeddings are vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import filters
from ..operators import rerank as X
from ..operators import retrieval as R
from ..operators.search import with_fields
from ..sources.tables import table

QUESTION = "the thing and that eronha inwhly of"


def chunks(spark, d):
    docs = table(spark, d, "documents")
    nav = F.col("doc_id") % 50 == 0
    return docs.select(
        F.col("doc_id").alias("pk"), "text", F.col("text").alias("body"), F.col("lang").alias("title"), F.col("source").alias("keywords"), F.when(nav, "guide > 相关文档").otherwise("guide > text").alias("section"),
        F.when(F.col("doc_id") % 40 == 1, "nav").otherwise("doc").alias("kind"), F.col("source").alias("path"), F.when(F.col("lang") == "en", "MySQL").when(F.col("lang") == "de", "Oracle").otherwise("").alias("mode"),
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("4."), (F.col("doc_id") % 4).cast("string"))).alias("version"),
    )


def question(spark):
    return spark.createDataFrame([(0, QUESTION)], "query_id bigint, query string")


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("pk"), F.col("embedding").alias("vector"))


def asked_vector(spark, d):
    return vectors(spark, d).where("pk = 7").select(F.lit(0).cast("bigint").alias("query_id"), "vector")


def bm25_stats(spark, d):
    s = R.bm25_stats(R.tokenise(chunks(spark, d)))
    return spark.createDataFrame([(s.n, round(s.mean_length, 6))], "n bigint, mean_length double")


def sparse_topk(spark, d):
    return R.sparse_route(chunks(spark, d), question(spark))


def sparse_topk_batch(spark, d):
    return R.sparse_route(chunks(spark, d), questions(spark, d), pool=5)


def dense_topk(spark, d):
    return R.dense_route(vectors(spark, d), asked_vector(spark, d))


def hybrid_rrf(spark, d):
    out = R.fused([("sparse", 1.0, R.sparse_route(chunks(spark, d), question(spark))), ("dense", 1.0, R.dense_route(vectors(spark, d), asked_vector(spark, d)))])
    return out.where("fused_rank <= 20").select("pk", "score", "source", "sparse_rank", "dense_rank", "fused_rank")


def _hits(spark, d, pool=50):
    return with_fields(R.sparse_route(chunks(spark, d), question(spark), pool).drop("rank"), chunks(spark, d), pool)


def route_rank_adjusted(spark, d):
    terms = T.query_terms(F.lit(QUESTION))
    return R.adjusted(_hits(spark, d), version="4", terms=terms).select("pk", "base", "final", "rank")


def scalar_filtered_search(spark, d):
    kept = filters.scalar(F.col("kind"), F.col("mode"), F.col("version"), mode="MySQL", version="4.1")
    return R.sparse_route(chunks(spark, d), question(spark), 20, kept=kept).select("pk", "score", "rank")


def filter_relaxation(spark, d):
    c = chunks(spark, d)
    none = c.where(filters.scalar(F.col("kind"), F.col("mode"), F.col("version"), version="9.9") & (F.col("version") != ""))
    return R.sparse_route(filters.relaxed(none, c, automatic=True), question(spark), 10).select("pk", "rank")


SYNONYMS = {"tion": ["ACTION", "motion"], "here": ["There", "where"], "the": ["THERE", "article"]}


def synonym_expansion(spark, d):
    return questions(spark, d).select("query_id", R.expanded(F.col("query"), SYNONYMS).alias("query"))


def per_document_cap(spark, d):
    hits = R.adjusted(_hits(spark, d)).withColumnRenamed("rank", "fused_rank")
    return R.capped(hits, limit=15).select("pk", "path", "position")


def _length_scorer(query, passages):
    return sorted(((i, float(len(p) % 97)) for i, p in enumerate(passages) if len(p) % 5), key=lambda x: (-x[1], x[0]))


def rerank_reorder(spark, d):
    hits = R.sparse_route(chunks(spark, d), question(spark), 40).withColumnRenamed("rank", "fused_rank")
    hits = with_fields(hits, chunks(spark, d), 40).withColumn("query", F.lit(QUESTION))
    return X.apply(hits, _length_scorer, top_n=30, passage_chars=500).select("pk", "fused_rank", "position", "rerank_rank", "degraded")


def cases(spark, d):
    """Every question expects the documents that hold its text; every seventh is asked of navigation pages too."""
    b, docs = table(spark, d, "benchmark"), table(spark, d, "documents").select("doc_id", "text")
    found = docs.join(F.broadcast(b.select("item_id", F.col("text").alias("q"))), F.contains(F.col("text"), F.col("q"))).groupBy("item_id").agg(F.collect_list(F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("expect"))
    expect = F.coalesce("expect", F.array(F.lit("/none.md")))
    return b.join(found, "item_id", "left").select(
        F.col("item_id").alias("case_id"), "text", expect.alias("expect"), F.when(F.col("item_id") % 3 == 0, "").when(F.col("item_id") % 3 == 1, "body").otherwise("hard").alias("tag"), (F.col("item_id") % 7 == 0).alias("include_index")
    )


def results(spark, d, pool=10):
    hits = R.sparse_route(chunks(spark, d), questions(spark, d), pool)
    return hits.select(F.col("query_id").alias("case_id"), "rank", F.concat(F.lit("d/"), F.col("pk").cast("string"), F.lit(".md")).alias("path"), F.lit("sparse").alias("source"))


def eval_hits(spark, d):
    return E.first_hits(results(spark, d), cases(spark, d))


def eval_hit_mrr(spark, d):
    return E.metrics(eval_hits(spark, d))


def eval_by_tag(spark, d):
    return E.metrics(eval_hits(spark, d), by="tag")


def latency_percentiles(spark, d):
    return E.latency(table(spark, d, "events"), "value")


def value_percentiles(spark, d):
    return E.percentiles(table(spark, d, "events"), "value", (0.1, 0.5, 0.95, 0.99))


def expired_cases(spark, d):
    paths = table(spark, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return E.expired(cases(spark, d), paths)


QUERIES = {
    f.__name__: f
    for f in (
        bm25_stats, sparse_topk, sparse_topk_batch, dense_topk, hybrid_rrf, route_rank_adjusted, scalar_filtered_search, filter_relaxation, synonym_expansion, per_document_cap, rerank_reorder,
        eval_hits, eval_hit_mrr, eval_by_tag, latency_percentiles, value_percentiles, expired_cases,
    )
}


def _bm25(name: str, docs: str, queries: str, kept: str = "true") -> str:
    """CTEs that end in ``name``: query_id, pk, score, rank; counts are over ``docs``, hits those whose pk is ``kept``."""
    n = name
    return rf"""{n}_t AS (SELECT pk, list_filter_(x) AS ts FROM (SELECT pk, regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+') AS x FROM {docs})),
{n}_s AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)::DOUBLE) AS m FROM {n}_t),
{n}_q AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_split_to_array(lower(query), '[^\p{{L}}\p{{N}}]+')) AS term FROM {queries}) WHERE term <> ''),
{n}_f AS (SELECT pk, len, term, count(*) AS tf FROM (SELECT pk, len(ts) AS len, unnest(ts) AS term FROM {n}_t) WHERE term IN (SELECT term FROM {n}_q) GROUP BY ALL),
{n}_d AS (SELECT term, count(*) AS df FROM {n}_f GROUP BY term),
{n}_r AS (SELECT query_id, pk, round(sum(ln(1.0::DOUBLE + (s.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / s.m))), 6) AS score
  FROM {n}_q JOIN {n}_d USING (term) JOIN {n}_f USING (term), {n}_s s WHERE {kept} GROUP BY query_id, pk),
{n} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) AS rank FROM {n}_r)""".replace("list_filter_(x)", "[y FOR y IN x IF y <> '']")


_C = """c AS (SELECT doc_id AS pk, text, text AS body, lang AS title, source AS keywords, CASE WHEN doc_id % 50 = 0 THEN 'guide > 相关文档' ELSE 'guide > text' END AS section, CASE WHEN doc_id % 40 = 1 THEN 'nav' ELSE 'doc' END AS kind,
  source AS path, CASE lang WHEN 'en' THEN 'MySQL' WHEN 'de' THEN 'Oracle' ELSE '' END AS mode, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '4.' || doc_id % 4 END AS version FROM documents)"""
_Q = f"q AS (SELECT 0::BIGINT AS query_id, '{QUESTION}' AS query)"
_B = "b AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_DENSE = """v AS (SELECT vec_id AS pk, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7) AS a FROM embeddings),
dense AS (SELECT 0::BIGINT AS query_id, pk, round(list_dot_product(e, a) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(a, a))), 6) AS score FROM v),
dr AS (SELECT *, row_number() OVER (ORDER BY score DESC, pk) AS rank FROM dense)"""
_TERMS = "['the', 'thing', 'and', 'that', 'eronha', 'inwhly', 'of']"
_ADJ = f"""h AS (SELECT r.pk, r.score, c.title, c.keywords, c.section, c.body, c.kind, c.version, c.path FROM r JOIN c USING (pk) WHERE r.rank <= 50),
n AS (SELECT *, (score - min(score) OVER ()) / CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0::DOUBLE ELSE max(score) OVER () - min(score) OVER () END AS x FROM h),
o AS (SELECT *, (SELECT sum(CASE WHEN contains(title, t) THEN 10.0::DOUBLE WHEN contains(keywords, t) THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(section, t) THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(body, t) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
  FROM (SELECT unnest({_TERMS}) AS t)) / 21.0::DOUBLE AS overlap FROM n)"""
_NAV = "- CASE WHEN section LIKE '%相关文档' THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN kind = 'nav' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END"
_CASES = """cs AS (SELECT item_id AS case_id, coalesce((SELECT list('/' || doc_id || '.md') FROM documents d WHERE contains(d.text, x.text)), ['/none.md']) AS expect,
  CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'body' ELSE 'hard' END AS tag, item_id % 7 = 0 AS include_index FROM benchmark x)"""
_EVAL = f"""{_C}, {_B}, {_bm25("r", "c", "b")}, {_CASES}, top AS (SELECT query_id AS case_id, rank, 'd/' || pk || '.md' AS path FROM r WHERE rank <= 10),
fh AS (SELECT cs.case_id, min(rank) FILTER (WHERE len([e FOR e IN expect IF contains(path, e)]) > 0) AS hit_rank, max(path) FILTER (WHERE rank = 1) AS top1_path,
  CASE WHEN count(path) > 0 THEN 'sparse' END AS top1_source, any_value(tag) AS tag, false AS nav_top1 FROM cs LEFT JOIN top USING (case_id) GROUP BY cs.case_id)"""
_METRICS = """count(*) AS cases, round(avg(CASE WHEN hit_rank = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS hit_at_1, round(avg(CASE WHEN hit_rank <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS hit_at_k,
round(avg(CASE WHEN hit_rank <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS hit_at_deep, round(avg(CASE WHEN hit_rank <= 10 THEN 1.0::DOUBLE / hit_rank ELSE 0.0::DOUBLE END), 4) AS mrr"""

SQL = {
    "bm25_stats": rf"""WITH {_C}, t AS (SELECT len([y FOR y IN regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+') IF y <> '']) AS n FROM c) SELECT count(*) AS n, round(avg(n::DOUBLE), 6) AS mean_length FROM t""",
    "sparse_topk": f"WITH {_C}, {_Q}, {_bm25('r', 'c', 'q')} SELECT query_id, pk, score, rank FROM r WHERE rank <= 50",
    "sparse_topk_batch": f"WITH {_C}, {_B}, {_bm25('r', 'c', 'b')} SELECT query_id, pk, score, rank FROM r WHERE rank <= 5",
    "dense_topk": f"WITH {_DENSE} SELECT query_id, pk, score, rank FROM dr WHERE rank <= 50",
    "hybrid_rrf": f"""WITH {_C}, {_Q}, {_bm25("r", "c", "q")}, {_DENSE},
        j AS (SELECT coalesce(a.pk, b.pk) AS pk, a.rank AS sparse_rank, b.rank AS dense_rank FROM (SELECT * FROM r WHERE rank <= 50) a FULL JOIN (SELECT * FROM dr WHERE rank <= 50) b ON a.pk = b.pk),
        s AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + sparse_rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0.0::DOUBLE), 6) AS score FROM j)
        SELECT pk, score, CASE WHEN sparse_rank IS NULL THEN 'dense' WHEN dense_rank IS NULL THEN 'sparse' ELSE 'dense+sparse' END AS source, sparse_rank, dense_rank, row_number() OVER (ORDER BY score DESC, pk) AS fused_rank
        FROM s QUALIFY fused_rank <= 20""",
    "route_rank_adjusted": f"""WITH {_C}, {_Q}, {_bm25("r", "c", "q")}, {_ADJ}, z AS (SELECT pk, round(x + CASE WHEN version <> '' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END {_NAV}, 6) AS base, overlap FROM o),
        y AS (SELECT pk, base, round(0.5::DOUBLE * base + 0.5::DOUBLE * overlap, 6) AS final FROM z) SELECT *, row_number() OVER (ORDER BY final DESC, base DESC, pk) AS rank FROM y""",
    "scalar_filtered_search": f"""WITH {_C}, {_Q}, f AS (SELECT * FROM c WHERE kind = 'doc' AND mode IN ('MySQL', '') AND (version = '' OR starts_with(version, '4.1'))), {_bm25("r", "c", "q", "pk IN (SELECT pk FROM f)")} SELECT pk, score, rank FROM r WHERE rank <= 20""",
    "filter_relaxation": f"WITH {_C}, {_Q}, {_bm25('r', 'c', 'q')} SELECT pk, rank FROM r WHERE rank <= 10",
    "synonym_expansion": """WITH a AS (SELECT item_id, text, list_concat(list_concat(CASE WHEN contains(text, 'tion') THEN ['ACTION', 'motion'] ELSE [] END, CASE WHEN contains(text, 'here') THEN ['There', 'where'] ELSE [] END),
          CASE WHEN contains(text, 'the') THEN ['THERE', 'article'] ELSE [] END) AS w FROM benchmark),
        n AS (SELECT item_id, text, [x FOR x IN w IF NOT contains(lower(text), lower(x))] AS w FROM a),
        o AS (SELECT item_id, text, [x FOR x IN w IF NOT (x = 'THERE' AND list_contains(w, 'There'))] AS w FROM n)
        SELECT item_id AS query_id, CASE WHEN len(w) > 0 THEN text || ' ' || array_to_string(w, ' ') ELSE text END AS query FROM o""",
    "per_document_cap": f"""WITH {_C}, {_Q}, {_bm25("r", "c", "q")}, {_ADJ}, z AS (SELECT pk, path, row_number() OVER (ORDER BY round(x {_NAV}, 6) DESC, pk) AS rk FROM o),
        k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rk) AS i FROM z QUALIFY i <= 2) SELECT pk, path, row_number() OVER (ORDER BY rk) AS position FROM k QUALIFY position <= 15""",
    "rerank_reorder": f"""WITH {_C}, {_Q}, {_bm25("r", "c", "q")}, h AS (SELECT r.pk, r.rank AS fr, length(left(title || ' > ' || section || chr(10) || trim(regexp_replace(body, '\\s+', ' ', 'g')), 500)) AS n FROM r JOIN c USING (pk) WHERE r.rank <= 40),
        s AS (SELECT pk, fr, CASE WHEN fr <= 30 AND n % 5 <> 0 THEN n % 97 END AS sc FROM h), p AS (SELECT *, row_number() OVER (ORDER BY sc IS NULL, sc DESC, fr) AS position FROM s)
        SELECT pk, fr AS fused_rank, position, CASE WHEN sc IS NOT NULL THEN position END AS rerank_rank, max(sc) OVER () IS NULL AS degraded FROM p""",
    "eval_hits": f"WITH {_EVAL} SELECT * FROM fh",
    "eval_hit_mrr": f"WITH {_EVAL} SELECT {_METRICS} FROM fh",
    "eval_by_tag": f"WITH {_EVAL} SELECT tag, {_METRICS} FROM fh WHERE tag <> '' GROUP BY tag",
    "latency_percentiles": """WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
        SELECT round(avg(value), 1) AS mean, max(value) FILTER (WHERE i = round_even((n - 1) * 0.5::DOUBLE, 0)) AS p50, max(value) FILTER (WHERE i = round_even((n - 1) * 0.95::DOUBLE, 0)) AS p95 FROM s""",
    "value_percentiles": """WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
        SELECT q, value FROM s, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) x(q) WHERE i = round_even((n - 1) * q, 0)""",
    "expired_cases": f"""WITH {_CASES}, e AS (SELECT DISTINCT case_id, unnest(expect) AS expect FROM cs) SELECT case_id, expect FROM e WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains('d/' || doc_id || '.md', expect))""",
}


def hybrid_search(spark, d):
    """The whole search for every question at once: documents are index rows with the vector of the same id, a question's vector is that of its id."""
    from ..operators.search import search
    from ..sources.scratch import written

    # texts meet their vectors once, not in every route
    index = written(chunks(spark, d).join(vectors(spark, d), "pk", "left").drop("body").withColumn("text", F.concat(F.lit("head | "), F.col("text"))), "index")
    asked = lambda q: q.select("query_id").join(vectors(spark, d), F.col("query_id") == F.col("pk")).select("query_id", "vector")
    out, ledger = search(index, questions(spark, d), retriever="hybrid", embed_query=asked)
    ledger.whole()  # hits of one route alone are no result of this query
    return out.select("query_id", "position", "pk", "source", "sparse_rank", "dense_rank")


QUERIES["hybrid_search"] = hybrid_search
_FULL = f"""{_C}, ck AS (SELECT pk, 'head | ' || text AS text, title, keywords, section, body, kind, path, version FROM c), k AS (SELECT * FROM ck WHERE kind = 'doc'), {_B}, {_bm25("r", "ck", "b", "pk IN (SELECT pk FROM k)")},
sh AS (SELECT r.query_id, r.score, k.* EXCLUDE (text) FROM r JOIN k USING (pk) WHERE r.rank <= 50),
sn AS (SELECT *, round((score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE max(score) OVER w - min(score) OVER w END - CASE WHEN section LIKE '%相关文档' THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END, 6) AS base FROM sh WINDOW w AS (PARTITION BY query_id)),
qt AS (SELECT DISTINCT query_id, term AS t FROM r_q WHERE NOT regexp_matches(term, '^[\\x00-\\x7F]$')),
ov AS (SELECT query_id, pk, base, coalesce((SELECT sum(CASE WHEN contains(title, t) THEN 10.0::DOUBLE WHEN contains(keywords, t) THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(section, t) THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN contains(body, t) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM qt WHERE qt.query_id = sn.query_id), 0.0::DOUBLE) / 21.0::DOUBLE AS ov FROM sn),
sr AS (SELECT query_id, pk, row_number() OVER (PARTITION BY query_id ORDER BY round(0.5::DOUBLE * base + 0.5::DOUBLE * ov, 6) DESC, base DESC, pk) AS rank FROM ov),
dv AS (SELECT b.query_id, k.pk, k.section, round(list_dot_product(e.embedding::DOUBLE[], a.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))), 6) AS score
  FROM k JOIN embeddings e ON e.vec_id = k.pk, b JOIN embeddings a ON a.vec_id = b.query_id),
dh AS (SELECT * FROM dv QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) <= 50),
dn AS (SELECT query_id, pk, round((score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE max(score) OVER w - min(score) OVER w END - CASE WHEN section LIKE '%相关文档' THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END, 6) AS base FROM dh WINDOW w AS (PARTITION BY query_id)),
dk AS (SELECT query_id, pk, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, pk) AS rank FROM dn),
fu AS (SELECT coalesce(sr.query_id, dk.query_id) AS query_id, coalesce(sr.pk, dk.pk) AS pk, sr.rank AS sparse_rank, dk.rank AS dense_rank FROM sr FULL JOIN dk ON sr.query_id = dk.query_id AND sr.pk = dk.pk),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(1.0::DOUBLE / (60 + sparse_rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0.0::DOUBLE), 6) DESC, pk) AS f FROM fu),
cp AS (SELECT fr.*, row_number() OVER (PARTITION BY query_id, path ORDER BY f) AS i FROM fr JOIN k USING (pk) QUALIFY i <= 2)"""
SQL["hybrid_search"] = f"""WITH {_FULL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY f) AS position, pk,
    CASE WHEN sparse_rank IS NULL THEN 'dense' WHEN dense_rank IS NULL THEN 'sparse' ELSE 'dense+sparse' END AS source, sparse_rank, dense_rank FROM cp QUALIFY position <= 5"""


def sparse_topk_stored(spark, d):
    """The same lists from a stored inverted index."""
    from ..operators import postings
    from ..sources.scratch import scratch

    path = scratch(spark, "postings")
    postings.build(chunks(spark, d), path, buckets=16)
    return postings.search(spark, path, questions(spark, d), 5)


QUERIES["sparse_topk_stored"] = sparse_topk_stored
SQL["sparse_topk_stored"] = SQL["sparse_topk_batch"]


# ---- stored postings and segments ----
def _stored(spark, d):
    from ..operators import postings
    from ..sources.scratch import scratch

    path = scratch(spark, "postings")
    postings.build(chunks(spark, d), path)
    return postings.Stored(spark, path)


def blockmax_topk(spark, d):
    """The best fifty of every question from blocks that can hold them."""
    return _stored(spark, d).search(questions(spark, d), 50)


def blockmax_reads(spark, d):
    """For the question and its best 1, 10 and 50: the postings of its terms, and whether no more are read than for more hits."""
    index, rows = _stored(spark, d), []
    for k in (50, 10, 1):
        found = index.search(question(spark), k).count()
        fewer = index.reads.read <= min([index.reads.postings, *[r[-1] for r in rows]])
        rows.append((k, found, index.reads.postings, fewer, index.reads.read))
    return spark.createDataFrame([r[:-1] for r in rows], "k int, hits int, postings bigint, fewer boolean").selectExpr("k", "cast(hits as bigint) as hits", "postings", "fewer")


def _edited(spark, d):
    """An index of documents and two later changes: some pages come late, some are edited, some go."""
    from ..operators.segments import NAMES, Store
    from ..sources.scratch import scratch

    rows = chunks(spark, d).withColumns({"content_hash": F.sha2("text", 256), "vector": F.lit(None).cast("array<float>")}).select(*NAMES)
    k = F.col("pk")
    store = Store(spark, scratch(spark, "segments"))
    store.publish(rows.where(k % 9 != 0), {})
    store.apply(rows.where(k % 9 == 0), rows.where(k % 13 == 5).select("pk"))
    store.apply(rows.where((k % 11 == 3) & (k % 13 != 5)).withColumn("text", F.concat(F.lit("edited "), "text")), rows.where((k % 9 == 0) & (k % 13 == 5)).select("pk"))
    return store


def segment_rows(spark, d):
    return _edited(spark, d).read().select("pk", F.md5("text").alias("digest"), "kind")


def segment_topk(spark, d):
    """Lists and counts over three segments, with what was replaced left out."""
    return _edited(spark, d).postings().search(questions(spark, d), 5)


_E = """e AS (SELECT doc_id AS pk, CASE WHEN doc_id % 11 = 3 THEN 'edited ' || text ELSE text END AS text, CASE WHEN doc_id % 40 = 1 THEN 'nav' ELSE 'doc' END AS kind FROM documents WHERE doc_id % 13 <> 5)"""
QUERIES |= {f.__name__: f for f in (blockmax_topk, blockmax_reads, segment_rows, segment_topk)}
SQL |= {
    "blockmax_topk": f"WITH {_C}, {_B}, {_bm25('r', 'c', 'b')} SELECT query_id, pk, score, rank FROM r WHERE rank <= 50",
    "blockmax_reads": f"WITH {_C}, {_Q}, {_bm25('r', 'c', 'q')} SELECT k::INT AS k, least(k, (SELECT count(*) FROM r)) AS hits, (SELECT sum(df) FROM r_d)::BIGINT AS postings, true AS fewer FROM (VALUES (1), (10), (50)) x(k)",
    "segment_rows": f"WITH {_E} SELECT pk, md5(text) AS digest, kind FROM e",
    "segment_topk": f"WITH {_E}, {_B}, {_bm25('r', 'e', 'b')} SELECT query_id, pk, score, rank FROM r WHERE rank <= 5",
}


# ---- vectors by content ----
def dense_index_recall(spark, d):
    """Every fiftieth vector asked of a dense index of all of them: how many were asked, how many lie in its cells, and whether nine of ten exact hits are found."""
    from ..operators import vectors as V
    from ..sources.scratch import scratch, written

    path, every = scratch(spark, "dense"), written(vectors(spark, d), "vectors")
    V.build(every, path)
    asked = written(every.where("pk % 50 = 0").selectExpr("pk as query_id", "vector"), "asked")
    row = V.recall(V.Dense(spark, path).search(asked), R.dense_route(every, asked))
    indexed = spark.read.parquet(f"{path}/vectors").agg(F.count(F.lit(1)).alias("indexed"))
    return row.join(F.broadcast(indexed)).select("queries", "indexed", (F.col("recall") >= 0.9).alias("enough"))


def vector_cache(spark, d):
    """Texts of half of the documents, then of all, then of all again: what was there, and what was sent."""
    from ..operators import vectors as V
    from ..sources.remote import hashed_vectors
    from ..sources.scratch import scratch

    embed, rows, before = V.Cached(spark, scratch(spark, "cache"), "hashed", hashed_vectors(2)), [], V.Served()
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pk"), F.col("text").alias("canonical"))
    for k, part in enumerate((docs.where("pk % 2 = 0"), docs, docs)):
        n, now = embed(part).count(), embed.served
        rows.append((k, n, now.hits - before.hits, now.sent - before.sent))
        before = V.Served(now.texts, now.hits, now.sent)
    return spark.createDataFrame(rows, "pass int, vectors bigint, hits bigint, sent bigint")


QUERIES |= {"dense_index_recall": dense_index_recall, "vector_cache": vector_cache}
SQL |= {
    "dense_index_recall": "SELECT count(*) FILTER (WHERE vec_id % 50 = 0) AS queries, count(*) AS indexed, true AS enough FROM embeddings",
    "vector_cache": """WITH h AS (SELECT count(*) AS n, count(DISTINCT text) AS k FROM documents WHERE doc_id % 2 = 0), a AS (SELECT count(*) AS n, count(DISTINCT text) AS k FROM documents),
        s AS (SELECT count(*) AS n FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id % 2 = 0))
        SELECT 0::INT AS pass, n AS vectors, 0::BIGINT AS hits, k AS sent FROM h UNION ALL SELECT 1, a.n, s.n, a.k - h.k FROM a, h, s UNION ALL SELECT 2, n, n, 0 FROM a""",
}
