"""Search as a whole: filters, routes, adjustment, fusion, re-ranking, per-document cap, and a ledger of what was degraded.

Everything up to the ledger is driver planning; the entries are one lazy DataFrame for all queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..sources.scratch import written
from . import filters, rerank
from . import retrieval as R
from .errors import IndexMissing, SearchDegraded, redact_text
from .postings import Stored

RETRIEVERS = ("sparse", "dense", "hybrid")


@dataclass
class Ledger:
    retriever: str
    degraded: str = ""
    rerank_mode: str = "off"
    rerank_skipped: str = ""
    filters: dict = field(default_factory=dict)
    relaxed: bool = False
    #: What failed, if anything did: kind of the error and its text.
    failure: str = ""

    @property
    def ok(self) -> bool:
        return not self.degraded

    def whole(self) -> None:
        """An error unless every route that was asked for has run."""
        if not self.ok:
            raise SearchDegraded(f"{self.degraded}: {self.failure or 'not built or not configured'}")


def has_vectors(meta: dict[str, str]) -> bool:
    return bool(meta.get("embedding_model"))


def detected(text: str, spark) -> tuple[str, str]:
    """Mode and version that a question names."""
    r = spark.range(1).select(T.mode_of(F.lit(text)).alias("m"), T.version_of(F.lit(text)).alias("v")).first()
    return r.m, r.v


def embedded(embed_query: Callable[[DataFrame], DataFrame], queries: DataFrame) -> tuple[DataFrame | None, str]:
    """The vectors of the query set, made now; if that fails in any way none, and what failed."""
    try:
        return written(embed_query(queries).select("query_id", "vector"), "query-vectors"), ""
    except Exception as e:
        return None, failure(e)


def failure(e: Exception) -> str:
    return redact_text(f"{type(e).__name__}: {e}")


def with_fields(hits: DataFrame, chunk: DataFrame, most: int) -> DataFrame:
    """``hits`` (at most ``most``) with the columns of their chunks: few hits go to where the chunks are read."""
    return chunk.join(R.small(hits, most), "pk")


def search(
    index: DataFrame | None,
    queries: DataFrame,
    *,
    retriever: str = "",
    limit: int = 5,
    mode: str = "",
    version: str = "",
    include_index: bool = False,
    settings: Settings | None = None,
    meta: dict[str, str] | None = None,
    embed_query: Callable[[DataFrame], DataFrame] | None = None,
    scorer: rerank.Scorer | None = None,
    rerank_mode: str = "",
    postings: Stored | None = None,
) -> tuple[DataFrame | None, Ledger]:
    """``index``: index rows; ``queries``: query_id, query; ``embed_query``: (query_id, query) to (query_id, vector);
    ``postings``: a stored inverted index of the same rows, without which terms are counted from their texts.

    Returns the entries (query_id, position, pk, path, section, title, kind, mode, version, source, score, sparse_rank,
    dense_rank, rerank_rank, rerank_score, snippet) and the ledger; without an index there are no entries.  A route that
    cannot run is left out and named in the ledger with what failed; only a wrong retriever or re-ranking mode is an error.
    Who needs all routes asks the ledger (``whole``)."""
    s = settings or Settings()
    retriever = retriever or s.default_retriever
    if retriever not in RETRIEVERS:
        raise ValueError(f"unknown retriever {retriever!r}")
    asked = rerank.mode(rerank_mode, s.rerank_mode)
    used, skipped = rerank.guarded(asked, retriever)
    ledger = Ledger(retriever, rerank_mode=used, rerank_skipped=skipped, filters={"mode": mode, "version": version, "include_index": include_index})
    if index is None:
        ledger.degraded = "index_missing"
        return None, ledger
    if "body" not in index.columns:
        index = index.withColumn("body", F.regexp_replace("text", r"(?s)^.*? \| ", ""))
    kept = index.where(filters.scalar(F.col("kind"), F.col("mode"), F.col("version"), mode, version, include_index))
    terms = queries.select("query_id", "query", T.query_terms(F.col("query")).alias("_terms"))
    fields = [c for c in ("path", "section", "title", "keywords", "kind", "mode", "version", "body") if c in index.columns]
    chunk = kept.select("pk", *fields)
    n = queries.count()
    routes = []
    if retriever in ("sparse", "hybrid"):
        may = filters.scalar(F.col("kind"), F.col("mode"), F.col("version"), mode, version, include_index)
        found = postings.search(queries, s.pool_k, expand=True, keep=may) if postings is not None else R.sparse_route(index, queries, s.pool_k, expand=True, kept=may)
        hits = with_fields(found.drop("rank"), chunk, n * s.pool_k).join(R.small(terms, n), "query_id")
        routes.append(("sparse", s.weight_sparse, R.adjusted(hits, version, include_index, F.col("_terms"))))
    if retriever in ("dense", "hybrid"):
        ready = embed_query is not None and (meta is None or has_vectors(meta)) and "vector" in index.columns
        asked_vectors, ledger.failure = embedded(embed_query, queries) if ready else (None, "")
        if asked_vectors is not None:
            own = kept.where("kind = 'doc'").select("pk", "vector")
            hits = with_fields(R.dense_route(own, asked_vectors, s.pool_k).drop("rank"), chunk, n * s.pool_k)
            routes.append(("dense", s.weight_dense, R.adjusted(hits, version, include_index)))
        else:
            ledger.degraded = "dense_unavailable"
    if not routes:
        return None, ledger
    fused = R.fused(routes, s.rrf_k)
    for name in ("sparse_rank", "dense_rank"):
        if name not in fused.columns:
            fused = fused.withColumn(name, F.lit(None).cast("bigint"))
    hits = with_fields(fused, chunk, n * s.pool_k * len(routes)).join(R.small(terms, n), "query_id")
    order = "fused_rank"
    if scorer is not None and used != "off":
        hits, order = rerank.apply(hits, scorer, s.rerank_top_n, s.rerank_passage_chars).withColumnRenamed("position", "_place"), "_place"
    else:
        hits = hits.withColumn("rerank_rank", F.lit(None).cast("bigint")).withColumn("rerank_score", F.lit(None).cast("double"))
    out = R.capped(hits, order, limit=limit)
    return out.select(
        "query_id", "position", "pk", "path", "section", "title", "kind", "mode", "version", "source", F.round("score", 5).alias("score"), "sparse_rank", "dense_rank", "rerank_rank", "rerank_score",
        T.excerpt(F.col("body"), F.col("_terms")).alias("snippet"),
    ), ledger


def ask(index: DataFrame | None, query: str, spark, *, mode: str | None = None, version: str | None = None, **options) -> tuple[DataFrame | None, Ledger]:
    """One question: mode and version are taken from its words unless given, and given up if they leave nothing."""
    q = spark.createDataFrame([(0, query)], "query_id bigint, query string")
    explicit = bool(mode or version)
    m, v = (mode or "", version or "") if explicit else detected(query, spark)
    try:
        out, ledger = _answer(search(index, q, mode=m, version=v, **options))
        if out is not None and not explicit and (m or v) and out.isEmpty():
            again, ledger = _answer(search(index, q, **options))
            ledger.relaxed = True
            if not again.isEmpty():
                out = again
    except ValueError:  # a wrong retriever or re-ranking mode
        raise
    except Exception as e:
        return None, Ledger(options.get("retriever") or (options.get("settings") or Settings()).default_retriever, "index_missing" if isinstance(e, IndexMissing) else "index_unavailable", failure=failure(e))
    return out, ledger


def _answer(found: tuple[DataFrame | None, Ledger]) -> tuple[DataFrame | None, Ledger]:
    """The entries of one question, made now: at most twenty rows."""
    out, ledger = found
    return (out if out is None else written(out, "answer")), ledger


def evaluate(index: DataFrame, cases: DataFrame, *, k: int = 5, deep: int = 10, **options):
    """All cases in one job: (hits per case, metrics, metrics by tag, metrics by source)."""
    from . import evaluation as E

    queries = cases.select(F.col("case_id").alias("query_id"), "query")
    out, ledger = search(index, queries, limit=max(k, deep), **options)
    results = out.select(F.col("query_id").alias("case_id"), F.col("position").alias("rank"), "path", "source")
    hits = E.first_hits(results, cases)
    return hits, E.metrics(hits, k, deep), E.metrics(hits, k, deep, "tag"), E.metrics(hits, k, deep, "top1_source"), ledger
