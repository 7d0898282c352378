"""Re-ranking the head of a fused list with a scorer of passages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TOP_N, PASSAGE_CHARS = 30, 500
MODES = ("auto", "off", "api")

#: query, passages -> (index, score) of those it has ranked; it may leave some out
Scorer = Callable[[str, list[str]], list[tuple[int, float]]]


def mode(asked: str, configured: str = "auto") -> str:
    out = asked or configured
    if out not in MODES:
        raise ValueError(f"unknown re-ranking mode {out!r}")
    return out


def guarded(asked: str, retriever: str) -> tuple[str, str]:
    """(mode, why it is skipped): left to itself, re-ranking runs on the sparse route alone."""
    return ("off", f"retriever_{retriever}") if asked == "auto" and retriever != "sparse" else (asked, "")


def term_share(query: str, passages: list[str]) -> list[tuple[int, float]]:
    """A scorer without a model: share of the query's words in the passage."""
    words = set(query.lower().split())
    found = [(i, len(words & set(p.lower().split())) / max(1, len(words))) for i, p in enumerate(passages)]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def scored(head: DataFrame, scorer: Scorer) -> DataFrame:
    """``head``: query_id, query, ordinal, passage.  query_id, ordinal, rerank_score; positions that the scorer makes up or repeats are left out, and a scorer that fails leaves all out."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ordinal")
        try:
            got = scorer(f["query"].iloc[0], f["passage"].tolist())
        except Exception:
            got = []
        seen: dict[int, float] = {}
        for i, s in got:
            if 0 <= i < len(f) and i not in seen:
                seen[i] = float(s)
        return pd.DataFrame({"query_id": [key[0]] * len(seen), "ordinal": f["ordinal"].to_numpy()[list(seen)], "rerank_score": list(seen.values())})

    kind = head.schema["query_id"].dataType.simpleString()
    return head.groupBy("query_id").applyInPandas(run, f"query_id {kind}, ordinal bigint, rerank_score double")


def reordered(fused: DataFrame, scores: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """``fused``: query_id, pk, fused_rank; ``scores``: query_id, ordinal (= fused_rank), rerank_score.

    First what was scored in the head, best first, then the rest of the head, then the tail, each in fused order."""
    out = fused.join(scores.withColumnRenamed("ordinal", "fused_rank"), ["query_id", "fused_rank"], "left")
    inside = F.col("rerank_score").isNotNull() & (F.col("fused_rank") <= top_n)
    out = out.withColumn("_group", F.when(inside, 0).otherwise(1))
    by = Window.partitionBy("query_id").orderBy("_group", F.when(F.col("_group") == 0, -F.col("rerank_score")).asc_nulls_last(), "fused_rank")
    out = out.withColumn("position", F.row_number().over(by).cast("bigint"))
    return out.withColumn("rerank_rank", F.when(F.col("_group") == 0, F.col("position"))).drop("_group")


def counters(applied: DataFrame) -> DataFrame:
    """From the rows of ``apply``: one row, queries, reranked (with a scored hit), degraded (with none) and moved (whose first hit changed)."""
    each = applied.groupBy("query_id").agg(F.max("degraded").alias("degraded"), F.max((F.col("position") == 1) & (F.col("fused_rank") != 1)).alias("moved"))
    return each.agg(F.count(F.lit(1)).alias("queries"), F.count_if(~F.col("degraded")).alias("reranked"), F.count_if("degraded").alias("degraded"), F.count_if("moved").alias("moved"))


def apply(fused: DataFrame, scorer: Scorer, top_n: int = TOP_N, passage_chars: int = PASSAGE_CHARS) -> DataFrame:
    """``fused`` with query, title, section, body: in its new order; degraded is true for a query none of whose head was scored."""
    passage = T.passage(F.col("title"), F.col("section"), F.col("body"), passage_chars)
    head = fused.where(F.col("fused_rank") <= top_n).select("query_id", "query", F.col("fused_rank").alias("ordinal"), passage.alias("passage"))
    out = reordered(fused, scored(head, scorer), top_n)
    return out.withColumn("degraded", F.max(F.col("rerank_rank").isNotNull()).over(Window.partitionBy("query_id")) == F.lit(False))
