"""Retrieval evaluation as one job over all cases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nav_file
from ..sources.scratch import written


def first_hits(results: DataFrame, cases: DataFrame) -> DataFrame:
    """``results``: case_id, rank, path, source; ``cases``: case_id, expect (array), tag, include_index.

    One row per case: rank of the first path that holds an expected text (null: none), top1_path, top1_source, nav_top1."""
    both = cases.join(results, "case_id", "left")
    matches = F.exists("expect", lambda e: F.contains(F.col("path"), e))
    first = F.col("rank") == 1
    return both.groupBy("case_id").agg(
        F.min(F.when(matches, F.col("rank"))).alias("hit_rank"), F.max(F.when(first, F.col("path"))).alias("top1_path"), F.max(F.when(first, F.col("source"))).alias("top1_source"),
        F.first("tag").alias("tag"), F.coalesce(F.max(F.when(first, ~F.col("include_index") & nav_file(F.col("path")))), F.lit(False)).alias("nav_top1"),
    )


def _share(test):
    """A mean of 0 and 1, four places."""
    return F.round(F.avg(F.when(test, 1.0).otherwise(0.0)), 4)


def metrics(hits: DataFrame, k: int = 5, deep: int = 10, by: str | None = None) -> DataFrame:
    """cases, hit_at_1, hit_at_k, hit_at_deep, mrr; a miss counts 0.  ``by``: a column whose non-empty values are reported one by one."""
    deep = max(deep, k)
    r = F.col("hit_rank")
    rows = hits.where((F.col(by) != "") & F.col(by).isNotNull()).groupBy(by) if by else hits.groupBy()
    return rows.agg(
        F.count(F.lit(1)).alias("cases"), _share(r == 1).alias("hit_at_1"), _share(r <= k).alias("hit_at_k"), _share(r <= deep).alias("hit_at_deep"),
        F.round(F.avg(F.when(r <= deep, 1.0 / r).otherwise(0.0)), 4).alias("mrr"),
    )


def latency(times: DataFrame, column: str = "ms") -> DataFrame:
    """mean, p50, p95 by nearest rank, over any number of rows."""
    ranks = percentiles(times, column).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95))])
    return times.agg(F.round(F.avg(column), 1).alias("mean")).join(F.broadcast(ranks))  # one row each


def percentiles(times: DataFrame, column: str, qs: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest ranks over any number of rows: q, value.  Rows are counted by value and ranged; sums of the ranges give where each begins."""
    counts = times.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    parts = max(1, int(times.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(counts.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()), "percentiles")
    sums = ranged.groupBy("part").agg(F.sum("n").alias("s"))  # a row per range
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("b"), F.sum("s").over(Window.partitionBy()).alias("t"))
    up = ranged.join(F.broadcast(before), "part").withColumn("c", F.col("b") + F.sum("n").over(Window.partitionBy("part").orderBy("value")))
    asked = F.explode(F.array(*[F.lit(q) for q in qs]))
    return up.select("value", "n", "c", "t", asked.alias("q")).where((F.col("c") > F.bround((F.col("t") - 1) * F.col("q"))) & (F.col("c") - F.col("n") <= F.bround((F.col("t") - 1) * F.col("q")))).select("q", "value")


def expired(cases: DataFrame, paths: DataFrame) -> DataFrame:
    """Expected texts that no path of the corpus holds: case_id, expect.  Cases are the fixed side and are sent to the paths."""
    asked = cases.select("case_id", F.explode("expect").alias("expect"))
    found = paths.select("path").distinct().join(F.broadcast(asked), F.contains(F.col("path"), F.col("expect"))).select("case_id", "expect").distinct()
    return asked.join(found, ["case_id", "expect"], "left_anti")


def worst(hits: DataFrame, k: int = 5, show: int = 20) -> DataFrame:
    """Cases for a report's details: those without a hit first, then the latest hits beyond ``k``; at most ``show`` of each kind."""
    kind = F.when(F.col("hit_rank").isNull(), "miss").when(F.col("hit_rank") > k, "late")
    some = hits.withColumn("kind", kind).where("kind is not null")
    pick = lambda name, *order: some.where(F.col("kind") == name).orderBy(*order).limit(show)
    return pick("miss", "case_id").unionByName(pick("late", F.desc("hit_rank"), "case_id")).select("case_id", "kind", "hit_rank", "top1_path")


def source_label(c):
    return F.when(F.size(c) > 0, F.array_join(F.array_sort(c), "+")).otherwise("none")


@dataclass
class Gates:
    min_recall: float = 0.76
    min_mrr: float = 0.68
    min_hit1: float | None = None
    max_p50: float | None = None
    nav_top1: bool = True


def verdict(row, gates: Gates, p50: float | None = None, nav_top1: int = 0, broken_cases: int = 0) -> tuple[int, list[str]]:
    """(exit code, reasons): 0 pass, 2 a gate fails, 3 the cases or the corpus are wrong."""
    if broken_cases:
        return 3, [f"{broken_cases} cases expect paths that are not there"]
    why = []
    if row["hit_at_k"] < gates.min_recall:
        why.append(f"hit@k {row['hit_at_k']} < {gates.min_recall}")
    if row["mrr"] < gates.min_mrr:
        why.append(f"mrr {row['mrr']} < {gates.min_mrr}")
    if gates.min_hit1 is not None and row["hit_at_1"] < gates.min_hit1:
        why.append(f"hit@1 {row['hit_at_1']} < {gates.min_hit1}")
    if gates.max_p50 is not None and p50 is not None and p50 > gates.max_p50:
        why.append(f"p50 {p50} > {gates.max_p50}")
    if gates.nav_top1 and nav_top1:
        why.append(f"{nav_top1} cases have a navigation page on top")
    return (2 if why else 0), why


def needs_vectors(retriever: str) -> bool:
    return retriever in ("dense", "hybrid")


def render(report: dict) -> str:
    lines = [f"{k}: {v}" for k, v in report.items() if not isinstance(v, (list, dict))]
    lines += [f"  {k}: {v}" for group in report.values() if isinstance(group, dict) for k, v in group.items()]
    return "\n".join(lines)
