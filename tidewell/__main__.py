"""python -m tidewell index INDEX --corpus DIR [--mode M] [--vectors N] | stats INDEX | eval INDEX CASES: build, look at and evaluate a document index.

Exit codes of eval: 0 pass, 2 a gate fails, 3 the cases or the corpus are wrong."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .config import load
from .operators import chunks, evaluation, index, search
from .sources import corpus, remote


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewell", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    b = sub.add_parser("index")
    b.add_argument("index")
    b.add_argument("--corpus", required=True)
    b.add_argument("--mode", default="incremental", choices=("incremental", "rebuild", "rebuild-vectors"))
    b.add_argument("--limit", type=int)
    b.add_argument("--vectors", type=int, default=0, help="dimensions of hashed vectors; 0 for none")
    sub.add_parser("stats").add_argument("index")
    e = sub.add_parser("eval")
    e.add_argument("index")
    e.add_argument("cases")
    e.add_argument("--retriever", default="sparse", choices=search.RETRIEVERS)
    e.add_argument("--k", type=int, default=5)
    e.add_argument("--min-recall", type=float, default=0.76)
    e.add_argument("--min-mrr", type=float, default=0.68)
    e.add_argument("--json")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tidewell").getOrCreate()
    store = index.Store(spark, a.index)
    if a.what == "stats":
        print(json.dumps(store.health(), ensure_ascii=False))
        return 0
    if a.what == "index":
        files = corpus.markdown(spark, a.corpus, a.limit)
        embed = remote.hashed_vectors(a.vectors) if a.vectors else None
        report = index.build(store, files, chunks.payloads(files, max_bytes=load().max_text_bytes), embed, a.mode, f"hashed-{a.vectors}" if a.vectors else "")
        print(json.dumps({"skipped_all": report.skipped_all} | report.counts))
        return 0
    try:
        cases = corpus.cases(spark, a.cases).cache()
        rows = store.read()
    except Exception as err:
        print(err, file=sys.stderr)
        return 3
    meta = store.meta()
    dims = int(meta.get("embedding_model", "hashed-0").rpartition("-")[2] or 0)
    embed = (lambda q: remote.hashed_vectors(dims)(q.selectExpr("query_id as pk", "query as canonical")).withColumnRenamed("pk", "query_id")) if dims else None
    broken = evaluation.expired(cases, corpus.paths(rows)).select("case_id").distinct().count()
    hits, whole, by_tag, by_source, ledger = search.evaluate(rows, cases, k=a.k, retriever=a.retriever, meta=meta, embed_query=embed, postings=store.postings())
    hits = hits.cache()
    row = whole.first().asDict()
    code, why = evaluation.verdict(row, evaluation.Gates(a.min_recall, a.min_mrr), nav_top1=hits.where("nav_top1").count(), broken_cases=broken)
    report = row | {"retriever": a.retriever, "degraded": ledger.degraded, "by_tag": {r.tag: r.hit_at_k for r in by_tag.collect()}, "by_source": {r.top1_source: r.hit_at_k for r in by_source.collect()}, "failed": why}
    if a.json:
        with open(a.json, "w") as f:
            json.dump(report, f, ensure_ascii=False)
    print(evaluation.render(report))
    return code


if __name__ == "__main__":
    sys.exit(main())
