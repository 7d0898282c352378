"""Document index: classify what changed, reuse vectors, prune, and publish the changes as a segment of the index folder."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .errors import IndexMismatch
from .segments import COLUMNS, Store

SCHEMA_VERSION = "2"
#: Versions of an index that a build leaves to be gone back to, and to readers that have opened them.
VERSIONS = 3


# ---- what changed ----
def classified(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` with status: new, same, rewrite (only the weighted text changed: the vector stays), changed.  Hashes are of 32 digits, the first half for what is embedded."""
    before = old.select("pk", F.col("content_hash").alias("_old"))
    half = lambda c: F.substring(c, 1, 16)
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("content_hash"), "same").when(half(F.col("_old")) == half(F.col("content_hash")), "rewrite").otherwise("changed")
    return new.join(before, "pk", "left").withColumn("status", status).drop("_old")


def pruned(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the index that the corpus no longer has."""
    return old.join(new.select("pk"), "pk", "left_anti")


def with_vectors(rows: DataFrame, old: DataFrame) -> DataFrame:
    """Same and rewritten rows take the old vector; embed is true where one is needed (documents that have none)."""
    out = rows.join(old.select("pk", F.col("vector").alias("_v")), "pk", "left")
    keep = F.col("status").isin("same", "rewrite")
    out = out.withColumn("vector", F.when(keep, F.col("_v"))).drop("_v")
    return out.withColumn("embed", F.col("vector").isNull() & (F.col("kind") == "doc"))


def counters(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """One row: files, chunks, doc_rows, nav_rows, truncated, skipped, rewritten, embedded, pruned."""
    count = lambda c: F.count_if(c)
    one = rows.agg(
        F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("chunks"), count(F.col("kind") == "doc").alias("doc_rows"), count(F.col("kind") == "nav").alias("nav_rows"),
        count("truncated").alias("truncated"), count((F.col("status") == "same") & ~F.col("embed")).alias("skipped"), count((F.col("status") == "rewrite") & ~F.col("embed")).alias("rewritten"), count("embed").alias("embedded"),
    )
    return one.join(F.broadcast(gone.agg(F.count(F.lit(1)).alias("pruned"))))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: files, bytes, fingerprint (a sum of content hashes, so order does not matter)."""
    own = F.conv(F.substring(F.sha2(F.concat_ws("#", "path", "text"), 256), 1, 12), 16, 10).cast("decimal(20,0)")  # of 48 bits: a bigint holds the sum of some 32,000 at worst
    one = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint").alias("bytes"), F.coalesce(F.sum(own), F.lit(0)).cast("decimal(38,0)").alias("_sum"))
    return one.select("files", "bytes", F.concat_ws(":", "files", "bytes", "_sum").alias("fingerprint"))


def upserted(old: DataFrame, rows: DataFrame, key: str = "pk") -> DataFrame:
    """``rows`` instead of those of ``old`` with the same key."""
    return old.join(rows.select(key), key, "left_anti").unionByName(rows)


def deleted(old: DataFrame, keys: DataFrame, key: str = "pk") -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def statistics(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("kind") == "doc").alias("doc_rows"), F.count_if(F.col("kind") == "nav").alias("nav_rows"), F.count("vector").alias("vectors"))


# ---- building ----
@dataclass
class Report:
    mode: str
    skipped_all: bool = False
    counts: dict = field(default_factory=dict)


def build(store: Store, files: DataFrame, payloads: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, mode: str = "incremental", model: str = "") -> Report:
    """``files``: path, text (for the fingerprint); ``payloads``: the corpus as index rows without vectors.

    incremental reuses vectors and is skipped if neither corpus nor model changed; rebuild starts anew but keeps vectors that
    still fit; rebuild-vectors starts from nothing.  ``embed`` takes (pk, canonical) to (pk, vector)."""
    if mode not in ("incremental", "rebuild", "rebuild-vectors"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = store.spark
    empty = spark.createDataFrame([], COLUMNS)
    live = store.live()
    had = store.meta() if live else {}
    mark = fingerprint(files).first().fingerprint
    if mode == "incremental" and live and had.get("fingerprint") == mark and had.get("embedding_model", "") == model:
        return Report(mode, True)
    fits = had.get("schema_version") == SCHEMA_VERSION and had.get("embedding_model", "") == model
    if live and mode == "incremental" and not fits and had.get("embedding_model") and embed is not None:
        raise IndexMismatch("the index holds vectors of another model or schema: run with rebuild-vectors")
    old = store.read() if live and fits and mode != "rebuild-vectors" else empty
    rows = with_vectors(classified(payloads, old), old)
    if embed is None:
        rows = rows.withColumn("embed", F.lit(False))
    rows = written(rows, "classified")
    gone = written(pruned(old, payloads).select("pk"), "gone")
    counts = counters(rows, gone).first().asDict()
    settings = {"schema_version": SCHEMA_VERSION, "embedding_model": model if embed is not None else "", "fingerprint": mark, "counts": json.dumps(counts)}
    # a rebuild writes all rows anew, and so does what drops the vectors that are there
    change = mode == "incremental" and live and fits and had.get("embedding_model", "") == settings["embedding_model"]
    if change:
        rows = rows.where("status <> 'same' or embed")
    if embed is not None:
        fresh = embed(rows.where("embed").select("pk", "canonical")).select("pk", F.col("vector").cast("array<float>").alias("_new"))
        rows = rows.join(fresh, "pk", "left").withColumn("vector", F.coalesce("_new", "vector")).drop("_new")
        rows = written(rows, "embedded")  # the service is asked once
        counts |= getattr(embed, "report", {})
        settings["counts"] = json.dumps(counts)
    if change:
        store.apply(rows, gone, settings)
    else:
        store.publish(rows, settings)
    store.vacuum(VERSIONS)
    return Report(mode, False, counts)
