"""Document corpora and evaluation cases."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.errors import DocumentPathError

# Fixed value: the folder that paths of the corpus are given under.
PREFIX = "ob_wiki/"


def markdown(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Every .md file under a folder: path (from the folder), text; undecodable bytes are replaced.  ``limit``: the first by path."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(base)
    full = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    out = files.select(F.substring_index(full, base.split(":", 1)[-1].lstrip("/") + "/", -1).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return out if limit is None else out.orderBy("path").limit(limit)


def paths(files: DataFrame) -> DataFrame:
    return files.select(F.concat(F.lit(PREFIX), "path").alias("path")).distinct()


def safe_path(asked: str, known: str = "") -> str:
    """A path inside the corpus, without the folders that users put before it."""
    p = (asked or "").strip().replace("\\", "/")
    if not p or p.startswith("/") or p[1:2] == ":" or ".." in p.split("/"):
        raise DocumentPathError(f"not a path of the corpus: {asked!r}")
    p = posixpath.normpath(p)
    for head in ("doc/", PREFIX, known):
        if head and p.startswith(head):
            p = p[len(head) :]
    return p


def cases(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (blank lines and # comments are skipped) to case_id, query, expect, mode, version, include_index, tag.

    Missing fields, bad JSON and repeated ids are errors that name the line."""
    lines = [(i, s.strip()) for i, s in enumerate(spark.read.text(path, wholetext=True).first()[0].splitlines(), 1)]
    seen: dict[str, int] = {}
    rows = []
    for i, s in lines:
        if not s or s.startswith("#"):
            continue
        try:
            c = json.loads(s)
        except ValueError as e:
            raise ValueError(f"line {i}: {e}") from e
        missing = [k for k in ("id", "query", "expect") if not c.get(k)]
        if missing:
            raise ValueError(f"line {i}: {', '.join(missing)} missing")
        if c["id"] in seen:
            raise ValueError(f"line {i}: id {c['id']!r} stands in line {seen[c['id']]} too")
        seen[c["id"]] = i
        expect = c["expect"] if isinstance(c["expect"], list) else [c["expect"]]
        rows.append((c["id"], c["query"], expect, c.get("mode", ""), c.get("version", ""), bool(c.get("include_index")), c.get("tag", "")))
    return spark.createDataFrame(rows, "case_id string, query string, expect array<string>, mode string, version string, include_index boolean, tag string")
