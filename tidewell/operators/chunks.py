"""Markdown to chunks: sections under their heading trail, cut to size, with the file's metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CHUNK_CHARS, LEAST_PART = 1800, 200
NO_SECTION = "正文"
_HEADING = re.compile(r"(#{1,3})\s+(.*)")


def parts(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Pieces of at most ``size`` characters, cut before the last empty line beyond ``LEAST_PART``, else hard; a blank rest is dropped."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind("\n\n", at, at + size)
        stop = cut if cut - at > LEAST_PART else at + size
        yield text[at:stop]
        at = stop
    if text[at:].strip():
        yield text[at:]


def sections(body: str, size: int = CHUNK_CHARS) -> list[tuple[str, str]]:
    """(trail, text).  Text before the first second- or third-level heading belongs to none; without such headings
    the whole body is one section, named by its first-level heading."""
    second = third = top = ""
    named: list[tuple[str, list[str]]] = []
    for line in body.splitlines():
        m = _HEADING.fullmatch(line)
        level = len(m[1]) if m else 0
        if level == 2:
            second, third = m[2].strip(), ""
        elif level == 3:
            third = m[2].strip()
        elif level == 1 and not top:
            top = m[2].strip()
        if level >= 2:
            named.append((" > ".join(x for x in (second, third) if x), []))
        elif named:
            named[-1][1].append(line)
    out = [(trail, p) for trail, lines in named if lines for p in parts("\n".join(lines), size)]
    return out or [(top or NO_SECTION, p) for p in (list(parts(body, size)) or [body])]


def chunked(files: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """``files``: path, body.  One row per chunk: path, pos, section, text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, i, s, t) for p, b in zip(f["path"], f["body"], strict=True) for i, (s, t) in enumerate(sections(b or "", size))]
            yield pd.DataFrame(rows, columns=["path", "pos", "section", "text"])

    return files.select("path", "body").mapInPandas(run, "path string, pos bigint, section string, text string")


def cut_plain(files: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """The same for texts known to hold neither headings nor empty lines, without Python: hard cuts only."""
    n = F.greatest(F.ceil(F.length("body") / size).cast("int"), F.lit(1))
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("body", i * size + 1, F.lit(size)))
    exploded = files.select("path", F.posexplode(F.filter(pieces, lambda p, i: (i == 0) | (F.trim(F.regexp_replace(p, T.BLANKS, "")) != ""))).alias("pos", "text"))
    return exploded.select("path", F.col("pos").cast("bigint").alias("pos"), F.lit(NO_SECTION).alias("section"), "text")


def payloads(files: DataFrame, *, suffix: str = "", noise: tuple[str, ...] = (), max_bytes: int = 8000) -> DataFrame:
    """``files``: path, text (Markdown).  The index rows without vectors: key, hashes, texts and metadata."""
    meta = T.frontmatter(F.col("text"))
    at = lambda k: F.coalesce(F.try_element_at(F.col("_meta"), F.lit(k)), F.lit(""))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    base = files.withColumn("_meta", meta).withColumn("body", T.body_of(F.col("text"))).withColumn("_stem", T.clean_title(stem, suffix) if suffix else stem)
    shown = F.coalesce(F.nullif(at("title"), F.lit("")), F.col("_stem"))
    base = base.select(
        "path", "body", T.composite_title(shown, F.when(F.col("_stem") != shown, F.col("_stem")), at("description")).alias("title"),
        T.clean_keywords(at("keywords"), noise or ("",)).alias("keywords"), F.when(T.nav_file(F.col("path")), "nav").otherwise("doc").alias("kind"),
    )
    chunks = chunked(base).join(base.drop("body"), "path")
    seq = F.row_number().over(Window.partitionBy("path", "section").orderBy("pos")) - 1
    chunks = chunks.withColumn("seq", seq.cast("bigint")).withColumnRenamed("text", "body")
    whole = T.weighted_text(F.col("title"), F.col("keywords"), F.col("section"), F.col("body"))
    out = chunks.withColumn("text", T.byte_cut(whole, max_bytes)).withColumn("truncated", F.octet_length(whole) > max_bytes if max_bytes > 0 else F.lit(False))
    out = out.withColumn("canonical", T.canonical_text(F.col("title"), F.col("keywords"), F.col("section"), F.col("body")))
    return out.select(
        T.chunk_key(F.col("path"), F.col("section"), F.col("seq")).alias("pk"), T.content_hash(F.col("canonical"), F.col("text")).alias("content_hash"), "text", "kind", "path", "section", "title",
        "keywords", T.mode_of(F.concat_ws(" ", "title", "section", "path")).alias("mode"), T.version_of(F.col("section"), F.col("path")).alias("version"), "canonical", "truncated", "seq", "pos", "body",
    )


def duplicate_keys(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("pk").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def read(chunks: DataFrame, path: str, section: str | None = None, max_chars: int = 6000) -> DataFrame:
    """One row: the sections of a file whose name holds ``section`` (any case), joined by empty lines and cut."""
    limit = max(200, min(max_chars, 20000))
    own = chunks.where(F.col("path") == path)
    kept = own if not section else own.where(F.contains(F.lower("section"), F.lit(section.lower())))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "body", "section"))), lambda s: s)
    one = kept.groupBy("path").agg(F.first("title").alias("title"), ordered.alias("s"))
    text = F.array_join(F.transform("s", lambda s: s["body"]), "\n\n")
    return one.select(
        "path", "title", F.lit(section or "").alias("section"), F.substring(text, 1, limit).alias("text"), (F.length(text) > limit).alias("truncated"), F.length(text).alias("total_chars"),
        F.array_distinct(F.transform("s", lambda s: s["section"])).alias("sections"),
    )
