"""Chunking, metadata, index texts and incremental maintenance, over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C
from ..operators import index as I
from ..sources.tables import table


def chunk_hard_cut(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("body"))
    cut = C.cut_plain(docs)
    return cut.select("path", "pos", "section", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


def _headed(spark, d):
    """Every tenth line of a document becomes a heading."""
    lines = F.split("text", "\n")
    marked = F.transform(lines, lambda s, i: F.when(i % 10 == 0, F.concat(F.lit("## "), s)).otherwise(s))
    return table(spark, d, "documents").where("text <> ''").select(F.col("doc_id").cast("string").alias("path"), F.array_join(marked, "\n").alias("body"))


def chunk_sections(spark, d):
    out = C.chunked(_headed(spark, d))
    return out.select("path", "pos", "section", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


def page_metadata(spark, d):
    p = table(spark, d, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return p.select(
        "page_id", title.alias("title"), T.clean_title(F.regexp_replace("url", "[?#].*$", ""), ".html").alias("name"), T.mode_of(F.concat(title, F.when(F.col("page_id") % 3 == 0, "（mysql 模式）").otherwise(""))).alias("mode"),
        T.version_of(F.col("url"), F.concat(F.lit("V4."), (F.col("page_id") % 5).cast("string"), F.lit(".1 "))).alias("version"), T.nav_file(F.col("url")).alias("nav"),
        T.clean_keywords(F.concat_ws(",", F.lit("site"), F.regexp_extract("url", "/(en|de|fr|es)/", 1), F.lit(" tail ")), ("site",)).alias("keywords"), T.canonical_mode(F.when(F.col("page_id") % 2 == 0, " ORACLE ").otherwise("other ")).alias("asked_mode"),
    )


def _payload(spark, d):
    docs = table(spark, d, "documents")
    t, k, s, b = F.col("source"), F.col("lang"), F.lit("body"), F.col("text")
    return docs.select("doc_id", "text", F.col("doc_id").alias("pk"), F.col("source").alias("path"), T.weighted_text(t, k, s, b).alias("weighted"), T.canonical_text(t, k, s, b).alias("canonical"))


def weighted_text(spark, d):
    p = _payload(spark, d)
    return p.select("doc_id", F.length("weighted").cast("bigint").alias("weighted_chars"), F.md5("weighted").alias("weighted_md5"), F.md5("canonical").alias("canonical_md5"))


def content_hash(spark, d):
    return _payload(spark, d).select("doc_id", T.content_hash(F.col("canonical"), F.col("weighted")).alias("content_hash"))


def byte_cut(spark, d):
    cut = T.byte_cut(F.col("text"), 1000)
    return table(spark, d, "documents").select("doc_id", F.octet_length(cut).cast("bigint").alias("bytes"), F.startswith(F.col("text"), F.regexp_replace(cut, "…$", "")).alias("is_prefix"), (F.octet_length(cut) < F.octet_length("text")).alias("cut"))


def excerpts(spark, d):
    terms = F.array(F.lit("idiot"), F.lit("the"), F.lit("licensed"))
    return table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text"), terms, 120).alias("excerpt"))


def titles(spark, d):
    return table(spark, d, "documents").select("doc_id", T.title_of(F.col("text")).alias("title"), T.capped(F.col("text"), 80).alias("head"), T.passage(F.col("source"), F.col("lang"), F.col("text"), 200).alias("passage"))


def corpus_fingerprint(spark, d):
    return I.fingerprint(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))


def _versions(spark, d):
    """The corpus, and an index built from an older state of it: some rows are missing, some had another body, some another weighting, some are gone from the corpus."""
    k = F.col("pk") % 10
    now = _payload(spark, d).withColumn("content_hash", T.content_hash(F.col("canonical"), F.col("weighted"))).withColumn("kind", F.when(k == 5, "nav").otherwise("doc")).withColumn("truncated", F.octet_length("weighted") > 8000)
    new = now.where(k != 9).select("pk", "path", "content_hash", "kind", "truncated")
    hashed = F.when(k == 1, F.concat(F.lit("0" * 16), F.substring("content_hash", 17, 16))).when(k == 2, F.concat(F.substring("content_hash", 1, 16), F.lit("0" * 16))).otherwise(F.col("content_hash"))
    old = now.where(k != 0).select("pk", hashed.alias("content_hash"), F.when((k != 3) & (F.col("kind") == "doc"), F.array(F.lit(1.0).cast("float"))).alias("vector"))
    return new, old


def incremental_classify(spark, d):
    new, old = _versions(spark, d)
    return I.with_vectors(I.classified(new, old), old).select("pk", "status", "embed")


def incremental_prune(spark, d):
    new, old = _versions(spark, d)
    return I.pruned(old, new).select("pk")


def build_counters(spark, d):
    new, old = _versions(spark, d)
    return I.counters(I.with_vectors(I.classified(new, old), old), I.pruned(old, new))


def index_upsert(spark, d):
    new, old = _versions(spark, d)
    merged = I.upserted(old.select("pk", "content_hash"), new.select("pk", "content_hash"))
    return I.deleted(merged, I.pruned(old, new)).select("pk", "content_hash")


QUERIES = {
    f.__name__: f
    for f in (chunk_hard_cut, chunk_sections, page_metadata, weighted_text, content_hash, byte_cut, excerpts, titles, corpus_fingerprint, incremental_classify, incremental_prune, build_counters, index_upsert)
}

_P = """p AS (SELECT doc_id, text, source || ' ' || source || ' ' || source || ' ' || source || ' ' || source || ' ' || lang || ' ' || lang || ' body | ' || text AS weighted,
  source || ' ' || lang || ' body | ' || text AS canonical, source AS path FROM documents),
h AS (SELECT *, sha256(canonical)[1:16] || sha256(weighted)[1:16] AS content_hash, doc_id % 10 AS k, CASE WHEN doc_id % 10 = 5 THEN 'nav' ELSE 'doc' END AS kind, strlen(weighted) > 8000 AS truncated FROM p)"""
_V = f"""{_P}, new AS (SELECT doc_id AS pk, * FROM h WHERE k <> 9),
old AS (SELECT doc_id AS pk, CASE k WHEN 1 THEN '0000000000000000' || content_hash[17:32] WHEN 2 THEN content_hash[1:16] || '0000000000000000' ELSE content_hash END AS content_hash, k <> 3 AND kind = 'doc' AS has_vector FROM h WHERE k <> 0),
c AS (SELECT new.*, CASE WHEN old.pk IS NULL THEN 'new' WHEN old.content_hash = new.content_hash THEN 'same' WHEN old.content_hash[1:16] = new.content_hash[1:16] THEN 'rewrite' ELSE 'changed' END AS status, has_vector FROM new LEFT JOIN old USING (pk)),
e AS (SELECT *, kind = 'doc' AND NOT (status IN ('same', 'rewrite') AND has_vector) AS embed FROM c)"""

SQL = {
    "chunk_hard_cut": r"""SELECT doc_id::VARCHAR AS path, i AS pos, '正文' AS section, length(t)::BIGINT AS chars, md5(t) AS digest
        FROM (SELECT doc_id, i, substr(text, (1800 * i + 1)::BIGINT, 1800) AS t FROM (SELECT doc_id, text, unnest(range(greatest((length(text) + 1799) // 1800, 1))) AS i FROM documents)) WHERE i = 0 OR regexp_matches(t, '\S')""",
    "chunk_sections": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text <> ''),
        g AS (SELECT doc_id, i // 10 AS g, trim(any_value(s) FILTER (WHERE i % 10 = 0)) AS section, string_agg(s, chr(10) ORDER BY i) FILTER (WHERE i % 10 <> 0) AS body FROM l GROUP BY ALL),
        c AS (SELECT doc_id, g, section, j, substr(body, (1800 * j + 1)::BIGINT, 1800) AS t FROM (SELECT *, unnest(range((length(body) + 1799) // 1800)) AS j FROM g WHERE body IS NOT NULL)),
        k AS (SELECT * FROM c WHERE regexp_matches(t, '\S')),
        a AS (SELECT doc_id, section, t, row_number() OVER (PARTITION BY doc_id ORDER BY g, j) - 1 AS pos FROM k
              UNION ALL SELECT doc_id, '正文', substr(b, (1800 * j + 1)::BIGINT, 1800), j FROM (SELECT doc_id, '## ' || text AS b, unnest(range((length('## ' || text) + 1799) // 1800)) AS j FROM documents WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM k)))
        SELECT doc_id::VARCHAR AS path, pos::BIGINT AS pos, section, length(t)::BIGINT AS chars, md5(t) AS digest FROM a""",
    "page_metadata": r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(regexp_replace(url, '[?#].*$', ''), '\.html$', '') AS name,
        CASE WHEN page_id % 3 = 0 THEN 'MySQL' ELSE '' END AS mode, CASE WHEN regexp_matches(url, '[Vv]\d+\.\d+') THEN regexp_extract(url, '[Vv](\d+\.\d+(?:\.\d+)*)', 1) ELSE '4.' || page_id % 5 || '.1' END AS version,
        lower(string_split(url, '/')[-1]) IN ('index.md', 'readme.md') AS nav, CASE WHEN regexp_matches(url, '/(en|de|fr|es)/') THEN regexp_extract(url, '/(en|de|fr|es)/', 1) || ' tail' ELSE 'tail' END AS keywords,
        CASE WHEN page_id % 2 = 0 THEN 'Oracle' ELSE 'other' END AS asked_mode FROM pages""",
    "weighted_text": f"WITH {_P} SELECT doc_id, length(weighted)::BIGINT AS weighted_chars, md5(weighted) AS weighted_md5, md5(canonical) AS canonical_md5 FROM p",
    "content_hash": f"WITH {_P} SELECT doc_id, content_hash FROM h",
    "byte_cut": r"""WITH c AS (SELECT doc_id, text, CASE WHEN strlen(text) > 1000 THEN (SELECT max(n) FROM range(0, 998) r(n) WHERE strlen(left(text, n::BIGINT)) <= 997) END AS n FROM documents)
        SELECT doc_id, CASE WHEN n IS NULL THEN strlen(text) ELSE strlen(left(text, n::BIGINT)) + 3 END::BIGINT AS bytes, true AS is_prefix, n IS NOT NULL AND strlen(left(text, n::BIGINT)) + 3 < strlen(text) AS cut FROM c""",
    "excerpts": r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
        h AS (SELECT *, least(nullif(instr(lower(t), 'idiot'), 0), nullif(instr(lower(t), 'the'), 0), nullif(instr(lower(t), 'licensed'), 0)) AS p FROM t),
        b AS (SELECT *, CASE WHEN p IS NULL THEN 0 ELSE greatest(0, p - 1 - 40) END AS s FROM h)
        SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || trim(substr(t, s + 1, 120)) || CASE WHEN s + 120 < length(t) THEN '…' ELSE '' END AS excerpt FROM b""",
    "titles": r"""WITH t AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, source, lang FROM documents)
        SELECT doc_id, CASE WHEN trim(left(t, 40)) = '' THEN 'untitled' ELSE trim(left(t, 40)) END AS title, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS head,
          left(source || ' > ' || lang || chr(10) || t, 200) AS passage FROM t""",
    "corpus_fingerprint": """SELECT count(*) AS files, sum(strlen(text))::BIGINT AS bytes, count(*) || ':' || sum(strlen(text)) || ':' || sum(('0x' || sha256(doc_id || '#' || text)[1:12])::BIGINT) AS fingerprint FROM documents""",
    "incremental_classify": f"WITH {_V} SELECT pk, status, embed FROM e",
    "incremental_prune": f"WITH {_V} SELECT pk FROM old WHERE pk NOT IN (SELECT pk FROM new)",
    "build_counters": f"""WITH {_V} SELECT count(DISTINCT path) AS files, count(*) AS chunks, count(*) FILTER (WHERE kind = 'doc') AS doc_rows, count(*) FILTER (WHERE kind = 'nav') AS nav_rows, count(*) FILTER (WHERE truncated) AS truncated,
        count(*) FILTER (WHERE status = 'same' AND NOT embed) AS skipped, count(*) FILTER (WHERE status = 'rewrite' AND NOT embed) AS rewritten, count(*) FILTER (WHERE embed) AS embedded,
        (SELECT count(*) FROM old WHERE pk NOT IN (SELECT pk FROM new)) AS pruned FROM e""",
    "index_upsert": f"WITH {_V} SELECT pk, content_hash FROM new",
}
