"""Chunking, text functions, the index and its storage."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import numbers as N
from tidewell.functions import text as T
from tidewell.operators import chunks as C
from tidewell.operators import index as I
from tidewell.operators.errors import IndexMismatch, IndexMissing
from tidewell.sources.remote import hashed_vectors

DOC = "---\ntitle: Lock waits-X\nDescription: all of them\nkeywords: lock, site，wait\n---\n# Top\nlost\n## One\nfirst\n### Deep V4.2.1\nsecond\n## Two\nthird\n"


def one(spark, c, **values):
    kinds = {str: "string", int: "bigint", float: "double", list: "array<string>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(c.alias("x")).first().x


def test_sections():
    assert C.sections("a\n## H\nb\n### K\nc\n## M\nd") == [("H", "b"), ("H > K", "c"), ("M", "d")]
    assert C.sections("# T\nx") == [("T", "# T\nx")] and C.sections("x") == [(C.NO_SECTION, "x")] and C.sections("") == [(C.NO_SECTION, "")]
    assert C.sections("### K\nc\n## M\n### N\nd") == [("K", "c"), ("M > N", "d")]


def test_parts():
    assert list(C.parts("x" * 4000)) == ["x" * 1800, "x" * 1800, "x" * 400]
    text = "a" * 500 + "\n\n" + "b" * 1500
    assert list(C.parts(text)) == ["a" * 500, "\n\n" + "b" * 1500]
    early = "a" * 150 + "\n\n" + "b" * 2000
    assert [len(p) for p in C.parts(early)] == [1800, 352]
    assert list(C.parts("x" * 1800 + " \n")) == ["x" * 1800]


def test_two_chunkers_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("body"))
    assert sorted(C.chunked(docs).collect()) == sorted(C.cut_plain(docs).collect())


def test_payloads(spark):
    files = spark.createDataFrame([("a/locks-X.md", DOC), ("index.md", "# Index\n- x"), ("b.md", "plain " * 2000)], "path string, text string")
    got = C.payloads(files, suffix="-X", noise=("site",))
    rows = {(r.path, r.section, r.seq): r for r in got.collect()}
    r = rows["a/locks-X.md", "One > Deep V4.2.1", 0]
    assert (r.title, r.keywords, r.kind, r.version, r.body) == ("Lock waits-X locks all of them", "lock wait", "doc", "4.2.1", "second")
    assert r.text == " ".join([r.title] * 5 + [r.keywords] * 2 + [r.section]) + " | second" and r.canonical == f"{r.title} {r.keywords} {r.section} | second"
    assert rows["index.md", "Index", 0].kind == "nav" and len([k for k in rows if k[0] == "b.md"]) == 7
    assert all(x.pk >= 0 and len(x.content_hash) == 32 for x in rows.values()) and C.duplicate_keys(got).count() == 0
    doc = C.read(got, "a/locks-X.md", "deep").first()
    assert (doc.text, doc.truncated, doc.sections) == ("second", False, ["One > Deep V4.2.1"])
    assert C.read(got, "b.md", max_chars=10).first().text == ("plain " * 2000)[:200] and C.read(got, "b.md", "nothing").count() == 0


def test_text_functions(spark):
    c = F.col("s")
    assert one(spark, T.collapse(c), s=" a\t\n　b ") == "a b" and one(spark, T.capped(c, 3), s="abcd") == "abc…" and one(spark, T.title_of(c), s="   ") == "untitled"
    assert one(spark, T.frontmatter(c), s=DOC) == {"title": "Lock waits-X", "description": "all of them", "keywords": "lock, site，wait"} and one(spark, T.frontmatter(c), s="x") == {}
    assert one(spark, T.mode_of(c), s="在 oracle 模式 下") == "Oracle" and one(spark, T.mode_of(c), s="系统租户") == "sys" and one(spark, T.mode_of(c), s="x") == ""
    assert one(spark, T.version_of(c), s="see v4.3.2.1!") == "4.3.2.1" and one(spark, T.nav_section(c), s="a > 相关文档") and not one(spark, T.nav_section(c), s="相关文档 > b")
    for n in range(4, 14):
        want = "aé😀b漢".encode()
        got = one(spark, T.byte_cut(c, n), s="aé😀b漢")
        assert len(got.encode()) <= max(n, 3) and (got == "aé😀b漢" if len(want) <= n else got.endswith("…") and "aé😀b漢".startswith(got[:-1]))
    assert one(spark, T.query_terms(c), s="A big, BIG 锁 x 1 22") == ["big", "锁", "22"]
    assert one(spark, T.excerpt(c, F.array(F.lit("zebra")), 30), s="word " * 40 + "a zebra here " + "word " * 40).count("zebra") == 1
    assert one(spark, T.redact(c), s="at 10.1.2.3:2881 bob@t#c pwd = x1") == "at <host> <account> pwd=<redacted>"
    assert one(spark, T.path_label(F.split("s", ",")), s="a,b,c,d,e") == "a > … > d > e"
    assert one(spark, T.sse_events(c), s='data: {"a":\ndata: 1}\r\n\r\n: x\n\ndata: b\n\n') == ['{"a":\n1}', "b"]
    assert one(spark, T.display(80, c, F.lit("y")), s=" null ") == "y" and one(spark, T.first_present(c, F.lit(3)), s="") == "3"
    assert one(spark, T.thousands(F.col("n")), n=1234567) == "1,234,567" and one(spark, T.percent(F.col("n")), n=0.256) == "25.6%" and one(spark, T.thousands(F.col("n")), n=float("nan")) == "—"


def test_number_functions(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, N.pct(a, b), a=1, b=3) == 33.33 and one(spark, N.pct(a, b), a=1, b=0) is None and one(spark, N.pct(a, b), a=1, b=800) == 0.12
    assert [one(spark, N.lenient_int(F.col("s")), s=x) for x in ("12.9", "-3.5", "x", "nan", "inf", "1e3")] == [12, -3, None, None, None, 1000]
    assert one(spark, N.nearest_rank(F.array(*[F.lit(x) for x in (4, 1, 3, 2)]), 0.5)) == 3 and one(spark, N.nearest_rank(F.array().cast("array<int>"), 0.5)) is None
    assert one(spark, N.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, N.ms_to_us(F.col("s")), s="") == 0 and one(spark, N.elapsed_us(F.lit(None).cast("double"), F.lit(7.0), F.lit(1.0))) == 7
    assert one(spark, N.window_start(F.expr("timestamp'2024-01-01 00:10:00'")).cast("string")) == "2023-12-31 23:40:00"


def corpus(spark, **texts):
    return spark.createDataFrame([(f"{k}.md", v) for k, v in texts.items()], "path string, text string")


def test_index_life(spark, tmp_path):
    store = I.Store(spark, str(tmp_path / "index"))
    with pytest.raises(IndexMissing):
        store.read()
    assert store.health() == {"ok": False, "reason": "index_missing"}

    def build(embed=hashed_vectors(8), mode="incremental", model="m", **texts):
        files = corpus(spark, **texts)
        return I.build(store, files, C.payloads(files), embed, mode, model)

    first = build(a="## S\nx\n## T\ny", b="## S\nz", index="# nav")
    assert first.counts | {"files": 0} == {"files": 0, "chunks": 4, "doc_rows": 3, "nav_rows": 1, "truncated": 0, "skipped": 0, "rewritten": 0, "embedded": 3, "pruned": 0}
    assert build(a="## S\nx\n## T\ny", b="## S\nz", index="# nav").skipped_all
    second = build(a="## S\nx\n## T\nchanged", c="## S\nnew", index="# nav")
    assert {k: second.counts[k] for k in ("skipped", "embedded", "pruned", "chunks")} == {"skipped": 2, "embedded": 2, "pruned": 1, "chunks": 4}
    assert store.live() == "v00000002" and store.read().where("kind = 'doc' and vector is null").count() == 0 and store.health()["rows"] == 4
    with pytest.raises(IndexMismatch):
        build(model="other", a="## S\nx")
    assert build(model="other", mode="rebuild-vectors", a="## S\nx").counts["embedded"] == 1
    assert build(embed=None, model="", mode="rebuild", a="## S\nx").counts["embedded"] == 0 and store.read().where("vector is not null").count() == 0
    store.check({"schema_version": "2", "unknown": "x"})
    with pytest.raises(IndexMismatch):
        store.check({"schema_version": "1"})
    with pytest.raises(ValueError):
        build(mode="?", a="x")


def test_rewrite_keeps_vector(spark):
    new = spark.createDataFrame([(1, "a" * 16 + "b" * 16, "doc")], "pk bigint, content_hash string, kind string")
    old = spark.createDataFrame([(1, "a" * 16 + "c" * 16, [1.0])], "pk bigint, content_hash string, vector array<float>")
    r = I.with_vectors(I.classified(new, old), old).first()
    assert (r.status, r.vector, r.embed) == ("rewrite", [1.0], False)


def test_fingerprint_of_many_files(spark):
    """The sum of 48-bit hashes outgrows 64 bits at some 65,000 files."""
    import hashlib

    from tidewell.operators import index

    n = 100_000
    files = spark.range(n).selectExpr("cast(id as string) as path", "concat('t', id) as text")
    total = sum(int(hashlib.sha256(f"{i}#t{i}".encode()).hexdigest()[:12], 16) for i in range(n))
    row = index.fingerprint(files).first()
    assert total > 2**63 and row.fingerprint == f"{n}:{row.bytes}:{total}"
    assert index.fingerprint(files.where("false")).first().fingerprint == "0:0:0"
