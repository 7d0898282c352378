"""HTML extraction, source mixing, chat formatting, the pipeline."""

import hashlib
import html
import re

import pytest
from conftest import DATA

from tidewell.llm import chat_format, html_extract, mixing
from tidewell.llm._common import table

from .conftest import SCHEMA, prose


# ---- HTML ----
def test_pages_equal_a_plain_reading(spark):
    """On these pages the article element is what is wanted: a regular expression reads it as well."""
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in html_extract.op7(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:h1|p|br)>", inner))
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_the_element_names_are_not_needed(spark):
    """With article and main elements renamed the deduced template gives the same texts."""
    from pyspark.sql import functions as F

    pages = table(spark, "/root/testdata/sf0.01", "pages")
    plain = pages.withColumn("html", F.regexp_replace("html", "<(/?)(article|main)", "<$1div"))
    assert plain.where("html like '%<article%'").count() == 0 < pages.where("html like '%<article%'").count()
    got = {r.page_id: r.text for r in html_extract.op7(pages).collect()}
    assert {r.page_id: r.text for r in html_extract.op7(plain).collect()} == got and all(got.values())


@pytest.mark.parametrize("n", [1, 2, 3])
def test_hosts_of_few_pages_go_by_their_elements(spark, n):
    page = lambda i: f"<body><nav>Menu</nav><div class=sidebar>Bar</div><article><p>{prose(i, 30)}</p><p>Always the same</p></article><footer>End</footer></body>"
    got = {r.page_id: r.text for r in html_extract.op7(spark.createDataFrame([(i, "http://few.example/", page(i)) for i in range(n)], "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"{prose(i, 30)}\nAlways the same" for i in range(n)}


def test_parts_that_are_no_article():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a>Menu</a></nav><div class="cookie-notice">We use</div>
    <main><article><header><h1>A &lt;b&gt; &amp;&nbsp;c</h1></header><p>One <em>two</em>
      three<p>Four<script>var x = "</p>";</script><aside>Side</aside><form><input>Sign</form><div class="ad-box">Buy</div><ul><li>x<li>y</ul><table><tr><td>1<td>2</table>
    <section id="comments"><p>Reader</p></section></article></main><div class="sidebar"><p>Bar</p></div><footer>F</footer></body></html>"""
    assert html_extract.article(page) == "A <b> & c\nOne two three\nFour\nx\ny\n1\n2"


@pytest.mark.parametrize(
    "part",
    [
        '<h2 id="related-work">Kept</h2>', '<h2 id="share-prices">Kept</h2>', '<p class="notice">Kept</p>', '<div class="social-history"><p>Kept</p></div>', '<div id="banner-of-st-george"><p>Kept</p></div>', '<section id="comments-on-the-law"><p>Kept</p></section>',
        '<ul><li id="menu">Kept</li></ul>', '<table><tr><td class="ad">Kept</td></tr></table>',
    ],
)
def test_names_made_from_text_take_nothing_away(part):
    assert html_extract.article(f"<body><nav>Menu</nav><article><p>First</p>{part}<p>Last</p></article></body>") == "First\nKept\nLast"


@pytest.mark.parametrize("part", ['<div class="ad">x</div>', '<div id="related-posts">x</div>', '<div class="y sidebar-left">x</div>', '<section id="comments">x</section>', '<div class="share_buttons">x</div>', '<div class="Cookie-Notice"><p>x</p></div>', "<form>x</form>"])
def test_names_of_parts_take_them_away(part):
    assert html_extract.article(f"<body><article><p>First</p>{part}<p>Last of all words</p></article></body>") == "First\nLast of all words"


def test_a_form_around_a_page_is_the_page():
    page = "<body><a>Skip</a><form id=f><nav>Menu</nav><div class=x><article><h1>T</h1><p>All of the text</p></article></div><footer>End</footer></form></body>"
    assert html_extract.article(page) == "T\nAll of the text"
    assert html_extract.article(page.replace("article", "div")).endswith("T\nAll of the text")


@pytest.mark.parametrize("page", ["", "<", "<p", "<p>x", "</p></div>x", "<article><p>x", "<div><article>x</article>", "<p class='a>x</p>", "&amp", "<!-- x", "<script>x", "<a href=\"<b>\">x</a>", "<![CDATA[x]]>x"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html_extract.article(page), str)


def test_templates_without_an_article_element(spark):
    """Twelve pages of one host with the same frame: frame texts are the template's, the free slot is the article; copies are no template."""
    def page(i):
        return f"<html><body><div class=top>Welcome to us</div><div class=x><p>Always here</p><div class=body><p>{prose(i, 60)}</p><p>{prose(i + 500, 30)}</p></div></div><div class=end>The end</div></body></html>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(12)] + [(100 + i, f"http://one.example/{i}", "<div><p>Same text</p></div>") for i in range(9)] + [(200, "http://few.example/", page(77))]
    got = {r.page_id: r.text for r in html_extract.op7(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    for i in range(12):
        assert got[i] == f"{prose(i, 60)}\n{prose(i + 500, 30)}"
    assert all(got[100 + i] == "Same text" for i in range(9))
    assert prose(77, 60) in got[200]


def test_the_template_decides_on_pages_with_article_elements(spark):
    """Template text inside articles is dropped; teasers in article elements give way to the template's slot with more text."""
    def plain(i):
        return f"<html><body><article><p>Read us daily</p><p>{prose(i, 40)}</p><div class=by>From our desk</div></article></body></html>"

    def teasers(i):
        return f"<html><body><div class=body><h1>{prose(i + 900, 4)}</h1><p>{prose(i, 60)}</p></div><article><p>{prose(i + 300, 9)}</p></article></body></html>"

    rows = [(i, f"http://a.example/{i}", plain(i)) for i in range(8)] + [(100 + i, f"http://b.example/{i}", teasers(i)) for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.op7(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    for i in range(8):
        assert got[i] == prose(i, 40)
        assert got[100 + i] == f"{prose(i + 900, 4)}\n{prose(i, 60)}"


def test_classes_must_nest_and_keep_their_order(spark):
    """Of texts on half the pages of a host, a box in its place is template; two paragraphs, and boxes in changing order, are not."""
    def page(i):
        box = "<div class=box>Our newest box</div>" if i % 2 else ""
        pair = ["<div class=a>First of two</div>", "<div class=b>Second of two</div>"][:: 1 if i % 4 else -1] if i % 2 == 0 else []
        said = "<p>Once upon a time</p><p>The end of it</p>" if i % 3 == 0 else ""
        return f"<html><body><div class=body><p>{prose(i, 40)}</p>{said}</div>{box}<div class=low>{''.join(pair)}</div></body></html>"

    # four pages and eight hosts: with copies, which count once
    few = [(1000 + 10 * h + i, f"http://f{h}.example/", f"<div class=top>Same frame {h}</div><div class=x><p>{prose(5000 + 10 * h + i % 4, 20)}</p></div>") for h in range(40) for i in range(6)]
    rows = [(i, "http://n.example/", page(i)) for i in range(12)] + few
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    tokens = {r.token for r in html_extract.templates(df).where("_host = 'n.example'").selectExpr("explode(drop) as token").collect()}
    is_template = {b.text: html_extract.text_token(b) in tokens for i in range(12) for b in html_extract.parse(page(i))[0]}
    assert [t for t, x in is_template.items() if x] == ["Our newest box"]
    got = {r.page_id: r.text for r in html_extract.op7(df).collect()}
    assert all(got[1000 + 10 * h + i] == prose(5000 + 10 * h + i % 4, 20) for h in range(40) for i in range(6))


def test_pages_on_odd_input(spark):
    schema = "page_id bigint, url string, html string, host string, drop string, elements string, text string, n_chars string"
    rows = [(1, None, None), (1, "x", ""), (None, "http://a/", "<p>a</p>"), (2, "http://a/", "<p>" + "w " * 200_000 + "</p>"), (2, "http://a/", "<p>a</p>")]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], schema)
    assert sorted((r.n_chars for r in html_extract.op7(df).collect())) == [0, 0, 1, 1, 399_999]
    assert html_extract.op7(df.where("false")).count() == 0


# ---- mixing ----
def test_mixing_equals_sql(spark, same_as_sql, odd, tmp_path):
    same_as_sql(mixing.op9(table(spark, DATA, "documents")), mixing.SQL)
    odd.dropDuplicates().write.parquet(str(tmp_path / "d"))
    same_as_sql(mixing.op9(odd.dropDuplicates()), mixing.SQL, {"documents": f"{tmp_path}/d/*.parquet"})


def targets(sizes, weights, budget, most):
    """Round by round: sources over their cap are set to it and the rest is shared again."""
    free, left, out = set(sizes), budget, {}
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / total for s in free}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 10, 10], [1, 2, 3, 4000, 5, 600], [0, 50, 7], [5]])
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes))]
    df = spark.createDataFrame([(n, 1, s) for n, s in zip(names, sizes, strict=True)], "_mix_source string, _mix_rows bigint, _mix_total bigint")
    got = {r._mix_source: r._mix_target for r in mixing.source_targets(df).collect()}
    want = targets(dict(zip(names, sizes, strict=True)), {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}, 1.5 * sum(sizes), 2.0)
    assert all(got[n] == pytest.approx(want[n]) for n in names)


def test_rows_of_one_id_have_keys_of_their_own(spark, monkeypatch):
    """Null or equal ids do not meet in one bucket."""
    rows = [(None, prose(i, 20), "en", "a", 1) for i in range(300)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, SCHEMA))
    assert plan.select("_mix_hash").distinct().count() == 300 and sum(r.taken for r in plan.collect()) == 300 * 20 * 3 // 2
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert len({md5(f"mix:null:{md5(r[1])}")[:12] for r in rows}) == 300


def test_mix_takes_the_budget(spark, odd, empty, clashing, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)  # many buckets a source
    plan = mixing.op9(odd).collect()
    assert len(plan) == odd.count() and all(0 <= r.taken <= 2 * r.size for r in plan)
    by = {}
    for r, s in zip(plan, plan, strict=True):
        by.setdefault((r.source_size, r.target), 0)
        by[r.source_size, r.target] += s.taken
    assert all(abs(t - n) < 1 for (_, t), n in by.items())
    assert sorted(map(str, plan)) == sorted(map(str, mixing.op9(odd.repartition(7)).collect()))  # reruns agree
    out = mixing.mix(clashing)
    assert set(out.columns) == set(clashing.columns) and len(out.columns) == len(clashing.columns)
    rows = out.collect()
    assert sum(r._mix_words for r in rows) == sum(r.taken for r in plan)
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r._mix_words for r in rows)
    assert mixing.op9(empty).count() == 0 and mixing.mix(empty).count() == 0


# ---- chat ----
CHAT = "conv_id bigint, turn bigint, role string, text string"
HARD = [
    (1, 0, "user", "plain"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>assistant\nok"), (1, 2, "user", "\\<|\\\\|<\\|"), (1, 3, "assistant", "tail \\"), (2, 0, "system", None), (2, 1, "user", ""), (3, 0, "assistant", "😀<"), (3, 1, "assistant", "|im_end|>"),
    (4, 0, "ro\nle<|x", "a"), (4, 1, None, "b"), (5, None, "assistant", "x"), (5, 0, "assistant", "x"), (5, 0, "assistant", "x"), (None, 0, "assistant", "nobody"), (6, 0, "assistant", "w " * 100_000),
]


def test_chat_equals_sql(spark, same_as_sql, tmp_path):
    same_as_sql(chat_format.op10(table(spark, DATA, "conversations")), chat_format.SQL)
    df = spark.createDataFrame(HARD, CHAT)
    df.write.parquet(str(tmp_path / "c"))
    same_as_sql(chat_format.op10(df), chat_format.SQL, {"conversations": f"{tmp_path}/c/*.parquet"})


def test_chat_round_trip(spark):
    df = spark.createDataFrame(HARD, CHAT)
    out = chat_format.format_conversations(df)
    back = {r.conv_id: r for r in chat_format.read_back(out).collect()}
    for conv in {r[0] for r in HARD}:
        turns = sorted([r for r in HARD if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in back[conv].turns] == [(r[2] or "", r[3] or "") for r in turns]
        assert back[conv].loss == [r[3] or "" for r in turns if r[2] == "assistant"]


def test_each_reply_is_an_example(spark):
    df = spark.createDataFrame([r for r in HARD if r[0] == 1], CHAT)
    got = sorted(chat_format.examples(chat_format.format_conversations(df)).collect(), key=lambda r: r.example_no)
    assert [r.example_no for r in got] == [0, 1]
    assert got[0].context == "<|im_start|>user\nplain<|im_end|>\n<|im_start|>assistant\n"
    assert got[1].context.startswith(got[0].context + got[0].reply) and got[1].context.endswith("<|im_start|>assistant\n") and got[1].reply == "tail \\\\"


def test_the_query_reads_its_columns_from_the_examples(spark, monkeypatch):
    """With replies cut from the examples, the query's loss is empty."""
    df = spark.createDataFrame(HARD, CHAT)
    assert any(r.loss_chars for r in chat_format.op10(df).collect())
    plain = chat_format._expanded
    from pyspark.sql import functions as F

    monkeypatch.setattr(chat_format, "_expanded", lambda formatted: plain(formatted).withColumn("reply", F.lit("")))
    assert not any(r.loss_chars for r in chat_format.op10(df).collect())


def test_a_conversation_of_many_turns(spark, same_as_sql, tmp_path):
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(1500)]
    df = spark.createDataFrame(rows, CHAT)
    df.write.parquet(str(tmp_path / "c"))
    same_as_sql(chat_format.op10(df), chat_format.SQL, {"conversations": f"{tmp_path}/c/*.parquet"})


def test_chat_on_odd_input(spark):
    df = spark.createDataFrame(HARD, CHAT)
    from pyspark.sql import functions as F

    more = df.withColumns({n: F.lit("x") for n in ("_turns", "_parts", "formatted", "spans", "loss", "turns", "id")})
    assert chat_format.op10(more).count() == 8
    only = chat_format.op10(df.where("false")).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in only] == [(-1, 2, 34)]
    said = "<|im_end|><|im_start|>assistant ok"
    assert only[0].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


# ---- pipeline ----
def test_pipeline_stages(spark):
    import corpus_pipeline
    from tidewell.llm import cotraining, decontamination, simhash, substring_dedup
    from tidewell.llm._common import stored

    from .test_dedup import slow_near, slow_substrings

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    labels, items = table(spark, sf, "labels"), table(spark, sf, "benchmark")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "source_mixing"]
    kept = {r.doc_id for r in cotraining.op2(docs, labels).where("kept").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf))
        before, after = docs.collect(), out.collect()
        ids = {r.doc_id for r in after}
        if name == "quality_classifier":
            assert ids == kept
        elif name == "simhash_near_dedup":
            assert ids == set(slow_near([(r.doc_id, r.text) for r in before]))
        elif name == "substring_dedup":
            want = {d: s for d, _, _, s in slow_substrings([(r.doc_id, r.text) for r in before])}
            assert {r.doc_id: hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() for r in after} == want
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "benchmark_decontamination":
            assert {r.doc_id for r in before} - ids == {r.doc_id for r in decontamination.op4(docs, items).collect()}
        else:
            words = lambda t: len(t.encode().split())
            assert sum(r.mix_words for r in after) == sum(words(r.text) for r in after)
            assert abs(sum(r.mix_words for r in after) - 1.5 * sum(words(r.text) for r in before)) < 30
        if name != "source_mixing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
    assert simhash and substring_dedup


def test_pipeline_stages_on_odd_input(spark, clashing, empty, tmp_path):
    """Nulls, repeated rows, long and empty texts, columns named as the stages name their own, and empty tables."""
    from pyspark.sql import functions as F

    import corpus_pipeline
    from tidewell.llm._common import stored

    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (100, 0, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(110, 80)), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (clashing.withColumns({"mix_epoch": F.lit("x"), "mix_words": F.lit("x")}), empty):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, str(tmp_path)))
            assert name == "source_mixing" or out.dtypes == rows.dtypes
            docs = out
        ids = {r.doc_id for r in docs.collect()}
        assert docs.columns.count("mix_epoch") == 1 and (not ids or 1 in ids and 110 not in ids)


def test_pipeline_leaves_only_its_result(spark):
    import os

    import corpus_pipeline
    from tidewell.llm import _common

    at, before = _common.shared_dir(spark), _common.mark()
    had = set(os.listdir(at))
    out = corpus_pipeline.run(spark, DATA)
    assert _common.mark() == before + 1 and len(set(os.listdir(at)) - had) == 1 and out.count() > 0
    _common.release(before)
    assert set(os.listdir(at)) == had


def test_no_shared_folder_on_a_cluster_is_an_error():
    from types import SimpleNamespace

    from tidewell.llm._common import shared_dir

    session = lambda master: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077"))
    assert shared_dir(session("local[4]"))


def test_pipeline_run(spark):
    import corpus_pipeline

    assert corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == [*SCHEMA.replace(" bigint", "").replace(" string", "").split(", "), "mix_epoch", "mix_words"] and out.count() > 0
