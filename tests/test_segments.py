"""The segmented index and its postings with block maxima: equal to an index built at once, whatever the edits."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import index as I
from tidewell.operators import postings, segments
from tidewell.operators import retrieval as R
from tidewell.operators.errors import IndexMissing, VersionConflict

WORDS = [f"w{i}" for i in range(60)]


def page(r, n=None):
    return " ".join(r.choices(WORDS, [1 / (k + 1) for k in range(60)], k=n if n is not None else r.choice([0, 3, 8, 20, 80, 300])))


def rows_of(spark, state):
    return spark.createDataFrame([(k, f"h{hash(t)}", t, "nav" if k % 9 == 4 else "doc", f"p{k % 7}.md", "s", "t", "", "MySQL" if k % 2 else "", "", None) for k, t in state.items()], segments.COLUMNS)


def questions(spark):
    return spark.createDataFrame([(1, "w0 w1 w2"), (2, "w55 w3"), (3, "none at all"), (4, "w40"), (5, "w7 w8 w9 w10 w59"), (6, "")], "query_id bigint, query string")


def same_as_rebuilt(spark, store, state, q):
    """Rows, counts and the best of every query are those of the rows alone."""
    assert {r.pk: r.text for r in store.read().collect()} == state
    plain = rows_of(spark, state).select("pk", "text")
    found = store.postings()
    stats = R.bm25_stats(R.tokenise(plain))
    assert found.stats.n == stats.n and found.stats.mean_length == pytest.approx(stats.mean_length, abs=1e-12)
    want = sorted(R.sparse_route(plain, q).collect())
    assert sorted(R.ranked(found.scores(q)).collect()) == want
    assert sorted(found.search(q, 5).collect()) == [r for r in want if r.rank <= 5]


def test_edits_equal_a_rebuild(spark, tmp_path, monkeypatch):
    """Upserts, deletions, pages that come back, merges of segments, and at last a rewrite."""
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 3)
    monkeypatch.setattr(segments, "LEAST_ROWS", 0)
    r = random.Random(1)
    state = {k: page(r) for k in range(200)}
    store = segments.Store(spark, str(tmp_path / "i"))
    with pytest.raises(IndexMissing):
        store.read()
    store.publish(rows_of(spark, state), {"a": 1})
    q = questions(spark)
    for step in range(5):
        new = {k: page(r) for k in r.sample(range(260), 8)}
        gone = r.sample(sorted(state), 5) + [9999]
        gone = [k for k in gone if k not in new]
        store.apply(rows_of(spark, new), spark.createDataFrame([(k,) for k in gone], "pk bigint"), {"step": step})
        state = {k: t for k, t in state.items() if k not in gone} | new
        if step in (1, 4):
            same_as_rebuilt(spark, store, state, q)
    how = [store.manifest(n).how for n in store.versions()]
    assert "merge" in how and how.count("delta") == 5 and store.meta() == {"a": "1", "step": "4"}
    store.apply(rows_of(spark, {k: page(r) for k in range(1000, 1120)}), spark.createDataFrame([], "pk bigint"))
    assert store.manifest().how == "rewrite" and len(store.manifest().segments) == 1 and store.read().count() == len(state) + 120


def test_an_edit_writes_what_changed(spark, tmp_path):
    r = random.Random(2)
    state = {k: page(r, 300) for k in range(3000)}
    store = segments.Store(spark, str(tmp_path / "i"))
    store.publish(rows_of(spark, state), {})
    whole = store.manifest().wrote
    store.apply(rows_of(spark, {k: page(r, 300) for k in range(30)}), spark.createDataFrame([], "pk bigint"))
    assert store.manifest().how == "delta" and store.manifest().wrote < 0.04 * whole


def test_readers_keep_what_they_opened(spark, tmp_path):
    store = segments.Store(spark, str(tmp_path / "i"))
    state = {1: "w1 w2", 2: "w2"} | {k: "w8" for k in range(20, 40)}
    store.publish(rows_of(spark, state), {})
    rows, found = store.read(), store.postings()
    store.apply(rows_of(spark, {1: "w9", 3: "w1"}), spark.createDataFrame([(2,)], "pk bigint"))
    store.publish(rows_of(spark, {7: "w7"}), {})
    assert store.vacuum(keep=3) == 0
    q = spark.createDataFrame([(0, "w2")], "query_id bigint, query string")
    assert {x.pk for x in rows.collect()} == {*state} and {x.pk for x in found.search(q).collect()} == {1, 2}
    # an earlier version, published again; then what only it does not name goes
    store.rollback(1)
    assert {x.pk for x in store.read().collect()} == {*state} and {x.pk for x in store.postings().search(q).collect()} == {1, 2} and store.live() == "v00000004"
    assert store.vacuum(keep=1) == 3 and {x.pk for x in store.read().collect()} == {*state} and store.versions() == [4]
    with pytest.raises(IndexMissing):
        store.rollback(2)
    with pytest.raises(IndexMissing):
        store.read(2)


def test_one_of_two_writers_begins_anew(spark, tmp_path):
    """Both began from version 1; the second finds version 2 taken and leaves nothing."""
    one, two = (segments.Store(spark, str(tmp_path / "i")) for _ in range(2))
    one.publish(rows_of(spark, {1: "w1"}), {})
    begun = two.manifest()
    one.apply(rows_of(spark, {2: "w2"}), spark.createDataFrame([], "pk bigint"))
    two.manifest = lambda number=None: begun  # as if read before the other's publication
    with pytest.raises(VersionConflict):
        two.apply(rows_of(spark, {3: "w3"}), spark.createDataFrame([], "pk bigint"))
    assert {x.pk for x in one.read().collect()} == {1, 2} and one.versions() == [1, 2]
    assert not [f for f in (tmp_path / "i" / "manifests").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_an_empty_index(spark, tmp_path):
    store = segments.Store(spark, str(tmp_path / "i"))
    store.publish(rows_of(spark, {1: "w1"}).where("false"), {})
    assert store.read().count() == 0 and store.postings().search(questions(spark)).count() == 0
    store.apply(rows_of(spark, {1: "w1 w1"}), spark.createDataFrame([], "pk bigint"))
    assert [x.pk for x in store.postings().search(questions(spark)).collect()] == [1]
    store.apply(rows_of(spark, {1: "w1"}).where("false"), spark.createDataFrame([(1,)], "pk bigint"))
    assert store.read().count() == 0 and store.postings().search(questions(spark)).count() == 0 and store.health()["rows"] == 0


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Few chunks hold the rare words often: most windows cannot reach the best."""
    r = random.Random(3)
    texts = [(k, " ".join(r.choices(WORDS[:20], k=r.randint(5, 40))) + (" w50" * r.choice([1, 6, 9]) if k % 97 == 0 else "") + (" w51" if k % 5 == 0 else "")) for k in range(6000)]
    chunks = spark.createDataFrame([*texts, (6000, None), (6001, "")], "pk bigint, text string").cache()
    at = str(tmp_path_factory.mktemp("skewed") / "p")
    postings.build(chunks, at, buckets=3)
    return chunks, at


@pytest.mark.parametrize("held", [True, False])
def test_blocks_that_cannot_reach_are_not_read(spark, skewed, monkeypatch, held):
    chunks, at = skewed
    if not held:
        monkeypatch.setattr(postings, "HEADS", 0)
    q = spark.createDataFrame([("a", "w50 w51"), ("b", "w3 w50"), ("c", "w1 w2")], "query_id string, query string")
    reads, want = [], sorted(R.sparse_route(chunks, q).collect())
    for k in (1, 10, 50):
        index = postings.Stored(spark, at)
        assert sorted(index.search(q, k).collect()) == [r for r in want if r.rank <= k]
        reads.append(index.reads)
    assert reads[0].read < reads[1].read < reads[2].read <= reads[0].postings and reads[0].read < 0.6 * reads[0].postings
    assert postings.Stored(spark, at).search(q, None).count() == R.sparse_route(chunks, q, 10**9).count()


def test_plans_select_buckets_terms_and_windows(spark, skewed):
    index = postings.Stored(spark, skewed[1])
    plan = index._blocks(["w1"], windows={0: [3]})._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,w1)" in plan and "EqualTo(window,3)" in plan
    heads = index._blocks(["w1"], postings.HEAD)._jdf.queryExecution().toString()
    assert "pks" not in heads.split("ReadSchema:")[1]


def test_a_build_goes_on_from_the_live_version(spark, tmp_path):
    """Only what changed is written; settings move with the version; vectors that are dropped are written out."""
    from tidewell.operators import chunks as C
    from tidewell.sources.remote import hashed_vectors

    store = I.Store(spark, str(tmp_path / "i"))

    def build(texts, embed=hashed_vectors(4), mode="incremental", model="m"):
        files = spark.createDataFrame(sorted(texts.items()), "path string, text string")
        return I.build(store, files, C.payloads(files), embed, mode, model)

    texts = {f"{k}.md": f"## S\nword{k} text" for k in range(40)}
    build(texts)
    build(texts | {"3.md": "## S\nother"})
    m = store.manifest()
    assert m.how == "delta" and m.segments[-1]["rows"] == 1 and store.read().where("vector is null").count() == 0
    q = spark.createDataFrame([(0, "other word3 text")], "query_id bigint, query string")
    assert sorted(store.postings().search(q).collect()) == sorted(R.sparse_route(store.read(), q).collect())
    build(texts, None, model="")
    assert store.manifest().how == "full" and store.meta()["embedding_model"] == ""
    assert len(store.versions()) <= I.VERSIONS


def test_many_questions_meet_windows_where_their_postings_are(spark, tmp_path, monkeypatch):
    """Blocks made a few rows at a time, and searched for many questions at once, give the lists of the full sum; no pairs of a question and a row are shuffled."""
    chunks = spark.createDataFrame([(k, " ".join(f"w{(k * j) % (5 + j)}" for j in range(k % 19))) for k in range(500)], "pk bigint, text string")
    queries = spark.createDataFrame([(q, f"w{q} w{q * 3 % 11} w1") for q in range(12)], "query_id bigint, query string")
    monkeypatch.setattr(postings, "ROWS_CUT", 70)
    monkeypatch.setattr(postings, "HEADS", 0)
    postings.build(chunks, str(tmp_path / "p"), buckets=2)
    out = postings.search(spark, str(tmp_path / "p"), queries, 4)
    assert sorted(out.collect()) == sorted(R.ranked(R.sparse_scores(chunks, queries), 4).collect())
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_an_index_is_written_in_one_pass(spark, tmp_path, monkeypatch):
    """Neither counts nor postings are written or shuffled on the way to the index."""
    copies = []
    monkeypatch.setattr(postings, "written", lambda df, name, f=postings.written: copies.append(name) or f(df, name))
    monkeypatch.setattr(postings, "PART_BYTES", 2000)
    r = random.Random(4)
    chunks = rows_of(spark, {k: page(r) for k in range(300)}).select("pk", "text")
    postings.build(chunks, str(tmp_path / "p"), buckets=3)
    assert copies == []
    want = sorted(R.ranked(R.sparse_scores(chunks, questions(spark)), 5).collect())
    for heads in (postings.HEADS, 0):
        monkeypatch.setattr(postings, "HEADS", heads)
        assert sorted(postings.search(spark, str(tmp_path / "p"), questions(spark), 5).collect()) == want


def test_rows_of_a_segment_are_written_once(spark, tmp_path, monkeypatch):
    """Rows and lists are those of a rebuild, and no texts or postings are shuffled for the keys that were replaced, unless these are very many."""
    copies = []
    monkeypatch.setattr(segments, "written", lambda df, name, f=segments.written: copies.append(name) or f(df, name))
    monkeypatch.setattr(R, "QUERY_TERMS", 20)
    r = random.Random(5)
    state = {k: page(r) for k in range(300)}
    store = segments.Store(spark, str(tmp_path / "i"))
    store.publish(rows_of(spark, state), {})
    assert copies == []
    new = {k: page(r) for k in r.sample(range(320), 40)}
    store.apply(rows_of(spark, new), spark.createDataFrame([(7,)], "pk bigint"))
    state = {k: t for k, t in state.items() if k != 7} | new
    monkeypatch.setattr(R, "QUERY_TERMS", 200_000)
    want = sorted(R.ranked(R.sparse_scores(rows_of(spark, state).select("pk", "text"), questions(spark)), 5).collect())
    monkeypatch.setattr(R, "QUERY_TERMS", 20)
    monkeypatch.setattr(segments.F, "broadcast", lambda df, f=F.broadcast: copies.append("sent") or f(df))
    copies.clear()
    store.read()
    assert copies == ["sent"]
    for heads, dead in ((postings.HEADS, postings.SENT_DEAD), (0, postings.SENT_DEAD), (0, 0)):
        monkeypatch.setattr(postings, "HEADS", heads)
        monkeypatch.setattr(postings, "SENT_DEAD", dead)
        assert sorted(store.postings().search(questions(spark), 5).collect()) == want
        assert {x.pk: x.text for x in store.read().collect()} == state
