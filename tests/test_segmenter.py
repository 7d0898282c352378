"""Words without spaces: the lattice against all ways to cut, the vocabulary, and search with either tokeniser."""

import itertools
import math
import random

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import postings
from tidewell.operators import retrieval as R
from tidewell.operators import segmenter as S

WORDS = ["数据库", "租户", "备份", "恢复", "执行计划", "缓存", "索引", "分区", "磁盘", "空间", "资源", "隔离", "事务", "日志", "节点", "锁"]


def test_the_lattice_finds_the_best_way_to_cut():
    r = random.Random(1)
    for _ in range(300):
        run = "".join(r.choice("甲乙丙丁") for _ in range(r.randint(1, 9)))
        cost = {run[a:b]: r.choice([0.5, 1.0, 2.5, 4.0]) for a, b in itertools.combinations(range(len(run) + 1), 2) if b - a <= 4 and r.random() < 0.6}
        whole = lambda words, cost=cost: sum(cost.get(w, 5.0 if len(w) == 1 else math.inf) for w in words)
        every = [[run[a:b] for a, b in itertools.pairwise((0, *cuts, len(run)))] for k in range(len(run)) for cuts in itertools.combinations(range(1, len(run)), k)]
        got = S.cut(run, cost, 5.0)
        assert "".join(got) == run and abs(whole(got) - min(map(whole, every))) < 1e-9
    assert S.cut("", {}, 1.0) == []


def test_a_vocabulary_from_the_corpus(spark):
    """Sentences made of words: the words are found, and cuts are theirs."""
    r = random.Random(2)
    truth = [[r.choice(WORDS) for _ in range(r.randint(2, 7))] for _ in range(600)]
    texts = spark.createDataFrame([("，".join(("".join(s), "X1 text")),) for s in truth] + [(None,), ("plain",)], "text string").repartition(3)
    grams = {r_.gram: r_ for r_ in S.ngrams(texts).where("gram in ('数据库', '数据', '据库')").collect()}
    assert grams["数据库"].n == sum(s.count("数据库") for s in truth) and grams["数据"].right < 1e-9 < 1 < grams["数据"].left and grams["据库"].left < 1e-9
    one = S.Segmenter.counted(texts)
    assert {w for w in WORDS if len(w) > 1} <= one.cost.keys() and "数据" not in one.cost
    cuts = [(S.cut("".join(s), one.cost, one.unknown), s) for s in truth]
    right = sum(len({*itertools.accumulate(map(len, a))} & {*itertools.accumulate(map(len, b))}) for a, b in cuts)
    assert right / sum(len(b) for _, b in cuts) > 0.95 and right / sum(len(a) for a, _ in cuts) > 0.9
    got = spark.range(1).select(one.tokens(F.lit("数据库备份 Lock锁4.2")).alias("t"), one.tokens(F.lit("no such")).alias("p"), one.tokens(F.lit(None).cast("string")).alias("n")).first()
    assert got.t == ["数据库", "备份", "lock", "锁", "4", "2"] and got.p == ["no", "such"] and got.n == []


def test_search_by_words_and_by_pairs(spark, tmp_path):
    """A question whose pairs of characters stand across words of another page: pairs find that page too, words do not."""
    r = random.Random(3)
    pages = [(k, "".join(r.choice(WORDS) for _ in range(40))) for k in range(60)]
    special = [(100, "库备、份恢、复执、" * 3), (101, "数据库备份恢复执行计划")]
    chunks = spark.createDataFrame(pages + special, "pk bigint, text string")
    one = S.Segmenter.counted(chunks.where("pk < 100"))
    q = spark.createDataFrame([(0, "数据库备份恢复执行计划")], "query_id bigint, query string")
    postings.build(chunks, str(tmp_path / "w"), tokens=one.tokens)
    postings.build(chunks, str(tmp_path / "p"))
    words = postings.Stored(spark, str(tmp_path / "w"), tokens=one.tokens).search(q, 62).collect()
    pairs = postings.Stored(spark, str(tmp_path / "p")).search(q, 62).collect()
    assert {100, 101} & {x.pk for x in words} == {101} and {100, 101} <= {x.pk for x in pairs}
    assert sorted(x.pk for x in R.sparse_route(chunks, q, 62).collect()) == sorted(x.pk for x in pairs) and T.plain_tokens is not None
