"""Words of scripts without spaces, by a vocabulary counted from the corpus.

In every run of Han or Kana, n-grams of up to ``LONGEST`` characters are counted, with the entropies of the characters before and after each: a
word is an n-gram that is found ``LEAST_COUNT`` times or more, is followed and preceded by many different characters (or by ends of runs), as
parts of words are not, and, cut anywhere, is found ``LEAST_COHESION`` times as often as its parts would meet by chance, as pairs of words are not.  A run is then cut into the words whose product of shares is greatest (a unigram lattice, searched by Viterbi); a character that is no
word of its own costs as much as one found once.

Counting is a DataFrame aggregation with map-side sums; cutting is an Arrow function with the vocabulary sent to the executors, whose size is checked."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNSPACED, plain_tokens
from ..sources.scratch import written

LONGEST, LEAST_COUNT, LEAST_ENTROPY, LEAST_COHESION = 4, 3, 0.6, 8.0
#: Words that are sent to executors: about 30 MB.  A corpus with more raises ``LEAST_COUNT``.
MOST_WORDS = 500_000


def ngrams(texts: DataFrame) -> DataFrame:
    """``texts``: text.  gram, n, left and right (entropies in nats, ends of runs counted as different characters each)."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"[{UNSPACED}]+"), F.lit(0))).alias("r"))
    at = F.explode(F.sequence(F.lit(1), F.length("r"))).alias("i")
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("r") - F.col("i") + 1))).alias("k")
    cut = runs.select("r", at).select("r", "i", sizes)
    before = F.when(F.col("i") > 1, F.substring("r", F.col("i") - 1, F.lit(1)))
    after = F.when(F.col("i") + F.col("k") <= F.length("r"), F.substring("r", F.col("i") + F.col("k"), F.lit(1)))
    # sums by gram and neighbour first: no more rows than kinds leave a task
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), before.alias("c")), F.struct(F.lit("r").alias("side"), after.alias("c")))).alias("x")
    kinds = cut.select(F.substring("r", F.col("i"), F.col("k")).alias("gram"), sides).groupBy("gram", "x.side", "x.c").agg(F.count(F.lit(1)).alias("m"))
    n = F.sum("m")
    # -sum p ln p, an end of a run being a character of its own each time
    part = F.sum(F.when(F.col("c").isNotNull(), F.col("m") * F.log("m")).otherwise(0.0))
    own = kinds.groupBy("gram", "side").agg(n.alias("n"), (F.log(n) - part / n).alias("h"))
    return own.groupBy("gram").agg(F.max("n").alias("n"), F.max(F.when(F.col("side") == "l", F.col("h"))).alias("left"), F.max(F.when(F.col("side") == "r", F.col("h"))).alias("right"))


def vocabulary(texts: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: single characters, and longer n-grams that stand free on both sides and hold together inside."""
    grams = written(ngrams(texts).where(F.col("n") >= least), "ngrams")
    total = grams.where(F.length("gram") == 1).agg(F.sum("n")).first()[0] or 0
    single = grams.where(F.length("gram") == 1).select("gram", "n")
    free = grams.where((F.length("gram") > 1) & (F.col("left") >= LEAST_ENTROPY) & (F.col("right") >= LEAST_ENTROPY)).select("gram", "n")
    splits = free.select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k"))
    parts = splits.select("gram", "n", F.substring("gram", F.lit(1), F.col("k")).alias("a"), F.substring("gram", F.col("k") + 1, F.lit(LONGEST)).alias("b"))
    count = lambda side: grams.select(F.col("gram").alias(side), F.col("n").alias(f"n_{side}"))
    held = parts.join(count("a"), "a").join(count("b"), "b").groupBy("gram", "n").agg(F.min(F.col("n") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b"))).alias("held"))
    return single.unionByName(held.where(F.col("held") >= LEAST_COHESION).select("gram", "n")).withColumnRenamed("gram", "word")


def cut(run: str, cost: dict[str, float], unknown: float, longest: int = LONGEST) -> list[str]:
    """The words of least cost that make up ``run``; of equal ones those whose last word is longest."""
    best, back = [0.0], [0]
    for end in range(1, len(run) + 1):
        least, begin = math.inf, end - 1
        for size in range(min(longest, end), 0, -1):
            c = cost.get(run[end - size : end], unknown if size == 1 else math.inf)
            if best[end - size] + c < least - 1e-12:
                least, begin = best[end - size] + c, end - size
        best.append(least)
        back.append(begin)
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


class Segmenter:
    """Cuts texts into terms by a vocabulary (word, n), which is held."""

    def __init__(self, words: DataFrame):
        rows = words.limit(MOST_WORDS + 1).collect()
        if len(rows) > MOST_WORDS:
            raise ValueError("more words than can be sent to executors: count with a greater least number")
        total = sum(r.n for r in rows) or 1
        self.unknown = math.log(total + 1)
        self.cost = {r.word: self.unknown - math.log(r.n) for r in rows}
        self._sent = words.sparkSession.sparkContext.broadcast((self.cost, self.unknown))

    @classmethod
    def counted(cls, texts: DataFrame, least: int = LEAST_COUNT) -> Segmenter:
        return cls(vocabulary(texts, least))

    def tokens(self, c: Column) -> Column:
        """As ``functions.text.tokens``, with words for runs of Han and Kana."""
        sent = self._sent

        @F.pandas_udf("array<string>")
        def words(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cost, unknown = sent.value
            for batch in parts:
                yield batch.map(lambda runs: [w for r in runs for w in (cut(r, cost, unknown) if _unspaced(r) else (r,))])

        runs = plain_tokens(c)
        return F.when(F.coalesce(c, F.lit("")).rlike(f"[{UNSPACED}]"), words(runs)).otherwise(runs)


#: The ranges of ``UNSPACED``.
_RANGES = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _unspaced(run: str) -> bool:
    return any(a <= ord(run[0]) <= b for a, b in _RANGES)
