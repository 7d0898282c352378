"""Filter interaction audit by direct relational replay.

Five filters judge every document by its whole text: A few words, B few different words, C many capitals, D symbols, E the same text
under a smaller doc_id anywhere in the table.  A document's failures are five bits.  Each document's bits meet all 120 orders of
the filters, a table of fixed size that is sent to every executor; its first failure under an order is read from the order's masks,
the five steps are exploded, and conditional sums are combined on the map side, so that 600 rows per part and task are shuffled.

E needs all texts but shuffles digests (SHA-256) only: the least doc_id of each digest found under two ids is joined back, with plain
exchanges on both sides, so that a digest held by a third of all rows is split by adaptive execution.

Defined results: null or empty text has no words and no characters, fails A alone (and E by its ties, as all empty texts are
identical); a null doc_id is neither smaller nor larger than another, so its row never fails E nor makes one fail; rows that share an id
are documents of their own, and do not count as smaller than each other; null and empty sources are one part; a document with
several label rows is good, or toxic, if one of them says so, and labels without an id say nothing; an empty table gives an empty
result; other columns are left aside."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, stored, words

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_flags(text: Column) -> Column:
    """The bits of the filters that look at the text alone: A 1, B 2, C 4, D 8."""
    bit = lambda test, k: F.when(test, F.lit(1 << k)).otherwise(F.lit(0))
    chars = F.length(text)
    capitals = chars - F.length(F.regexp_replace(text, "[A-Z]", ""))
    counted = let(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("u")))
    of_words = let(counted, lambda c: bit(c["n"] < 200, 0) + bit(100 * c["u"] < 50 * c["n"], 1))
    return of_words + bit(100 * capitals.cast("bigint") > 2 * chars, 2) + bit(text.rlike("[#$%&*|]"), 3)


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, flags, good, toxic: one row per document."""
    text = F.coalesce("text", F.lit(""))
    seen = stored(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own_flags(text).alias("own")))
    twice = seen.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    both = seen.join(stored(twice), "digest", "left").join(stored(said), "doc_id", "left")
    again = F.when(F.col("least") < F.col("doc_id"), F.lit(16)).otherwise(F.lit(0))
    return both.select("part", (F.col("own") + again).alias("flags"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def orders(spark) -> DataFrame:
    """The 120 orders: no, and the masks of the filters in their order."""
    rows = [(k, [1 << FILTERS.index(c) for c in order]) for k, order in enumerate(ORDERS)]
    return spark.createDataFrame(rows, "no int, masks array<int>")


def replay(flags: DataFrame) -> DataFrame:
    """``flags``: part, flags, good, toxic.  Counts by part, no and step under all orders."""
    crossed = flags.crossJoin(F.broadcast(orders(flags.sparkSession)))
    first = F.lit(6)
    for k in reversed(range(5)):
        first = F.when(F.col("flags").bitwiseAND(F.get("masks", F.lit(k))) != 0, F.lit(k + 1)).otherwise(first)
    steps = crossed.select("part", "flags", "good", "toxic", "no", first.alias("first"), F.posexplode("masks").alias("at", "mask"))
    step = F.col("at") + 1
    fails, here = F.col("flags").bitwiseAND(F.col("mask")) != 0, F.col("first") == step
    tests = (F.col("first") > step, here, fails & (F.col("first") < step), F.col("flags") == F.col("mask"), here & (F.col("good") == 1), here & (F.col("toxic") == 1))
    return steps.groupBy("part", "no", step.alias("step")).agg(*[F.sum(t.cast("bigint")).alias(c) for t, c in zip(tests, COUNTS, strict=True)])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, with the counts and shapley, the filter's removals over all orders."""
    counts = stored(replay(flagged(docs, labels)))
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("no") + 1)
    named = counts.withColumn("filter_order", order).withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    total = named.groupBy(F.col("part").alias("_part"), F.col("letter").alias("_letter")).agg(F.sum("removed").alias("shapley"))
    out = named.join(total, (F.col("part") == F.col("_part")) & (F.col("letter") == F.col("_letter")))
    return out.select("part", "filter_order", "step", *COUNTS, "shapley")


op11 = audit

SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM t),
l AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT row_number() OVER () AS rid, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(least < w.doc_id, false)] AS fails FROM w LEFT JOIN l USING (doc_id)),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT part, good, toxic, fails, filter_order, [fails[instr('ABCDE', filter_order[k])] FOR k IN range(1, 6)] AS hit FROM f, o),
p AS (SELECT *, coalesce(list_position(hit, true), 6) AS first, len(list_filter(fails, lambda v: v)) AS n FROM s),
e AS (SELECT *, unnest(range(1, 6)) AS step FROM p),
g AS (SELECT part, filter_order, step::INT AS step, count(*) FILTER (WHERE first > step) AS kept, count(*) FILTER (WHERE first = step) AS removed,
             count(*) FILTER (WHERE hit[step] AND first < step) AS redundant, count(*) FILTER (WHERE hit[step] AND n = 1) AS unique_fails,
             count(*) FILTER (WHERE first = step AND good = 1) AS good_lost, count(*) FILTER (WHERE first = step AND toxic = 1) AS toxic_lost
      FROM e GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM g
"""
