"""Mixing sources to target weights.

Every document gets a key hash-random in its id and text; keys are ranged into buckets within each source, bucket sums give
each bucket's offset, and a window inside one bucket gives each document's distributed prefix sum.  A source
is passed over as often as its target asks (epochs); the last pass is cut at the exact budget, inside a
document if need be.

Defined results: null text has size 0 and is taken 0 times; a null source is a source of its own, last in
order; rows are ordered by key, doc_id, size and text hash, so reruns agree (rows equal in all of these, which alone share a
bucket whatever their number, are interchangeable); an empty table gives an empty result; other columns pass
through ``mix`` untouched, and names of ours are prefixed by ``_mix_``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored, words

#: Rows that one bucket of a source holds on average; a bucket is the unit that one task sorts.
BUCKET_ROWS = 2_000


def source_targets(sizes: DataFrame, weights=(3, 1, 2), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes``: one row per source (_mix_source, _mix_rows, _mix_total).  Adds _mix_target.

    Weights repeat over sources by code point, null last.  A target over ``most`` times its source is set to
    that and the excess reshared by weight (targets are given to six places); that is the level at which sum(min(level * weight, cap)) meets
    the budget, found from prefix sums in order of cap / weight.  One row of five numbers per source meets in one task here, and of a
    source one row per ``BUCKET_ROWS`` documents in ``plan_mix``; both are sorted with spilling."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_mix_rank") % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("_mix_source").isNull(), F.col("_mix_source"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.withColumn("_mix_rank", F.row_number().over(order) - 1).withColumn("_mix_weight", w)
    s = s.withColumn("_mix_cap", F.col("_mix_total") * F.lit(float(most)))
    s = s.withColumn("_mix_budget", F.sum("_mix_total").over(every) * F.lit(float(budget)))
    # sources before this one, in order of cap / weight, are capped; the rest share what is left by weight
    by_ratio = Window.orderBy(F.col("_mix_cap") / F.col("_mix_weight"), "_mix_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_mix_budget") - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0.0))) / F.sum("_mix_weight").over(rest)
    s = s.withColumn("_mix_try", level)
    # trying one source after another as capped raises the level until it is right, and lowers it from there
    s = s.withColumn("_mix_level", F.max("_mix_try").over(every))
    return s.withColumn("_mix_target", F.round(F.least(F.col("_mix_level") * F.col("_mix_weight"), F.col("_mix_cap")), 6)).select("_mix_source", "_mix_rows", "_mix_total", "_mix_target")


def _row_hash(docs, *names):
    return F.xxhash64(*[F.coalesce(docs[c].cast("string"), F.lit("\\0")) for c in names])


def plan_mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(3, 1, 2), budget=1.5, most=2.0, seed="mix") -> DataFrame:
    """One row per document: _mix_id, _mix_source, _mix_hash (of its text), size, source_size, target, taken."""
    named = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    key = F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("bigint")
    slim = docs.select(
        F.col(id_col).alias("_mix_id"), F.col(source_col).alias("_mix_source"), _row_hash(docs, id_col, text_col, source_col).alias("_mix_hash"),
        key.alias("_mix_key"), F.size(words(F.col(text_col))).cast("bigint").alias("size"),
    )
    slim = stored(slim)
    totals = slim.groupBy("_mix_source").agg(F.count(F.lit(1)).alias("_mix_rows"), F.sum("size").alias("_mix_total"))
    targets = stored(source_targets(totals, weights, budget, most))
    # keys are below 2**48 and uniform, so equal ranges of them are equal shares of a source
    n = F.ceil(F.col("_mix_rows") / F.lit(float(BUCKET_ROWS)))
    bucket = F.floor(F.col("_mix_key") / F.lit(float(1 << 48)) * n).cast("bigint")
    ranged = slim.join(targets.withColumnRenamed("_mix_source", "_t"), F.col("_mix_source").eqNullSafe(F.col("_t")), "inner")
    ranged = ranged.withColumn("_mix_bucket", bucket).drop("_t")
    sums = ranged.groupBy("_mix_source", "_mix_bucket").agg(F.sum("size").alias("_mix_sum"))
    up = Window.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_mix_source").alias("_s"), F.col("_mix_bucket").alias("_b"), F.coalesce(F.sum("_mix_sum").over(up), F.lit(0)).alias("_mix_offset"))
    inside = Window.partitionBy("_mix_source", "_mix_bucket").orderBy("_mix_key", F.col("_mix_id").asc_nulls_last(), "size", "_mix_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_mix_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, F.col("_mix_source").eqNullSafe(F.col("_s")) & (F.col("_mix_bucket") == F.col("_b")), "inner")
    want = F.floor(F.col("_mix_target")).cast("bigint")
    total = F.greatest(F.col("_mix_total"), F.lit(1))
    epochs = F.expr("floor(_mix_target) div greatest(_mix_total, 1L)")
    left = want - epochs * total
    last = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_mix_offset") - F.col("_mix_before")))
    return placed.select(
        "_mix_id", "_mix_source", "_mix_hash", "size", F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"),
        (epochs * F.col("size") + last).cast("bigint").alias("taken"),
    )


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mix itself: a row per document and epoch in which it is taken, all columns kept.

    Adds _mix_epoch (from 0) and _mix_words; the one document per source that the budget cuts has its text
    cut to that many words, joined by one space.  Rows equal in id, source and text are numbered, so that
    each takes its own share."""
    plan = stored(plan_mix(docs, id_col, text_col, source_col, **options).where("taken > 0"))
    kept = plan.groupBy("_mix_hash", "_mix_id").agg(F.max("size").alias("size"), F.sort_array(F.collect_list("taken"), asc=False).alias("takes"))
    left = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), _row_hash(docs, id_col, text_col, source_col).alias("hash"))
    same = Window.partitionBy("hash").orderBy("id")
    left = left.withColumn("no", F.row_number().over(same) - F.rank().over(same))
    equal = (F.col("id") == F.col("_mix_id")) | (F.col("id").isNull() & F.col("_mix_id").isNull())
    out = left.join(kept, (F.col("hash") == F.col("_mix_hash")) & equal, "inner")
    out = out.withColumn("taken", F.get(F.col("takes"), F.col("no"))).where("taken > 0")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.expr("int((taken - 1) div size)"))))
    out = out.withColumn("n", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))
    text = F.col("row").getField(text_col)
    cut = F.when(F.col("n") < F.col("size"), F.array_join(F.slice(words(text), F.lit(1), F.col("n").cast("int")), " ")).otherwise(text)
    ours = ("_mix_epoch", "_mix_words")
    out = out.select(F.col("row").withField(text_col, cut).alias("row"), "epoch", "n")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ours], F.col("epoch").alias(ours[0]), F.col("n").alias(ours[1]))


def op9(docs: DataFrame) -> DataFrame:
    return plan_mix(docs).select(F.col("_mix_id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')))[1:12] AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
r AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INTEGER] AS w,
             row_number() OVER (ORDER BY source IS NULL, source) AS rk, total * 2.0::DOUBLE AS cap,
             (sum(total) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
t AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS try FROM r),
u AS (SELECT *, max(try) OVER () AS lv FROM t),
g AS (SELECT source, total, round(least(lv * w, cap), 6) AS target FROM u),
p AS (SELECT d.doc_id, d.size, g.total, g.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, total AS source_size, target,
       ((floor(target)::BIGINT // greatest(total, 1)) * size
        + greatest(0, least(size, floor(target)::BIGINT - (floor(target)::BIGINT // greatest(total, 1)) * greatest(total, 1) - before)))::BIGINT AS taken
FROM p
"""
