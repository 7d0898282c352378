"""Quality rules with adaptive thresholds, in DataFrame functions only.

Whole texts give integer measures.  Per language and source each measure is summarised by a mergeable quantile
sketch: counts on a fixed grid of bins (linear, and in octaves beyond 4096), which add up in any order and are the same on every
run.  Quartiles are read from the sketches of the document's own (language, source), of its language, merged from its sources, and of
all; a language's are drawn towards those of all as if ``PRIOR`` documents had these, and a group's towards its language's likewise,
so a group counts for itself the more documents it has, at any size.  Fences are the third quartile plus three spreads, and the first
less three, with a least spread per measure.  Documents join their fences and are filtered.

Defined results: null or empty text has zero measures and fails the base rule; null lang and null source are
groups of their own; repeated rows count each time; an empty table gives an empty result; other columns of the
input are left aside.  Repeated 3-word windows are found by 64-bit hashes within one document, of which the position
takes the low bits; neighbours of one hash are compared word by word, and a text in which two differ is settled by its windows themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE, let, stored, words

#: Documents that a language's quartiles count for in a group's, and those of all in a language's.
PRIOR = 50
#: measure: (least spread, whether low values are fenced too)
MEASURES = {"symbols": (10, False), "repeats": (100, False), "lines": (30, False), "length": (60, True)}


def repeat_words(w: Column, hashed=F.xxhash64) -> Column:
    """Words that lie in a 3-word window found twice or more in the array ``w``."""
    words_at = lambda w, i: [F.get(w, i + k) for k in range(3)]
    covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

    def exact(w):
        """From the windows themselves, sorted."""
        grams = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", *words_at(w, i)).alias("g"), i.alias("i"))))
        same = lambda s, a, b: F.coalesce(F.get(s, a)["g"] == F.get(s, b)["g"], F.lit(False))
        twice = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(s, k, k - 1) | same(s, k, k + 1))
        return let(grams, lambda s: covered(F.transform(twice(s), lambda k: F.get(s, k)["i"])))

    def of_hashes(w):
        n = F.size(w)
        bits = F.length(F.bin(n.cast("bigint")))
        low = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
        keyed = lambda low: F.transform(F.sequence(F.lit(0), n - 3), lambda i: hashed(*words_at(w, i)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint")))

        def settled(low):
            def marked(s):
                same = lambda a, b: F.coalesce(F.get(s, a).bitwiseXOR(F.get(s, b)).bitwiseAND(F.bitwise_not(low)) == 0, F.lit(False))
                place = lambda k: F.get(s, k).bitwiseAND(low).cast("int")
                differ = lambda p, q: F.get(w, p).__ne__(F.get(w, q)) | F.get(w, p + 1).__ne__(F.get(w, q + 1)) | F.get(w, p + 2).__ne__(F.get(w, q + 2))
                found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
                of_found = lambda found: F.when(
                    F.exists(found, lambda k: same(k, k + 1) & let(F.struct(place(k).alias("p"), place(k + 1).alias("q")), lambda x: differ(x["p"], x["q"]))), exact(w)
                ).otherwise(covered(F.transform(found, place)))
                return let(found, of_found)

            return let(F.array_sort(keyed(low)), marked)

        return F.when(n < 4, F.lit(0)).otherwise(let(low, settled))

    return let(w, of_hashes)


def measures(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("_t"))
    chars = F.length(F.regexp_replace("_t", SPACE, ""))
    symbols = F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))
    lines = F.filter(F.split("_t", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    repeated = let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s)))
    counted = let(words(F.col("_t")), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeat_words(w).cast("bigint").alias("r")))
    out = base.select(
        "doc_id", "lang", "source", counted.alias("_c"), chars.cast("bigint").alias("word_chars"), symbols.cast("bigint").alias("n_symbols"),
        repeated.cast("bigint").alias("n_dup_lines"),
    )
    out = out.select("doc_id", "lang", "source", F.col("_c.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_c.r").alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    bin_ = {
        "symbols": "1000 * n_symbols div greatest(word_chars, 1L)", "repeats": "1000 * n_repeat_words div greatest(n_words, 1L)",
        "lines": "1000 * n_dup_lines div greatest(n_words, 1L)", "length": "100 * word_chars div greatest(n_words, 1L)",
    }
    out = out.withColumn("base_failed", failed).withColumns({f"b_{m}": F.expr(x) for m, x in bin_.items()})
    # the first three are 1000 at most; of the mean length, bits beyond the 12 highest are let go
    octave = F.greatest(F.lit(0), F.length(F.bin("b_length")) - 12)
    return out.withColumn("b_length", (2048 * octave + F.call_function("shiftright", F.col("b_length"), octave)).cast("bigint"))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: the sketch of each group, over documents that pass the base rule."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"b_{m}").alias("bin")) for m in MEASURES]))
    return measured.where("not base_failed").select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.measure", "p.bin").agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: n and, for each measure, q1 and q3.  A group has as many rows here as there are bins, at most."""
    keys = [F.col(c) for c in by] + [F.col("measure")]
    up = Window.partitionBy(*keys).orderBy("bin")
    cum = sketch.withColumn("c", F.sum("n").over(up)).withColumn("t", F.sum("n").over(Window.partitionBy(*keys)))
    q = lambda m, k: F.min(F.when((F.col("measure") == m) & (F.col("c") * 4 >= F.col("t") * k), F.col("bin")))
    return cum.groupBy(*by).agg(F.max("t").alias("n"), *[q(m, k).alias(f"{m}_q{k}") for m in MEASURES for k in (1, 3)])


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source and for each measure low and high, from the quartiles of the group, its language and all."""
    names = [f"{m}_q{k}" for m in MEASURES for k in (1, 3)]
    own, tongue, every = quartiles(sketch, ["lang", "source"]), quartiles(merge(sketch, ["lang"]), ["lang"]), quartiles(merge(sketch, []), [])
    drawn = lambda n, own, to: (F.col(n).cast("double") * F.col(own) + F.lit(float(PRIOR)) * to) / (F.col(n).cast("double") + F.lit(float(PRIOR)))
    every = every.select(*[F.col(c).alias(f"a_{c}") for c in names])
    tongue = tongue.join(F.broadcast(every)).select(F.col("lang").alias("_lang"), *[drawn("n", c, F.col(f"a_{c}")).alias(f"l_{c}") for c in names])  # every: one row
    out = own.join(tongue, F.col("lang").eqNullSafe(F.col("_lang")), "inner").select("lang", "source", *[drawn("n", c, F.col(f"l_{c}")).alias(c) for c in names])
    spread = lambda m: F.lit(3.0) * F.greatest(F.col(f"{m}_q3") - F.col(f"{m}_q1"), F.lit(float(MEASURES[m][0])))
    return out.select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"),
        *[(F.col(f"{m}_q3") + spread(m)).alias(f"{m}_high") for m in MEASURES], *[(F.col(f"{m}_q1") - spread(m)).alias(f"{m}_low") for m in MEASURES if MEASURES[m][1]],
    )


def judge(docs: DataFrame) -> DataFrame:
    """Measures, base_failed, kept: one row per document."""
    measured = stored(measures(docs))
    fence = fences(sketches(measured))
    both = measured.join(fence, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for m, (_, low) in MEASURES.items():
        inside = inside & (F.col(f"b_{m}") <= F.col(f"{m}_high"))
        if low:
            inside = inside & (F.col(f"b_{m}") >= F.col(f"{m}_low"))
    return both.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def op1(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    names = [f"{m}_q{k}" for m in MEASURES for k in (1, 3)]
    qs = ", ".join(f"min(bin) FILTER (WHERE measure = '{m}' AND c * 4 >= t * {k}) AS {m}_q{k}" for m in MEASURES for k in (1, 3))
    cum = lambda by, src: f"SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY bin) AS c, sum(n) OVER (PARTITION BY {by}measure) AS t FROM {src}"
    drawn = lambda n, own, to: f"({n}.n::DOUBLE * {own} + {PRIOR}::DOUBLE * {to}) / ({n}.n::DOUBLE + {PRIOR}::DOUBLE)"
    spread = lambda m: f"3::DOUBLE * greatest({m}_q3 - {m}_q1, {MEASURES[m][0]}::DOUBLE)"
    inside = " AND ".join(f"b_{m} <= {m}_q3 + {spread(m)}" + (f" AND b_{m} >= {m}_q1 - {spread(m)}" if MEASURES[m][1] else "") for m in MEASURES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS gram FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS k FROM g) WHERE k > 1),
v AS (SELECT rid, count(DISTINCT i + o)::BIGINT AS n FROM r, (VALUES (0), (1), (2)) x(o) GROUP BY rid),
l AS (SELECT rid, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN l USING (rid) LEFT JOIN v USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             1000 * n_symbols // greatest(word_chars, 1) AS b_symbols, 1000 * n_repeat_words // greatest(n_words, 1) AS b_repeats,
             1000 * n_dup_lines // greatest(n_words, 1) AS b_lines, 2048 * e + (x >> e) AS b_length
      FROM (SELECT *, greatest(0, length(bin(x)) - 12) AS e FROM (SELECT *, 100 * word_chars // greatest(n_words, 1) AS x FROM m))),
h AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, b_{m} AS bin, count(*) AS n FROM b WHERE NOT base_failed GROUP BY ALL" for m in MEASURES)}),
hl AS (SELECT lang, measure, bin, sum(n) AS n FROM h GROUP BY ALL), ha AS (SELECT measure, bin, sum(n) AS n FROM h GROUP BY ALL),
o AS (SELECT lang, source, max(t) AS n, {qs} FROM ({cum("lang, source, ", "h")}) GROUP BY lang, source),
tl AS (SELECT lang, max(t) AS n, {qs} FROM ({cum("lang, ", "hl")}) GROUP BY lang), a AS (SELECT {qs} FROM ({cum("", "ha")})),
ll AS (SELECT lang, {", ".join(drawn("tl", f"tl.{c}", f"a.{c}") + f" AS {c}" for c in names)} FROM tl CROSS JOIN a),
f AS (SELECT o.lang, o.source, {", ".join(drawn("o", f"o.{c}", f"l.{c}") + f" AS {c}" for c in names)} FROM o JOIN ll l ON o.lang IS NOT DISTINCT FROM l.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({inside}, false) AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""


SQL = _sql()
