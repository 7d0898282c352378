"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage.

Items are indexed in blocks of ``BLOCK``; for each term the index holds the largest impact in the whole list and in
each block.  A passage is scored as block-max WAND does it: it is passed over if the list maxima of its terms
stay below the threshold, a block is passed over if its block maxima do, and only items of the blocks that
are left are scored exactly.  Bounds never lie below a score, so every item at or above the threshold is
retrieved.  Scores are shares of the item's score with itself, so one threshold serves all items.  Passages are
overlapping stretches of a whole text, as long as two strides, a stride being no shorter than the longest item: any
copied item lies within one passage.  Retrieved pairs are verified: both the item's question and its answer must
have 0.8 of their 5-word shingles in the passage.  An item's question runs to its last question mark, or else to its last
sentence, and the answer is the rest; an item that has no such cut with five words on both sides is both as a whole.

Test items are indexed in shards of about ``SHARD_ITEMS`` / 2 items and ``SHARD_BYTES`` of text, dealt by hash, so what is sent to
executors is bounded; each shard is one more pass over the documents.  Number, mean length, longest and document frequencies
are those of all items, so scores and passages are the same whatever the number of shards.

Defined results: null or empty texts, as documents or items, match nothing; an item of fewer than five words has no shingle to
verify and is left out of the index and its counts; rows that share an id are judged each by its text; copies of an item
count as items; an empty table on either side gives no match; other columns pass through ``decontaminate`` untouched."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD_BASE, Spans, Terms, ranges, slabs, stored

K1, B = 1.2, 0.75
BLOCK = 8
THRESHOLD, OVERLAP, SHINGLE = 0.5, 0.8, 5
STRIDE = 64
SHARD_ITEMS, SHARD_BYTES = 20_000, 16_000_000
_TERM = re.compile("[A-Za-z0-9\x80-\U0010ffff]+")


def question_and_answer(text: str) -> tuple[str, str]:
    """Cut at the last question mark, or else at the last sentence end, that leaves both parts a shingle's words; if there is none, both parts are the whole."""
    ends = [m.end() for m in re.finditer(r"[.!?\n]+(?=\s|$)", text)]
    asked = text.rfind("?") + 1
    for cut in [asked, *reversed(ends)]:
        if all(len(_TERM.findall(x)) >= SHINGLE for x in (text[:cut], text[cut:])):
            return text[:cut], text[cut:]
    return text, text


def shingles(spans: Spans, first: int, last: int) -> np.ndarray:
    """Hashes of the shingles in [first, last)."""
    a = np.arange(first, last - SHINGLE + 1)
    return np.unique(spans(a, a + SHINGLE))


@dataclass
class Counts:
    """Of all items: their number, mean length and longest, and in how many each term is (terms ascending)."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray

    def of(self, terms: np.ndarray) -> np.ndarray:
        return self.df[np.searchsorted(self.terms, terms)]


class Index:
    """BM25 impacts of some items (id, text, how many copies) by term, with list and block maxima."""

    def __init__(self, items: list[tuple[int, str, int]], counts: Counts | None = None):
        """``counts``: those of all items, if these are not all."""
        t = Terms([(x or "").encode() for _, x, _ in items])
        keep = np.flatnonzero(t.count >= SHINGLE)
        self.ids = [items[i][0] for i in keep]
        copies = np.array([items[i][2] for i in keep], np.int64)
        number = np.full(len(items), -1)
        number[keep] = np.arange(len(keep))
        n, length = len(keep), t.count[keep]
        own = number[t.doc] >= 0
        self.terms, term = np.unique(t.hash[own], return_inverse=True)
        pair, tf = np.unique(term.astype(np.int64) * max(n, 1) + number[t.doc[own]], return_counts=True)
        term, item = pair // max(n, 1), pair % max(n, 1)
        if counts is None:
            df = np.bincount(term, copies[item], len(self.terms)) if n else np.zeros(0)
            counts = Counts(int(copies.sum()), float((copies * length).sum() / max(1, copies.sum())), int(length.max()) if n else 0, self.terms, df)
        self.longest, df = counts.longest, counts.of(self.terms)
        idf = np.log1p((counts.n - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / (counts.mean or 1)))
        impact /= np.bincount(item, impact, n)[item] if n else 1
        self.item, self.impact = item, impact
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.blocks = -(-n // BLOCK)
        key, at = np.unique(term * max(self.blocks, 1) + item // BLOCK, return_inverse=True)
        self.block, self.block_max = key % max(self.blocks, 1), np.zeros(len(key))
        np.maximum.at(self.block_max, at, impact)
        self.block_start = np.searchsorted(key // max(self.blocks, 1), np.arange(len(self.terms) + 1))
        self.list_max = np.zeros(len(self.terms))
        np.maximum.at(self.list_max, term, impact)
        halves = [h for i in keep for h in question_and_answer(items[i][1])]
        h = Terms([x.encode() for x in halves])
        spans = Spans(h.hash, WORD_BASE)
        self.parts = [shingles(spans, h.first[k], h.first[k + 1]) for k in range(len(halves))]

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, float, float, float]]:
        """(text, passage, item's number, score, question's and answer's overlap) of all pairs at or above the threshold."""
        found: list[tuple[int, int, int, float, float, float]] = []
        n = len(self.ids)
        t = Terms(texts)
        if not n or not len(t.hash):
            return found
        stride = max(STRIDE, self.longest)
        term = np.minimum(np.searchsorted(self.terms, t.hash), len(self.terms) - 1)
        at = np.flatnonzero(self.terms[term] == t.hash)
        chunks = -(-t.count // stride)
        passages = np.maximum(chunks - 1, np.minimum(chunks, 1))
        base = np.concatenate(([0], np.cumsum(passages)))
        doc = t.doc[at]
        chunk = (at - t.first[doc]) // stride
        two = np.concatenate((chunk, chunk - 1))
        ok = (two >= 0) & (two < np.concatenate((passages[doc],) * 2))
        whose = (np.concatenate((base[doc],) * 2) + two)[ok]
        v = len(self.terms)
        pair = np.unique(whose * v + np.concatenate((term[at],) * 2)[ok])
        p, q = pair // v, pair % v
        low = THRESHOLD - 1e-9
        alive = np.bincount(p, self.list_max[q], base[-1]) >= low
        q = q[alive[p]]
        p = p[alive[p]]
        spans = None
        step = max(1, 500_000 // max(self.blocks, 1))
        cuts = np.searchsorted(p, np.arange(0, base[-1] + step, step))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a == b:
                continue
            pp, qq = p[a:b] - k * step, q[a:b]
            c = self.block_start[qq + 1] - self.block_start[qq]
            i = ranges(self.block_start[qq], c)
            bound = np.bincount(np.repeat(pp, c) * self.blocks + self.block[i], self.block_max[i], step * self.blocks)
            left = bound >= low
            some = left.reshape(step, self.blocks).any(axis=1)[pp]
            pp, qq = pp[some], qq[some]
            c = self.start[qq + 1] - self.start[qq]
            i, whose = ranges(self.start[qq], c), np.repeat(pp, c)
            ok = left[whose * self.blocks + self.item[i] // BLOCK]
            key, into = np.unique(whose[ok] * n + self.item[i[ok]], return_inverse=True)
            score = np.bincount(into, self.impact[i[ok]], len(key))
            for one, s in zip(key[score >= low].tolist(), score[score >= low].tolist(), strict=True):
                whose1, item = one // n + k * step, one % n
                d = int(np.searchsorted(base, whose1, side="right") - 1)
                number = whose1 - base[d]
                spans = spans or Spans(t.hash, WORD_BASE)
                begin = t.first[d] + number * stride
                end = min(begin + 2 * stride, t.first[d + 1])
                there = shingles(spans, begin, end)
                share = [float(np.isin(x, there).mean()) for x in self.parts[2 * item : 2 * item + 2]]
                found.append((d, int(number), item, s, *share))
        return found


def _terms_of(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of item_id, text, copies: (n, copies) for each item, and (hash, copies) for each term of it."""

    def run(each: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                copies = batch.column(1).to_numpy(zero_copy_only=False)
                for at, texts in slabs(batch.column(0)):
                    t, c = Terms(texts), copies[at : at + len(texts)]
                    ok = t.count >= SHINGLE
                    if each:
                        doc, n = np.flatnonzero(ok), t.count[ok]
                    else:
                        order = np.lexsort((t.hash, t.doc))
                        h, d = t.hash[order], t.doc[order]
                        new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) & ok[d] if len(h) else np.zeros(0, bool)
                        doc, n = d[new], h[new].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(c[doc], pa.int64())], ["value", "copies"])

        return run

    rows = items.select("text", "copies")
    return rows.mapInArrow(run(True), "value bigint, copies bigint"), rows.mapInArrow(run(False), "value bigint, copies bigint")


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """An index for each shard of the items, one at a time."""
    spark = benchmark.sparkSession
    items = stored(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies")))
    total = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    n = max(1, -(-total[0] // (SHARD_ITEMS // 2)), -(-(total[1] or 0) // SHARD_BYTES))  # dealt by hash: twice the mean is far beyond any shard
    if n == 1:
        yield Index([tuple(r) for r in items.orderBy("item_id", "text").collect()])
        return
    sizes, terms = _terms_of(items)
    every = sizes.agg(F.sum("copies"), F.sum(F.col("copies") * F.col("value")), F.max("value")).first()
    df = stored(terms.groupBy("value").agg(F.sum("copies").alias("df")))
    for k in range(n):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]
        own = np.unique(Terms([(x or "").encode() for _, x, _ in rows]).hash)
        asked = spark.createDataFrame(pa.table({"value": pa.array(own.view(np.int64))}))
        got = df.join(asked, "value").toArrow()  # no more terms than the shard's text has
        found = np.asarray(got.column("value"), np.int64).view(np.uint64)
        order = np.argsort(found)
        counts = Counts(every[0] or 0, (every[1] or 0) / max(1, every[0] or 0), every[2] or 0, found[order], np.asarray(got.column("df"), np.float64)[order])
        yield Index(rows, counts)


def verified(question: float, answer: float) -> bool:
    return question >= OVERLAP and answer >= OVERLAP


def retrieved(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, passage (number in its document), item_id, score, question_overlap, answer_overlap: every pair at or above the threshold."""
    out = None
    for one in indexes(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(one)  # of bounded size: a shard's

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                ids = batch.column(0)
                for at, texts in slabs(batch.column(1)):
                    if rows := index.search(texts):
                        d, p, i, s, q, a = zip(*rows, strict=True)
                        own = ids.take(pa.array([at + x for x in d]))
                        yield pa.RecordBatch.from_arrays(
                            [own, pa.array(p, pa.int32()), pa.array([index.ids[x] for x in i], pa.int64()), pa.array(s), pa.array(q), pa.array(a)],
                            ["doc_id", "passage", "item_id", "score", "question_overlap", "answer_overlap"],
                        )

        one = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, passage int, item_id bigint, score double, question_overlap double, answer_overlap double")
        out = one if out is None else out.unionByName(one)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it holds."""
    hits = retrieved(docs, benchmark).where((F.col("question_overlap") >= OVERLAP) & (F.col("answer_overlap") >= OVERLAP))
    return hits.groupBy("doc_id", "item_id").agg(
        F.countDistinct("passage").alias("n_passages"), F.max("score").alias("score"), F.max("question_overlap").alias("question_overlap"), F.max("answer_overlap").alias("answer_overlap")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; rows pass or go where they are read, without a shuffle."""
    at = docs.columns.index("text")
    for one in indexes(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for begin, texts in slabs(batch.column(at)):
                    for d, _, _, _, q, a in index.search(texts):
                        if verified(q, a):
                            keep[begin + d] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    shares = ("score", "question_overlap", "answer_overlap")
    return contaminated(docs, benchmark).withColumns({c: F.round(c, 6) for c in shares})



#: The same scores and shares for every passage and item, without an index.
SQL = r"""
WITH raw AS (SELECT row_number() OVER () AS i, item_id, coalesce(text, '') AS text FROM benchmark),
it AS (SELECT *, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ts FROM raw),
items AS (SELECT *, len(ts) AS n FROM it WHERE len(ts) >= 5),
st AS (SELECT count(*)::DOUBLE AS n, avg(n::DOUBLE) AS mean, greatest(64, max(n)) AS stride FROM items),
tf AS (SELECT i, n, term, count(*) AS tf FROM (SELECT i, n, unnest(ts) AS term FROM items) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
im AS (SELECT i, term, ln(1 + (st.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * tf.n / st.mean)) AS w FROM tf JOIN df USING (term), st),
nm AS (SELECT i, term, w / sum(w) OVER (PARTITION BY i) AS w FROM im),
cuts AS (SELECT i, text, k, substr(text, k, 1) = '?' AND NOT contains(substr(text, k + 1), '?') AS asked,
                contains('.!?' || chr(10), substr(text, k, 1)) AND regexp_matches(substr(text, k + 1, 1), '^(\s|$)') AS ends FROM (SELECT i, text, unnest(range(1, length(text) + 1)) AS k FROM items)),
good AS (SELECT i, max(k) FILTER (WHERE asked) AS a, max(k) FILTER (WHERE ends) AS e FROM cuts
         WHERE (asked OR ends) AND len(regexp_extract_all(left(text, k), '[a-zA-Z0-9\x{80}-\x{10FFFF}]+')) >= 5 AND len(regexp_extract_all(substr(text, k + 1), '[a-zA-Z0-9\x{80}-\x{10FFFF}]+')) >= 5 GROUP BY i),
cutat AS (SELECT items.i, items.item_id, items.text, coalesce(a, e) AS k FROM items LEFT JOIN good USING (i)),
halves AS (SELECT i, 'q' AS part, CASE WHEN k IS NULL THEN text ELSE left(text, k) END AS t FROM cutat UNION ALL SELECT i, 'a', CASE WHEN k IS NULL THEN text ELSE substr(text, k + 1) END FROM cutat),
ht AS (SELECT i, part, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ts FROM halves),
sh AS (SELECT DISTINCT i, part, array_to_string(ts[j:j + m - 1], ' ') AS s FROM (SELECT i, part, ts, least(5, len(ts)) AS m, unnest(range(1, len(ts) - least(5, len(ts)) + 2)) AS j FROM ht WHERE len(ts) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ts FROM documents),
p AS (SELECT rid, doc_id, p, ts[(p * stride + 1)::BIGINT:((p + 2) * stride)::BIGINT] AS ts
      FROM (SELECT rid, doc_id, ts, stride, unnest(range(greatest((len(ts) + stride - 1) // stride - 1, least(len(ts), 1)))) AS p FROM d, st)),
pt AS (SELECT DISTINCT rid, p, term FROM (SELECT rid, p, unnest(ts) AS term FROM p)),
sc AS (SELECT rid, p, i, sum(w) AS score FROM pt JOIN nm USING (term) GROUP BY rid, p, i HAVING sum(w) >= 0.5::DOUBLE - 1e-9::DOUBLE),
ov AS (SELECT sc.rid, sc.p, sc.i, any_value(p.doc_id) AS doc_id, any_value(score) AS score, coalesce(avg(contains(' ' || array_to_string(p.ts, ' ') || ' ', ' ' || s || ' ')::INTEGER) FILTER (WHERE part = 'q'), 0) AS q,
              coalesce(avg(contains(' ' || array_to_string(p.ts, ' ') || ' ', ' ' || s || ' ')::INTEGER) FILTER (WHERE part = 'a'), 0) AS a
       FROM sc JOIN p ON p.rid = sc.rid AND p.p = sc.p JOIN sh ON sh.i = sc.i GROUP BY sc.rid, sc.p, sc.i)
SELECT doc_id, item_id, count(DISTINCT p) AS n_passages, round(max(score), 6) AS score, round(max(q), 6) AS question_overlap, round(max(a), 6) AS answer_overlap
FROM ov JOIN items USING (i) WHERE q >= 0.8::DOUBLE AND a >= 0.8::DOUBLE GROUP BY doc_id, item_id
"""
