"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is logistic in its distinct features (its terms, and the first
2 to 8 bytes of each); a document's is the noisy-or of its sentences, 1 - prod(1 - s).  Weights are learned from
document labels alone, by the gradient through the noisy-or, and then tell which sentences offend.

Labels are learned from a bounded sample of labelled rows: up to ``SAMPLE`` of each label, those with the least hash of
doc_id, weighted so that both labels count as in all labelled rows.  Weights are given to the features that tell
toxic documents of the sample (by likelihood ratio, over ``LEAST_RATIO``).  Scores use the text alone.  The sentences that
score ``LOCATED`` or more are the offending ones, given by their places in code points.

Defined results: a null, empty or wordless text has no sentence and scores 0; rows that share a doc_id are scored
each by its text, and if labelled the one with the least hash of its text is learned from; several labels of a document count
as toxic if one is 1; null labels are left aside; without labels of both kinds every score is 0; an empty table gives an empty
result; other columns are left aside."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Terms, prefix_hashes, sigmoid, slabs, stored

SAMPLE = 4000
LEAST_DOCS, LEAST_RATIO = 5, 12.0
PREFIXES = range(2, 9)
ROUNDS, RATE, DECAY = 300, 0.05, 3e-4
CUT, LOCATED = 0.7, 0.5
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


class Bags:
    """Terms of some texts with the sentence of each; a sentence is a stretch with terms and without an end mark."""

    def __init__(self, texts: list[bytes]):
        self.t = Terms(texts, latin=True)
        mark = np.concatenate(([0], np.cumsum(_ENDS[self.t.buf])))[self.t.begin] + self.t.doc
        self.sentence = np.concatenate(([0], np.cumsum(np.diff(mark) != 0))) if len(mark) else mark
        n = self.sentence[-1] + 1 if len(mark) else 0
        self.doc = self.t.doc[np.searchsorted(self.sentence, np.arange(n))]

    def features(self):
        """(hashes, their terms), kind by kind: whole terms, then prefixes (their hashes differ by their length)."""
        yield self.t.hash, np.arange(len(self.t.hash))
        size = self.t.end - self.t.begin
        for n in PREFIXES:
            at = np.flatnonzero(size > n)
            yield prefix_hashes(self.t.folded, self.t.begin[at], n) ^ np.uint64(n), at


class Lexicon:
    """A set of 64-bit hashes: a bit table turns most away, a search settles the rest."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes.astype(np.uint64))
        self.bits: np.ndarray | None = None

    def __getstate__(self):
        return {"hashes": self.hashes, "bits": None}

    def find(self, bags: Bags) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (sentence, number in the lexicon)."""
        if self.bits is None:
            self.bits = np.zeros(1 << 20, bool)
            self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        n, out = max(1, len(self.hashes)), []
        if len(self.hashes):
            for h, term in bags.features():
                some = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
                number = np.minimum(np.searchsorted(self.hashes, h[some]), n - 1)
                ok = self.hashes[number] == h[some]
                out.append(bags.sentence[term[some[ok]]] * n + number[ok])
        pair = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return pair // n, pair % n


class Model:
    def __init__(self, lexicon: Lexicon, weight: np.ndarray, bias: float | None):
        """``bias`` None: nothing was learned, every score is 0."""
        self.lexicon, self.weight, self.bias = lexicon, weight, bias

    def sentences(self, bags: Bags) -> np.ndarray:
        if self.bias is None:
            return np.zeros(len(bags.doc))
        sentence, number = self.lexicon.find(bags)
        return sigmoid(self.bias + np.bincount(sentence, self.weight[number], len(bags.doc)))

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """The score of each text, and (begin, end, score) of its offending sentences, from first to last term, in code points."""
        bags = Bags(texts)
        s = self.sentences(bags)
        scores = -np.expm1(np.bincount(bags.doc, np.log1p(-np.minimum(s, 1 - 1e-12)), len(texts)))
        found: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        bad = np.flatnonzero(s >= LOCATED)
        if len(bad):
            points = np.concatenate(([0], np.cumsum((bags.t.buf & 0xC0) != 0x80)))
            first, last = np.searchsorted(bags.sentence, bad), np.searchsorted(bags.sentence, bad, side="right") - 1
            base = points[bags.t.at[bags.doc[bad]]]
            begin, end = points[bags.t.begin[first]] - base, points[bags.t.end[last]] - base
            for d, a, b, x in zip(bags.doc[bad].tolist(), begin.tolist(), end.tolist(), s[bad].tolist(), strict=True):
                found[d].append((a, b, x))
        return scores, found


def fit(whose: np.ndarray, sentence: np.ndarray, number: np.ndarray, y: np.ndarray, weight_of: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """``whose``: the document of each sentence; ``sentence`` and ``number``: the features found.  Returns weights and bias."""
    theta = np.zeros(n + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, ROUNDS + 1):
        s = sigmoid(theta[-1] + np.bincount(sentence, theta[number], len(whose)))
        none = np.exp(np.bincount(whose, np.log1p(-np.minimum(s, 1 - 1e-9)), len(y)))
        pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * weight_of
        dz = s * pull[whose]
        grad = np.concatenate((np.bincount(number, dz[sentence], n) + DECAY / max(n, 1) * theta[:-1], [dz.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return theta[:-1], float(theta[-1])


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = stored(known.where(~held_out()))
    order = F.xxhash64("doc_id")
    sample = known.where("toxic = 1").orderBy(order).limit(SAMPLE).unionByName(known.where("toxic = 0").orderBy(order).limit(SAMPLE))
    sample = stored(sample)  # at most 2 * SAMPLE rows of two numbers
    total = dict(known.groupBy("toxic").count().collect())
    # one row of each doc_id: no more texts than doc_ids are learned from
    named = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    chosen = stored(named.select("doc_id", "th").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("th").alias("th"), F.min("toxic").alias("toxic")))
    texts = stored(named.join(F.broadcast(chosen), ["doc_id", "th"]).dropDuplicates(["doc_id"]).select("toxic", "text", "doc_id"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column(0), np.int64)
            for at, part in slabs(batch.column(1), 500_000):
                bags, own = Bags(part), []
                for h, term in bags.features():
                    order = np.lexsort((h, bags.t.doc[term]))
                    h, d = h[order], bags.t.doc[term][order]
                    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else [])
                    own.append((h[new], toxic[at + d[new]]))
                h, y = (np.concatenate(x) for x in zip(*own, strict=True))
                h, into = np.unique(h, return_inverse=True)
                pos = np.bincount(into, y == 1, len(h))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(pos.astype(np.int64)), pa.array(np.bincount(into, minlength=len(h)) - pos.astype(np.int64))], ["hash", "pos", "neg"])

    n1, n0 = texts.where("toxic = 1").count(), texts.where("toxic = 0").count()
    if not n1 or not n0:
        return Model(Lexicon(np.zeros(0, np.uint64)), np.zeros(0), None)
    a, c = F.col("pos"), F.col("neg")
    part = lambda x, n, k, m: F.when(x > 0, x * F.log(x * F.lit(float(m)) / (F.lit(float(n)) * k))).otherwise(0.0)
    ratio = 2 * (part(a, n1, a + c, n1 + n0) + part(c, n0, a + c, n1 + n0) + part(n1 - a, n1, n1 + n0 - a - c, n1 + n0) + part(n0 - c, n0, n1 + n0 - a - c, n1 + n0))
    counts = texts.mapInArrow(counted, "hash bigint, pos bigint, neg bigint").groupBy("hash").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    told = counts.where((a + c >= LEAST_DOCS) & (a * n0 > 2 * c * n1)).select("hash", ratio.alias("ratio")).where(F.col("ratio") >= LEAST_RATIO)
    # no more than a sample's texts hold
    lexicon = Lexicon(np.asarray(told.select("hash").toArrow()["hash"], np.int64).view(np.uint64))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slabs(batch.column(1)):
                bags = Bags(part)
                sentence, number = lexicon.find(bags)
                first = np.searchsorted(bags.doc, np.arange(len(part) + 1))
                cut = np.searchsorted(bags.doc[sentence], np.arange(len(part) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x, pa.int32())) for x in (sentence - first[bags.doc[sentence]], number)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(np.diff(first), pa.int32()), *lists], ["toxic", "doc_id", "n", "sentence", "number"])

    got = texts.mapInArrow(found, "toxic int, doc_id bigint, n int, sentence array<int>, number array<int>").toArrow()
    got = got.sort_by("doc_id").drop_columns("doc_id")  # training must not depend on the order of rows
    y, n = np.asarray(got.column(0), np.int64), np.asarray(got.column(1), np.int64)
    size = np.array([len(x) for x in got.column(2)], np.int64)
    base = np.concatenate(([0], np.cumsum(n)[:-1]))
    sentence, number = (np.asarray(got.column(c).combine_chunks().flatten(), np.int64) for c in (2, 3))
    share = total[1] / (total[0] + total[1])
    weight_of = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    whose = np.repeat(np.arange(len(y)), n)
    weight, bias = fit(whose, sentence + np.repeat(base, size), number, y, weight_of, len(lexicon.hashes))
    return Model(lexicon, weight, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, offending: array of (begin, end, score) of the sentences that offend, in code points."""
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = [np.zeros(0)], []
            for _, part in slabs(batch.column(1)):
                s, spans = model.read(part)
                scores.append(s)
                found += spans
            spans = [[{"begin": a, "end": b, "score": x} for a, b, x in some] for some in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores)), pa.array(spans, pa.list_(span))], ["doc_id", "score", "offending"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, offending array<struct<begin:bigint,end:bigint,score:double>>")


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "offending")
