"""Substring dedup by level-wise doubling.

A word that lies in a window of 50 words which also starts in a document with a smaller doc_id is removed.  The
levels are 13, 25 and 50 words (50 halved, rounded up).

* 13: each 50-word window names its anchor, the 13-word window in it with the least hash.  Equal windows name equal
  anchors, so only anchors need to be counted, about one word in twenty.  Anchors of one document alone end here.
* 25: an anchor found in two documents is extended to 25 words, to its right and to its left; any 50-word window
  holds one of the two.  It goes on if one of them is found in two documents.
* 50: consecutive 50-word windows with one surviving anchor are a run.  Runs equal as a whole (anchor and all words) are
  settled together by their least doc_id.  Where one anchor has different runs, one run of each kind is opened into
  its 50-word windows, which are settled each by its own least doc_id.

At each level a document has one row for a value, with all places where it stands: a text that repeats a word or a
sentence names an anchor or a run at nearly every word, but meets others once for each.

The hashes of the levels 13 and 25 only choose what is looked at: values that fall together by chance or design add
candidates and take none away.  What is removed is settled by XXH3 digests of the words themselves, of 64 bits, among windows
of one anchor.

Defined results: null or blank text has no words; a text of under 50 words loses none; rows with null doc_id
lose nothing and cost nothing to others; rows that share a doc_id are judged each on its own text, and do not
count as smaller than each other; an empty table gives an empty result; other columns are left aside."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD_BASE, Spans, joined, ranges, slabs, stored, word_bounds, word_hashes

WINDOW = 50
HALF, START = 25, 13
#: Anchors that one 50-word window chooses from.
CHOICE = WINDOW - START + 1


class Slab:
    """Words of some texts laid end to end, one space between them: their bounds, hashes and the document of each."""

    def __init__(self, texts: list[bytes]):
        self.texts = [b" ".join(t.split()) for t in texts]
        self.buf, self.at = joined(self.texts)
        self.begin, self.end = word_bounds(self.buf)
        self.hash = Spans(word_hashes(self.buf, self.begin, self.end), WORD_BASE)
        self.first = np.searchsorted(self.begin, self.at)  # of each document's words, and of none after the last
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.stop = self.first[1:][self.doc]  # where the document of a word ends

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all 50-word windows, and the start of each one's anchor."""
        i = np.flatnonzero(np.arange(len(self.begin)) + WINDOW <= self.stop)
        if not len(i):
            return i, i
        n = len(self.begin) - START + 1
        h = self.hash(np.arange(n), np.arange(n) + START)
        view = np.lib.stride_tricks.sliding_window_view(h, CHOICE)
        offset = np.concatenate([view[i[k : k + 32768]].argmin(axis=1) for k in range(0, len(i), 32768)])
        return i, i + offset

    def extended(self, p: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchors that have 25 words from their start (side 0) or up to their end (side 1), and the hashes of these words."""
        a = p if side == 0 else p + START - HALF
        ok = (a >= self.first[:-1][self.doc[p]]) & (a + HALF <= self.stop[p])
        return p[ok], self.hash(a[ok], a[ok] + HALF)

    def digests(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """XXH3 of the words [a, b) themselves."""
        flat = memoryview(self.buf)
        cuts = map(flat.__getitem__, map(slice, self.begin[a].tolist(), self.end[b - 1].tolist()))
        return np.fromiter(map(xxhash.xxh3_64_intdigest, cuts), np.uint64, len(a)).view(np.int64)


def _lists(values: pa.Array, count: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in rows sorted by ``keys``."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))


def _sizes(begin: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.concatenate((begin, [n])))


def first_pass(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_words, sha of all words, and the distinct anchors: hashes, and of each the distinct extensions to each side with their anchors' starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slabs(batch.column(2)):
                s = Slab(texts)
                _, p = s.anchors()
                p = np.unique(p)
                (right, to_right), (left, to_left) = s.extended(p, 0), s.extended(p, 1)
                own, longer, side = np.concatenate((right, left)), np.concatenate((to_right, to_left)), np.repeat([0, 1], [len(right), len(left)])
                doc, short = s.doc[own], s.hash(own, own + START)
                order = np.lexsort((own, longer, side, short, doc))
                own, longer, side, doc, short = (x[order] for x in (own, longer, side, doc, short))
                g = _groups(doc, short, side, longer)
                starts = _lists(pa.array(own - s.first[:-1][doc], pa.int32()), _sizes(g, len(own)))
                sides = pa.StructArray.from_arrays([pa.array(side[g], pa.int32()), pa.array(longer[g].view(np.int64)), starts], ["side", "hash", "starts"])
                k = _groups(doc[g], short[g])
                sides, count = _lists(sides, _sizes(k, len(g))), np.bincount(doc[g[k]], minlength=len(texts))
                sha = [hashlib.sha256(t).hexdigest() for t in s.texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(np.diff(s.first), pa.int64()), pa.array(sha),
                        _lists(pa.array(short[g[k]].view(np.int64)), count), _lists(sides, count),
                    ],
                    ["doc_id", "th", "n_words", "sha", "hash", "sides"],
                )

    return docs.mapInArrow(run, "doc_id bigint, th bigint, n_words bigint, sha string, hash array<bigint>, sides array<array<struct<side:int,hash:bigint,starts:array<int>>>>")


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys found in two documents."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(*keys, "least")


def _runs(rows: DataFrame) -> DataFrame:
    """From doc_id, th, text, starts: the distinct runs of 50-word windows with one surviving anchor, and where each starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slabs(batch.column(2)):
                s = Slab(texts)
                kept = batch.column(3).slice(at, len(texts))
                doc = np.repeat(np.arange(len(texts)), [len(x) for x in kept])
                alive = np.zeros(len(s.begin) + 1, bool)
                alive[kept.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + s.first[:-1][doc]] = True
                i, p = s.anchors()
                i, p = i[alive[p]], p[alive[p]]
                if not len(i):
                    continue
                new = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 0) | (np.diff(i) != 1))))
                n = _sizes(new, len(i))
                a, d = i[new], s.doc[i[new]]
                anchor, whole = s.hash(p[new], p[new] + START), s.digests(a, a + n - 1 + WINDOW)
                order = np.lexsort((a, n, whole, anchor, d))
                new, n, a, d, anchor, whole = (x[order] for x in (new, n, a, d, anchor, whole))
                g = _groups(d, anchor, whole, n)
                take, windows = pa.array(d[g]), i[ranges(new[g], n[g])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)).take(take), batch.column(1).slice(at, len(texts)).take(take),
                        _lists(pa.array(a - s.first[:-1][d], pa.int32()), _sizes(g, len(a))), pa.array(n[g], pa.int32()), pa.array(anchor[g].view(np.int64)),
                        pa.array(whole[g]), _lists(pa.array(s.digests(windows, windows + WINDOW)), n[g]),
                    ],
                    ["doc_id", "th", "starts", "n", "anchor", "whole", "hashes"],
                )

    return rows.mapInArrow(run, "doc_id bigint, th bigint, starts array<int>, n int, anchor bigint, whole bigint, hashes array<bigint>")


def _cut(rows: DataFrame) -> DataFrame:
    """From doc_id, th, text and the (start, n) runs to remove: what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slabs(batch.column(2)):
                texts = [b" ".join(t.split()) for t in part]
                buf, base = joined(texts)
                begin, end = word_bounds(buf)
                first = np.searchsorted(begin, base)
                cuts = batch.column(3).slice(at, len(part))
                doc = np.repeat(np.arange(len(part)), cuts.value_lengths().to_numpy())
                flat = cuts.flatten()
                start, n = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
                edge = np.zeros(len(begin) + 1, np.int64)
                np.add.at(edge, first[:-1][doc] + start, 1)
                np.add.at(edge, first[:-1][doc] + start + n - 1 + WINDOW, -1)
                keep = np.cumsum(edge)[:-1] == 0
                of = np.repeat(np.arange(len(part)), np.diff(first))
                new = np.flatnonzero(keep & np.concatenate(([True], ~keep[:-1] | (of[1:] != of[:-1]))))
                last = np.flatnonzero(keep & np.concatenate((~keep[1:] | (of[1:] != of[:-1]), [True])))
                stretches = [buf[a:b].tobytes() for a, b in zip(begin[new].tolist(), end[last].tolist(), strict=True)]
                mine = np.searchsorted(of[new], np.arange(len(part) + 1)).tolist()
                left = [b" ".join(stretches[a:b]) for a, b in zip(mine[:-1], mine[1:], strict=True)]
                gone = np.bincount(of, ~keep, len(part)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(gone), pa.array([hashlib.sha256(t).hexdigest() for t in left], pa.string()),
                        pa.array(left, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "th", "n_removed", "kept_sha", "kept_text"],
                )

    return rows.mapInArrow(run, "doc_id bigint, th bigint, n_removed bigint, kept_sha string, kept_text string")


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs``: doc_id, text.  Returns all documents (doc_id, th, n_words, sha) and those that lose words (doc_id, th, n_removed, kept_sha, kept_text).

    th is the hash of the text; with doc_id it names a row."""
    named = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    base = stored(first_pass(named))
    # 13 words
    lists = base.where("doc_id is not null")
    twice = stored(_repeated(lists.select("doc_id", F.explode("hash").alias("hash")), "hash"))
    anchors = lists.select("doc_id", "th", F.explode(F.arrays_zip("hash", "sides")).alias("x")).select("doc_id", "th", "x.hash", "x.sides")
    alive = stored(anchors.join(twice, "hash", "left_semi").drop("hash"))
    # 25 words
    longer = alive.select("doc_id", "th", F.explode("sides").alias("x")).select("doc_id", "th", "x.side", "x.hash", "x.starts")
    twice = stored(_repeated(longer, "side", "hash"))
    alive = stored(longer.join(twice, ["side", "hash"], "left_semi").groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")))
    # texts are joined by exchanges at any size, so plans and costs are alike at all
    second = stored(named.join(alive.hint("merge"), ["doc_id", "th"]).select("doc_id", "th", "text", "starts").dropDuplicates(["doc_id", "th"]))
    # 50 words
    runs = stored(_runs(second))
    # runs of a kind have the same words, so any one's windows are those of all
    kinds = stored(runs.groupBy("anchor", "whole").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("hashes").alias("hashes")))
    runs = runs.drop("hashes")
    settled = runs.join(kinds.where("least < most").select("anchor", "whole", "least"), ["anchor", "whole"]).where("least < doc_id").select("doc_id", "th", F.transform("starts", lambda s: F.struct(s.alias("start"), "n")).alias("cuts"))
    # written first: a join of two plain exchanges is split where an anchor is hot
    mixed = stored(kinds.groupBy("anchor").agg((F.min("whole") != F.max("whole")).alias("mixed")).where("mixed").select("anchor"))
    opened = kinds.join(mixed, "anchor").select("anchor", "whole", F.col("least").alias("doc_id"), F.posexplode("hashes").alias("o", "hash"))
    windows = stored(opened)
    least = stored(_repeated(windows, "anchor", "hash"))
    single = windows.join(least, ["anchor", "hash"]).where("least < doc_id").groupBy("anchor", "whole", "doc_id").agg(F.collect_set("o").alias("os"))
    each = F.transform("starts", lambda s: F.transform("os", lambda o: F.struct((s + o).alias("start"), F.lit(1).alias("n"))))
    single = runs.join(stored(single), ["anchor", "whole", "doc_id"]).select("doc_id", "th", F.flatten(each).alias("cuts"))
    cuts = settled.unionByName(single).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    lost = stored(_cut(second.drop("starts").join(cuts.hint("merge"), ["doc_id", "th"]).select("doc_id", "th", "text", "cuts")))
    return base.select("doc_id", "th", "n_words", "sha"), lost


def op3(docs: DataFrame) -> DataFrame:
    base, lost = repeats(docs)
    lost = lost.select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), "n_removed", "kept_sha")
    out = base.join(lost, (F.col("doc_id") == F.col("_d")) & (F.col("th") == F.col("_h")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the words removed from ``text`` (the rest joined by one space); texts that lose nothing stay as they are."""
    _, lost = repeats(docs)
    lost = lost.select(F.col("doc_id").alias("lost_id"), F.col("th").alias("lost_th"), "kept_text")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    out = packed.join(lost.hint("merge"), (F.col("id") == F.col("lost_id")) & (F.col("hash") == F.col("lost_th")), "left")
    return out.select(F.col("row").withField("text", F.coalesce("kept_text", "row.text")).alias("row")).select("row.*")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d)),
m AS (SELECT h, min(doc_id) AS least FROM p GROUP BY h),
c AS (SELECT rid, list(i) AS starts FROM p JOIN m USING (h) WHERE least < doc_id GROUP BY rid),
u AS (SELECT rid, s + o AS i FROM (SELECT rid, unnest(starts) AS s FROM c), range(0, 50) x(o)),
q AS (SELECT DISTINCT rid, i FROM u),
e AS (SELECT rid, i, word FROM (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d)),
k AS (SELECT e.rid, string_agg(word, ' ' ORDER BY e.i) AS kept, count(*) AS n FROM e ANTI JOIN q ON e.rid = q.rid AND e.i = q.i GROUP BY e.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
