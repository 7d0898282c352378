"""SimHash near-dedup by pigeonhole blocks.

A fingerprint's first 64 bits are split into r blocks.  Two fingerprints that differ in at most d of them agree on r - d
whole blocks at least, so a key is made of every choice of r - d blocks; fingerprints that share a key meet in
one bucket and are verified there by Hamming distance.  A bucket yields a spanning forest of its links, never all its pairs.
Only distinct fingerprints are blocked, so any number of equal copies is one member.

Two rules of what is linked:

* ``CONTRACT`` (query op5): 64 bits of 4-word shingles, 4 of which may differ.  A bucket of more than ``BUCKET``
  members is blocked again at a finer split, in which close pairs share a key all the same; at the last split a
  bucket has at most 2**16 different members.  No pair within the distance is lost at any size.
* ``NEAR`` (``near_dedup``, the pipeline's stage): 64 bits of 2-word shingles, 7 of which may differ, to meet, and 192 bits of
  5-word shingles, 36 of which may differ, to be verified: texts whose 5-word shingles are 0.8 alike differ in 29 of these on the
  average.  A bucket of more than ``BUCKET`` members is dealt into parts by hash; each part's forest leaves one member of each
  tree, and these meet again.  Members that are then not in the bucket's largest component are compared with every part, so no
  pair within the bounds is lost at any size; what is sent grows with the number of such members alone.

Defined results: null, empty or blank text has fingerprint zero, linked like any other; a text of fewer words than a
shingle is one shingle; rows with equal doc_id are rows of their own; a row with null doc_id links but never names a
component (null if nothing else is reachable); an empty table gives an empty result; other columns are left aside."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import MIX_1, MIX_2, WORD_BASE, Spans, joined, mix, slabs, stored, word_bounds, word_hashes
from .components import components

SHINGLE, SEED = 4, 42
#: Members that one bucket may hold before it is split again; each is 8 bytes a word of its fingerprint.
BUCKET = 20_000
#: Sizes of buckets whose members are compared all at once before any is linked: by shifts, and as a matrix.
SHIFTED, SQUARE = 32, 2048


@dataclass(frozen=True)
class Rule:
    #: Bits of the first 64 that may differ, and number of blocks by number of fingerprints, so that chance meetings stay few.
    distance: int
    splits: tuple[tuple[int, int | None], ...]
    #: Words of 64 bits in a fingerprint, and bits of all but the first that may differ.
    words: int = 1
    rest: int = 0

    @property
    def columns(self) -> list[str]:
        return [f"p{k}" for k in range(self.words)]


CONTRACT = Rule(4, ((6, 4_000_000), (7, 250_000_000), (8, None), (12, None), (16, None)))
NEAR = Rule(7, ((9, 30_000_000), (10, 1_000_000_000), (11, None), (12, None)), 4, 36)


def fingerprint(text: bytes) -> int:
    found = text.lower().split()
    if not found:
        return 0
    n = max(1, len(found) - SHINGLE + 1)
    flat = b" ".join(found)
    end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begin = np.concatenate(([0], end[:-1] + 1))
    cuts = map(flat.__getitem__, map(slice, begin[:n].tolist(), end[-n:].tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(SEED)), np.uint64, n)
    count = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        count += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def wide(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of 256 bits, a row of four words each: one of 2-word shingles and three of 5-word shingles."""
    buf, at = joined([t.lower() for t in texts])
    begin, end = word_bounds(buf)
    first = np.searchsorted(begin, at)
    count = np.diff(first)
    spans = Spans(word_hashes(buf, begin, end), WORD_BASE)
    out = np.zeros((len(texts), 4), np.uint64)
    for n, places in ((2, (0,)), (5, (1, 2, 3))):
        many = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
        doc = np.repeat(np.arange(len(texts)), many)
        a = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + first[:-1][doc]
        h = spans(a, a + np.minimum(n, count)[doc])
        for k in places:
            out[:, k] = _majority(mix(h + np.uint64(k * MIX_1 % (1 << 64))) if k else h, doc, many)
    return out


def _majority(h: np.ndarray, doc: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of each document the bits set in over half of its hashes."""
    count = np.zeros((len(many), 64), np.int64)
    for lo in range(0, len(h), 1 << 17):
        d = doc[lo : lo + (1 << 17)]
        new = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        bits = np.unpackbits(h[lo : lo + (1 << 17)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count[d[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int32)
    return np.packbits(2 * count > many[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def nodes(m: np.ndarray) -> np.ndarray:
    """The number that stands for a fingerprint: itself if it has one word, else a hash."""
    out = m[:, 0]
    for k in range(1, m.shape[1]):
        out = mix(out * np.uint64(MIX_2) + m[:, k])
    return out


def fingerprints(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """doc_id, th (hash of the text), node, and the words of the fingerprint (bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if rule.words == 1:
                m = np.array([fingerprint(t) for _, part in slabs(b.column(2)) for t in part], np.uint64).reshape(-1, 1)
            else:
                m = np.concatenate([np.zeros((0, rule.words), np.uint64), *(wide(part) for _, part in slabs(b.column(2)))])
            found = [pa.array(x.view(np.int64)) for x in (nodes(m).copy(), *m.T.copy())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *found], ["doc_id", "th", "node", *rule.columns])

    kinds = "".join(f", {c} bigint" for c in rule.columns)
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id bigint, th bigint, node bigint" + kinds)


def masks(blocks: int, distance: int = CONTRACT.distance) -> list[int]:
    """A mask of every choice of blocks - distance blocks, as signed 64-bit numbers."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    sums = [sum(block[i] for i in some) for some in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in sums]


def near(a: np.ndarray, b: np.ndarray, rule: Rule) -> np.ndarray:
    """Whether the fingerprints in the rows of a and b (unsigned: of signed numbers numpy counts the bits of the absolute value) link."""
    ok = np.bitwise_count(a[..., 0] ^ b[..., 0]) <= rule.distance
    if rule.words > 1 and ok.any():
        a, b = np.broadcast_arrays(a, b)
        ok[ok] = np.bitwise_count(a[ok][:, 1:] ^ b[ok][:, 1:]).sum(axis=1, dtype=np.int64) <= rule.rest
    return ok


def forest(m: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a bucket, each member but one of a linked set with that one, and the members that are left: all by row."""
    a, b, seeds = [], [], []
    left = np.arange(len(m))
    while len(left):
        seed, left, front = left[0], left[1:], [left[0]]
        seeds.append(seed)
        while front and len(left):
            ok = near(m[left], m[front.pop()], rule)
            if ok.any():
                got, left = left[ok], left[~ok]
                a.append(np.full(len(got), seed))
                b.append(got)
                front.extend(got)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none), np.array(seeds, np.int64)


class Found:
    """Rows (a, b, k, words): links with their ends, and members that go on with their key."""

    def __init__(self, rule: Rule):
        self.rule, self.a, self.b, self.k, self.on = rule, [], [], [], []

    def link(self, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(nodes(m[a]))
        self.b.append(nodes(m[b]))

    def go_on(self, k: np.ndarray, m: np.ndarray) -> None:
        self.k.append(k)
        self.on.append(m)

    def batches(self) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (self.a, self.b))
        k, on = np.concatenate([np.zeros(0, np.int64), *self.k]), np.concatenate([np.zeros((0, self.rule.words), np.uint64), *self.on]).view(np.int64)
        pad = lambda x, before, after: pa.array(np.concatenate((np.zeros(before, np.int64), x, np.zeros(after, np.int64))), mask=np.repeat([True, False, True], [before, len(x), after]))
        if len(a) + len(k):
            yield pa.RecordBatch.from_arrays([pad(a, 0, len(k)), pad(b, 0, len(k)), pad(k, len(a), 0), *(pad(x, len(a), 0) for x in on.T)], ["a", "b", "k", *self.rule.columns])
        self.__init__(self.rule)


def _links(rule: Rule, most: int | None, in_parts: bool):
    """Over rows sorted by key.  Buckets over ``most`` go on unlinked; ``in_parts``: rows have the number of their part after
    the key, parts are linked as buckets, and of each the members left of its forest go on."""
    lead = 2 if in_parts else 1

    def busy(found_in: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which buckets of up to SHIFTED members hold a link; larger ones are taken to."""
        size = end - begin
        some = size > SHIFTED
        for shift in range(1, SHIFTED):
            open_ = np.flatnonzero((size > shift) & ~some)
            if not len(open_):
                break
            n = size[open_] - shift
            i = np.repeat(begin[open_] - np.cumsum(n) + n, n) + np.arange(n.sum())
            hit = near(found_in[i], found_in[i + shift], rule)
            some[open_[np.repeat(np.arange(len(n)), n)[hit]]] = True
        return some

    def close(found: Found, k: np.ndarray, m: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        some = np.ones(len(begin), bool) if in_parts else busy(m, begin, end)
        for x, y in zip(begin[some], end[some], strict=True):
            own = m[x:y]
            if most and y - x > most:
                found.go_on(k[x:y], own)
                continue
            if not in_parts and SHIFTED < y - x <= SQUARE and np.count_nonzero(np.bitwise_count(own[:, None, 0] ^ own[None, :, 0]) <= rule.distance) == y - x:
                continue  # each is near to itself alone
            a, b, left = forest(own, rule)
            found.link(own, a, b)
            if in_parts:
                found.go_on(k[x:y][left], own[left])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        over = None  # key of a bucket too large to hold, whose members go on as they come
        found = Found(rule)
        for b in batches:
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(lead + rule.words)], axis=1)
            if held is not None:
                rows = np.concatenate((held, rows))
            if not len(rows):
                continue
            k, m = rows[:, 0], rows[:, lead:].view(np.uint64)
            new = np.flatnonzero(np.concatenate(([True], (rows[1:, :lead] != rows[:-1, :lead]).any(axis=1))))
            if over is not None and over == k[0]:
                stop = new[1] if len(new) > 1 else len(k)
                found.go_on(k[:stop], m[:stop])
                new = new[1:]
                if not len(new):
                    held = None
                    yield from found.batches()
                    continue
            over, begin = None, new[-1]
            close(found, k, m, new[:-1], new[1:])
            if most and len(k) - begin > most:
                over, held = k[begin], None
                found.go_on(k[begin:], m[begin:])
            else:
                held = rows[begin:]
            yield from found.batches()
        if held is not None:
            close(found, held[:, 0], held[:, lead:].view(np.uint64), np.array([0]), np.array([len(held)]))
            yield from found.batches()

    return run


def named(rows: DataFrame, rule: Rule) -> DataFrame:
    """``rows`` (k and the words of a fingerprint) with the node of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(rule.words)], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes(m).view(np.int64))], ["k", *rule.columns, "node"])

    return rows.mapInArrow(run, "k bigint" + "".join(f", {c} bigint" for c in rule.columns) + ", node bigint")


def met(rows: DataFrame, rule: Rule, most: int | None, parts: int = 0) -> DataFrame:
    """``rows`` (k and the words of a fingerprint) dealt by k, or by k and part, and linked: see ``_links``."""
    lead = ["k", "part"] if parts else ["k"]
    if parts:
        rows = rows.withColumn("part", F.pmod(F.xxhash64(*rule.columns), F.lit(parts)))
    dealt = rows.select(*lead, *rule.columns).repartition(*lead).sortWithinPartitions(*lead)
    return stored(dealt.mapInArrow(_links(rule, most, parts > 0), "a bigint, b bigint, k bigint" + "".join(f", {c} bigint" for c in rule.columns)))


def trees(hot: DataFrame, rule: Rule) -> DataFrame:
    """Links of the parts of large buckets, and of one member of each part's trees, as long as these grow fewer."""
    found, was = [], None
    while True:
        largest = hot.groupBy("k").count().agg(F.max("count")).first()[0] or 0
        if largest <= 1 or was and 2 * largest > was:
            break
        out = met(hot, rule, None, -(-2 * largest // BUCKET))
        found.append(out.where("b is not null").select("a", "b"))
        hot, was = out.where("b is null").select("k", *rule.columns), largest
    return reduce(DataFrame.unionByName, found)


def loose(hot: DataFrame, found: DataFrame, rule: Rule, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """What ``found`` leaves open in large buckets.  A pair of the largest component of a bucket is settled; each other member is
    compared with every part of the bucket.  Returns these links, and the members of buckets with more than ``BUCKET`` others
    (unless ``last``), which are to be blocked more finely instead; None if there are none."""
    root = components(found)
    own = stored(named(hot, rule).join(root, "node", "left").select("k", *rule.columns, F.coalesce("root", "node").alias("root")))
    of = own.groupBy("k", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("k")
    main = stored(of.agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0"))
    crowded = F.lit(False) if last else F.col("others") > BUCKET
    rows = own.join(main.where(~crowded), "k")
    i, j = (F.greatest(F.lit(1), F.ceil(F.col(c) * 2 / BUCKET)) for c in ("size", "others"))
    part, block = (F.pmod(F.xxhash64(F.lit(s), *rule.columns), n) for s, n in ((1, i), (2, j)))
    met_by = F.transform(F.sequence(F.lit(0).cast("bigint"), j - 1), lambda x: F.xxhash64("k", part, x))
    asks = F.transform(F.sequence(F.lit(0).cast("bigint"), i - 1), lambda x: F.xxhash64("k", x, block))
    keys = F.when(F.col("root") == F.col("main"), met_by).otherwise(F.array_union(met_by, asks))
    out = met(rows.select(F.explode(keys).alias("k"), *rule.columns), rule, None).where("b is not null").select("a", "b")
    finer = None if last or main.where(crowded).isEmpty() else own.join(main.where(crowded), "k", "left_semi").select(*rule.columns).distinct()
    return out, finer


def links(fps: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """``fps``: distinct words of fingerprints.  Returns bigint a, b: edges (by node) with the same components as all linked pairs."""
    n = fps.count()
    level = next(i for i, (_, most) in enumerate(rule.splits) if most is None or n <= most)
    final = len(rule.splits) - 1
    bounded = rule.words == 1  # the last split bounds its buckets
    found, left = None, fps
    while True:
        keys = [F.xxhash64(F.lit(i), F.col("p0").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(rule.splits[level][0], rule.distance))]
        out = met(left.select(F.explode(F.array(*keys)).alias("k"), *rule.columns), rule, None if bounded and level == final else BUCKET)
        own = out.where("b is not null").select("a", "b")
        found = own if found is None else found.unionByName(own)
        hot = out.where("b is null").select("k", *rule.columns)
        if hot.isEmpty():
            return found
        if bounded:
            left = hot.select(*rule.columns).distinct()
        else:
            found = found.unionByName(trees(hot, rule))
            more, left = loose(hot, found, rule, level == final)
            found = found.unionByName(more)
            if left is None:
                return found
        left, level = stored(left), min(level + 1, final)


def classes(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """doc_id, th, node, p0, root (a node of the component), component_id: one row per input row."""
    docs_fp = stored(fingerprints(docs, rule))
    # equal nodes are equal fingerprints
    fps = stored(docs_fp.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in rule.columns]))
    root = components(links(fps.select(*rule.columns), rule))
    own = stored(fps.select("node", "least").join(root.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    least = stored(own.groupBy("root").agg(F.min("least").alias("component_id")))
    named = stored(own.join(least, "root").select("node", "root", "component_id"))
    return docs_fp.join(named, "node").select("doc_id", "th", "node", "p0", "root", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group by ``NEAR``: that with the smallest doc_id (of rows equal in it, that with the least
    hash of its text; of rows equal in both, one); a group without any doc_id keeps one row."""
    found = classes(docs, NEAR)
    # the row that each group keeps, by doc_id (maybe null) and hash of its text; and whether there are several such rows
    first = F.min(F.when(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")), F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "th")))
    kept = found.groupBy("root").agg(first.alias("k")).select("k.doc_id", "k.th")
    twice = found.groupBy("doc_id", "th").agg((F.count(F.lit(1)) > 1).alias("_twice"))
    kept = stored(kept.join(twice, kept["doc_id"].eqNullSafe(twice["doc_id"]) & (kept["th"] == twice["th"])).select(kept["doc_id"].alias("_id"), kept["th"].alias("_th"), "_twice"))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    left = packed.join(kept.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_th")))
    return left.where("not _twice").select("row.*").unionByName(left.where("_twice").dropDuplicates(["id", "hash"]).select("row.*"))


def op5(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("p0"), 16, "0")).alias("fingerprint"), "component_id")
