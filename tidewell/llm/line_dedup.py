"""Line dedup by a sharded minimal perfect hash.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; it is named by 128 bits of BLAKE2b.  Keys of at
least 10 code points found in two documents lose their lines everywhere but in the document of least doc_id.

* Blocks: documents are read once, in blocks of about a megabyte of text (a longer text is a block of its own).  A block holds the
  distinct keys of its lines, each once, and which line has which key.
* Counts: the blocks' keys are added up to one row for each distinct key: how many documents hold it, and the least of them.
* Shards: the distinct keys are dealt by their leading bits to shards of about ``SHARD_KEYS``, each of which gets a minimal perfect
  hash (levels of bits; a key is placed at the first level where it is alone at its position, and its slot is the number of bits set
  before it) that indexes an array of 32-bit fingerprints, one of counts (one byte, that stops at 255) and, for the keys that are
  found in two documents, one of least ids.
* Probes: a block sends the keys of a shard together, each key once however many lines have it, so that a line that a third of all
  documents hold costs one probe a block.  A task reads its shards one after the other, each with the probes that follow it,
  and holds one shard at a time.  Only keys found in two documents are answered.
* Cut: answers return to their blocks, which tell each document's lines that stay; documents that lose lines are read again, and
  their texts are joined by doc_id and hash to what stays.  The others are settled from their block.

Every key that is probed was indexed, so slots are right and fingerprints have nothing to reject here; they are for texts from
elsewhere (``Shard.find``), of which one unknown line in 2^32 is taken for a known one.

Defined results: a null or empty text is one empty line and loses none; a row with a null doc_id loses nothing and counts as no
document; rows that share a doc_id are one document (a line in both is no repeat), each judged on its own text; lines
repeated within the least document all stay; a text whose lines all go becomes empty; an empty table gives an empty result;
other columns are left aside."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import MIX_1, MIX_2, mix, ranges, slabs, stored

LEAST_CHARS = 10
#: Distinct keys of a shard, at most about: its arrays take some 8 MB.
SHARD_KEYS = 1 << 20
#: Bits of a level for each key that is left, and levels; keys left after the last (none, but for an attack on the mixer) are listed.
GAMMA, LEVELS = 2, 40
BLANK = b" \t\n\v\f\r"
#: Bytes of a text that are split at once.
PIECE = 1_000_000

_digest = partial(hashlib.blake2b, digest_size=16)


def _keys(lines: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Which of the lines have a key of 10 code points or more, and the names of these keys."""
    at, names = [], []
    for i, line in enumerate(lines):
        key = line.strip(BLANK).lower()
        if len(key) >= LEAST_CHARS and (len(key) >= 4 * LEAST_CHARS or len(key.decode("utf-8", "replace")) >= LEAST_CHARS):
            at.append(i)
            names.append(_digest(key).digest())
    return at, names


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The lines of a text, some megabyte at a time."""
    begin = 0
    while (end := text.find(b"\n", begin + PIECE)) >= 0:
        yield text[begin:end].split(b"\n")
        begin = end + 1
    yield text[begin:].split(b"\n")


def _block(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text; and of the lines with a key: the text, the place in it, and the key (two columns)."""
    n = np.zeros(len(texts), np.int64)
    held, at, names = np.zeros(len(texts), np.int64), [], []
    for d, text in enumerate(texts):
        for lines in _pieces(text):
            i, found = _keys(lines)
            at.append(np.array(i, np.int64) + n[d])
            names.append(b"".join(found))
            held[d] += len(i)
            n[d] += len(lines)
    keys = np.frombuffer(b"".join(names), ">u8").astype(np.uint64).reshape(-1, 2)
    return n, np.repeat(np.arange(len(texts)), held), np.concatenate(at), keys


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and which of them each key is."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]).any(axis=1)
    which = np.empty(len(k), np.int64)
    which[order] = np.cumsum(new) - 1
    return k[new], which


def _list(values, kind: pa.DataType, mask=None) -> pa.ListArray:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind, mask=mask))


BLOCK = (
    "block bigint, ids array<bigint>, ths array<bigint>, shas array<string>, lines array<int>, owner array<int>, at array<int>, which array<int>, "
    "h1 array<bigint>, h2 array<bigint>, least array<bigint>, most array<bigint>, n array<int>"
)


def blocks(named: DataFrame) -> DataFrame:
    """``named``: doc_id, th, text.  One row for each block: its documents, its lines with a key, and its distinct keys with the least and
    greatest doc_id and the number of documents of each (least is null where none has an id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, texts in slabs(batch.column(2)):
                lines, owner, at, keys = _block(texts)
                key, which = _distinct(keys)
                own, ths = (batch.column(c).slice(first, len(texts)) for c in (0, 1))
                known = own.is_valid().to_numpy(zero_copy_only=False)
                ids = own.fill_null(0).to_numpy(zero_copy_only=False)
                holds = np.unique(np.stack([which, owner], axis=1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
                holds = holds[known[holds[:, 1]]]
                least, most = np.full(len(key), np.iinfo(np.int64).max), np.full(len(key), np.iinfo(np.int64).min)
                np.minimum.at(least, holds[:, 0], ids[holds[:, 1]])
                np.maximum.at(most, holds[:, 0], ids[holds[:, 1]])
                n = np.bincount(holds[:, 0], minlength=len(key))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.ListArray.from_arrays(pa.array([0, len(ths)], pa.int32()), ths),
                        _list([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), _list(lines, pa.int32()), _list(owner, pa.int32()), _list(at, pa.int32()), _list(which, pa.int32()),
                        _list(key[:, 0].view(np.int64), pa.int64()), _list(key[:, 1].view(np.int64), pa.int64()), _list(least, pa.int64(), n == 0), _list(most, pa.int64(), n == 0), _list(n, pa.int32()),
                    ],
                    [c.split()[0] for c in BLOCK.split(", ")],
                )
                block += 1

    return named.mapInArrow(run, BLOCK)


def counted(held: DataFrame) -> DataFrame:
    """h1, h2, least, n: the distinct keys of all blocks; n is 1 unless two doc_ids hold the key."""
    keys = held.select(F.explode(F.arrays_zip("h1", "h2", "least", "most", "n")).alias("x")).select("x.*").where("least is not null")
    total = keys.groupBy("h1", "h2").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))
    return total.select("h1", "h2", "least", F.when(F.col("least") < F.col("most"), F.least("n", F.lit(255))).otherwise(F.lit(1)).cast("int").alias("n"))


class Shard:
    """A minimal perfect hash over distinct keys of 128 bits, and the arrays it indexes."""

    def __init__(self, n: int, sizes, bits: bytes, spare: bytes, fingerprints: bytes, counts: bytes, least: bytes):
        self.n, self.sizes = n, [int(s) for s in sizes]
        self.set = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(self.sizes)).astype(bool)
        self.rank = np.cumsum(self.set, dtype=np.int32) - 1
        self.spare = np.frombuffer(spare, np.uint64).reshape(-1, 2)
        self.fingerprints = np.frombuffer(fingerprints, np.uint32)
        self.counts = np.frombuffer(counts, np.uint8)
        self.least = np.frombuffer(least, np.int64)
        self.repeat = np.cumsum(self.counts > 1, dtype=np.int32) - 1

    @staticmethod
    def position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        one, two = (np.uint64((level + 1) * m % (1 << 64)) for m in (MIX_1, MIX_2))
        return (mix(mix(keys[:, 0] + one) ^ (keys[:, 1] + two)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def built(cls, keys: np.ndarray, counts: np.ndarray, least: np.ndarray) -> dict:
        """The columns of a shard; ``least`` counts where ``counts`` is over 1."""
        sizes, levels, left = [], [], keys
        while len(left) and len(sizes) < LEVELS:
            size = -(-GAMMA * len(left) // 64) * 64
            p = cls.position(left, len(sizes), size)
            alone = np.bincount(p, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            left = left[~alone[p]]
        bits = np.packbits(np.concatenate(levels)).tobytes() if levels else b""
        shard = cls(len(keys), sizes, bits, left.tobytes(), b"", b"", b"")
        slot = shard.slots(keys)
        out = [np.empty(len(keys), t) for t in (np.uint32, np.uint8, np.int64)]
        for a, v in zip(out, (keys[:, 1].astype(np.uint32), counts, least), strict=True):
            a[slot] = v
        fingerprints, n, first = out
        return {"keys": len(keys), "sizes": sizes, "bits": bits, "spare": left.tobytes(), "fingerprints": fingerprints.tobytes(), "counts": n.tobytes(), "least": first[n > 1].tobytes()}

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of an unknown key any slot, or -1."""
        slot = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            p = self.position(keys[left], level, size) + base
            here = self.set[p]
            slot[left[here]] = self.rank[p[here]]
            left, base = left[~here], base + size
        placed = self.n - len(self.spare)
        for k, key in enumerate(self.spare):
            slot[left[(keys[left] == key).all(axis=1)]] = placed + k
        return slot

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each key (0: unknown), and the least doc_id of those with a count over 1."""
        slot = self.slots(keys)
        known = slot >= 0
        known[known] = self.fingerprints[slot[known]] == keys[known, 1].astype(np.uint32)
        count = np.where(known, self.counts[slot] if self.n else 0, 0)
        least = np.zeros(len(keys), np.int64)
        least[count > 1] = self.least[self.repeat[slot[count > 1]]]
        return count, least


SHARD = "shard int, keys int, sizes array<int>, bits binary, spare binary, fingerprints binary, counts binary, least binary"


def _shard(h1: Column, bits: int) -> Column:
    return F.call_function("shiftrightunsigned", h1, F.lit(64 - bits)).cast("int") if bits else F.lit(0)


def index(counts: DataFrame, bits: int) -> DataFrame:
    """2**bits shards over the distinct keys: those that hold any."""

    def build(group: pa.Table) -> pa.Table:
        shard, h1, h2, least, n = (group.column(c).to_numpy() for c in ("shard", "h1", "h2", "least", "n"))
        made = {"shard": int(shard[0])} | Shard.built(np.stack([h1.view(np.uint64), h2.view(np.uint64)], axis=1), n.astype(np.uint8), least)
        kinds = {"shard": pa.int32(), "keys": pa.int32(), "sizes": pa.list_(pa.int32())}
        return pa.table({c: pa.array([v], kinds.get(c, pa.binary())) for c, v in made.items()})

    return counts.select(_shard(F.col("h1"), bits).alias("shard"), "h1", "h2", "least", "n").groupBy("shard").applyInArrow(build, SHARD)


def packs(held: DataFrame, bits: int) -> DataFrame:
    """shard, block, first, probes: the distinct keys of a block that go to one shard; they follow each other from ``first`` in the block's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in enumerate(batch.column(0).to_pylist()):
                h1, h2 = (batch.column(c)[k].values.to_numpy().view(np.uint64) for c in (1, 2))
                shard = (h1 >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h1), np.int32)
                at = np.flatnonzero(np.diff(shard, prepend=-1))
                flat = np.stack([h1, h2], axis=1)
                ends = [*at[1:].tolist(), len(h1)]
                probes = [flat[a:b].tobytes() for a, b in zip(at.tolist(), ends, strict=True)] if len(h1) else []
                yield pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array([block] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(probes, pa.binary())], ["shard", "block", "first", "probes"])

    return held.select("block", "h1", "h2").mapInArrow(run, "shard int, block bigint, first int, probes binary")


def answers(shards: DataFrame, probes: DataFrame) -> DataFrame:
    """block, key, least: of the probed keys those found in two documents, by their place in the block's list."""
    fields = [c.split()[0] for c in SHARD.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shard = None
        for batch in batches:
            col = {c: batch.column(c) for c in batch.schema.names}
            of, block, first = (col[c].to_pylist() for c in ("shard", "block", "first"))
            begin = 0
            while begin < len(of):
                if block[begin] is None:  # a shard; the probes that follow are of it
                    now, shard = of[begin], Shard(*(col[c][begin].as_py() for c in fields))
                    begin += 1
                    continue
                end = begin
                while end < len(of) and block[end] is not None and of[end] == of[begin]:
                    end += 1
                if of[begin] != now:
                    raise ValueError("probes without their shard")
                mine = col["probes"].slice(begin, end - begin).to_pylist()
                keys = np.frombuffer(b"".join(mine), np.uint64).reshape(-1, 2)
                m = np.array([len(x) // 16 for x in mine])
                key = ranges(np.array(first[begin:end]), m)
                count, least = shard.find(keys)
                found = count > 1
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(block[begin:end]), m)[found], pa.int64()), pa.array(key[found], pa.int32()), pa.array(least[found], pa.int64())], ["block", "key", "least"])
                begin = end

    both = shards.unionByName(probes, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first())
    return both.mapInArrow(run, "block bigint, key int, least bigint")


def resolved(held: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, th, n_lines, sha, keep: one row per document; keep has a flag per line, and is null where all stay."""
    told = found.groupBy("block").agg(F.collect_list(F.struct("key", "least")).alias("told")).withColumnRenamed("block", "_b")
    both = held.join(told, F.col("block") == F.col("_b"), "left").select("ids", "ths", "shas", "lines", "owner", "at", "which", "told")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, ths, shas, lines, owner, at, which = (batch.column(c)[k].values for c in range(7))
                n = lines.to_numpy().astype(np.int64)
                keep = [None] * len(n)
                if (told := batch.column(7)[k]).is_valid:
                    own, line, key = (x.to_numpy().astype(np.int64) for x in (owner, at, which))
                    limit = np.full(int(key.max()) + 1, np.iinfo(np.int64).max)
                    limit[told.values.field("key").to_numpy()] = told.values.field("least").to_numpy()
                    doc = np.where(ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), np.iinfo(np.int64).min)
                    gone = np.flatnonzero(limit[key] < doc[own])
                    of, begin = np.unique(own[gone], return_index=True)
                    for d, rows in zip(of.tolist(), np.split(gone, begin)[1:], strict=True):
                        keep[d] = np.ones(n[d], bool)
                        keep[d][line[rows]] = False
                yield pa.RecordBatch.from_arrays([ids, ths, lines, shas, pa.array(keep, pa.list_(pa.bool_()))], ["doc_id", "th", "n_lines", "sha", "keep"])

    return both.mapInArrow(run, "doc_id bigint, th bigint, n_lines int, sha string, keep array<boolean>")


def settled(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_lines, sha, keep for ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    held = stored(blocks(docs.select("doc_id", F.xxhash64("text").alias("th"), "text")))
    counts = stored(counted(held))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(0, (max(-(-counts.count() // SHARD_KEYS), least) - 1).bit_length())
    shards = stored(index(counts, bits))
    return stored(resolved(held, stored(answers(shards, packs(held, bits)))))


def kept(text: Column, keep: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: F.get(keep, i)), "\n")


def _changed(rows: DataFrame) -> DataFrame:
    """The documents that lose lines; those of one doc_id and text, which lose the same lines, once."""
    return rows.where("keep is not null").select(F.col("doc_id").alias("lost_id"), F.col("th").alias("lost_th"), F.col("n_lines").alias("lost_of"), "keep").dropDuplicates(["lost_id", "lost_th"])


def op12(docs: DataFrame) -> DataFrame:
    rows = settled(docs)
    whole = rows.where("keep is null").select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped"), F.col("sha").alias("kept_sha256"))
    named = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    both = named.join(_changed(rows).hint("merge"), (F.col("doc_id") == F.col("lost_id")) & (F.col("th") == F.col("lost_th")))
    gone = F.size("keep") - F.size(F.filter("keep", lambda x: x))
    cut = both.select("doc_id", F.col("lost_of").cast("bigint").alias("n_lines"), gone.cast("bigint").alias("n_dropped"), F.sha2(kept(F.col("text"), F.col("keep")), 256).alias("kept_sha256"))
    return whole.unionByName(cut)


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines out of ``text``; texts that lose none stay as they are."""
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    out = packed.join(_changed(settled(docs)).hint("merge"), (F.col("id") == F.col("lost_id")) & (F.col("hash") == F.col("lost_th")), "left")
    text = F.when(F.col("keep").isNotNull(), kept(F.col("row.text"), F.col("keep"))).otherwise(F.col("row.text"))
    return out.select(F.col("row").withField("text", text).alias("row")).select("row.*")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
s AS (SELECT k.*, coalesce(m.least < doc_id, false) AS gone FROM k LEFT JOIN m USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM s GROUP BY rid
"""
