"""A stored inverted index with block maxima: a search reads only the blocks that can hold one of its best hits.

Chunks are dealt out to parts of bounded size, put in order of length there and cut into windows of ``WINDOW``; the postings of a term
in a window are one block.  A block's head tells how many postings it has, the greatest frequency and the least length among them, from
which the most that it adds to a score follows under any counts of the corpus.  Heads lie in columns of their own, so they are read
without the postings.  The task that cuts a part writes its blocks, in order of term and window, in folders by bucket of terms, so the
terms and windows asked for select folders, row groups and pages; only texts are shuffled, once, and neither counts nor postings.

A search adds up the heads of its terms by window, scores the windows of highest bound, takes the score of the last of the best hits found
there as a threshold, and then scores the windows whose bound reaches it.  All others cannot hold a hit, so results equal the full
sum.  For a few questions whose heads are few the driver holds the heads and adds up the postings of the chosen windows, so that a search
is two or three scans without a shuffle; beyond ``HEADS`` and ``HELD_POSTINGS`` the same steps are joins.

An index is made of segments (one, if it was written by ``build``); counts are sums over segments, and postings that a later
segment has replaced are left out where they are read."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import text as T
from ..sources.scratch import written
from . import retrieval as R
from .best import Best, Questions

#: Chunks of a window, as a power of two; postings whose terms are counted in a file.
WINDOW_BITS = 6
FILE_POSTINGS = 4_000_000
#: Bytes of text whose windows one task cuts; a small input has up to ``SMALL_PARTS`` parts of fewer, of so many chunks.
PART_BYTES, SMALL_PARTS, ROWS_PER_PART = 16_000_000, 8, 4096
#: Chunks whose blocks are made together, and blocks of a batch.
ROWS_CUT, BLOCKS_SENT = 512, 10_000
#: Pairs of a question and a term that the driver holds and spells out in filters, and windows that are spelt out.
PUSHED, WINDOWS_SPELT = 2000, 2000
#: Heads of blocks, and postings of the windows to be scored, that the driver holds for a search; replaced keys that it holds for an index.
HEADS, HELD_POSTINGS, HELD_DEAD = 500_000, 500_000, 200_000
#: Replaced keys that are sent to where rows and postings lie, instead of moving these.
SENT_DEAD = 1_000_000
#: Windows that are scored for the threshold, at least, and how many chunks they hold for each hit wanted.
SEEDS, SEED_CHUNKS = 3, 2
#: Scores are rounded; a window is left out only if its bound is below the threshold by more than this.
SLACK = 2e-6
#: Columns of a chunk that are kept with its postings, for filters.
CARRIED = ("kind", "mode", "version")
Tokens = Callable[[Column], Column]
HEAD = "term string, window bigint, n int, most_tf int, least_length int"
SCHEMA = f"{HEAD}, pks array<bigint>, tfs array<int>, lengths array<int>, kinds array<string>, modes array<string>, versions array<string>, bucket int"


def bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def among(column: str, values: list) -> Column:
    """One of the values; as equalities where these are few, since the reader takes a long list for the range that it spans."""
    shown = [f"'{v.translate(ESCAPES)}'" if isinstance(v, str) else str(v) for v in values]
    if 10 < len(shown) <= 200:
        return F.expr(" or ".join(f"{column} = {v}" for v in shown))
    return F.expr(f"{column} in ({', '.join(shown)})")


#: In a literal of a statement.
ESCAPES = str.maketrans({"\\": "\\\\", "'": "\\'"})


@dataclass
class Written:
    """What a segment holds: chunks, the sum of their lengths, postings, windows at most, and buckets."""

    chunks: int
    length: int
    postings: int
    windows: int
    buckets: int


def tokenised(chunks: DataFrame, text: str = "text", tokens: Tokens = T.tokens) -> DataFrame:
    """pk, length, terms and what is carried: one row per chunk."""
    carried = [F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in CARRIED]
    return chunks.select("pk", *carried, tokens(F.col(text)).alias("terms")).select("pk", *CARRIED, F.size("terms").alias("length"), "terms")


def write(chunks: DataFrame, path: str, text: str = "text", buckets: int | None = None, terms: DataFrame | None = None, lost: DataFrame | None = None, tokens: Tokens = T.tokens) -> Written:
    """Write the blocks of ``chunks`` and the counts of their terms; the counts are less ``lost`` (term, df), or ``terms`` (term, df) instead."""
    one = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-one.bytes // PART_BYTES), min(SMALL_PARTS, -(-one.chunks // ROWS_PER_PART)))
    buckets = buckets or 1
    own = chunks.select("pk", text, *[c for c in CARRIED if c in chunks.columns]).repartition(parts, "pk")
    # windows are runs of rows of like length; a window lies in one task, which makes its blocks and writes them
    placed = tokenised(own, text, tokens).sortWithinPartitions("length", "pk").withColumn("window", F.shiftright(F.monotonically_increasing_id(), WINDOW_BITS))
    blocks = _cut(placed).withColumn("bucket", bucket(F.col("term"), buckets))
    blocks.sortWithinPartitions("bucket", "term", "window").write.partitionBy("bucket").parquet(f"{path}/blocks")
    blocks = chunks.sparkSession.read.schema(SCHEMA).parquet(f"{path}/blocks")
    tfs = F.aggregate("tfs", F.lit(0).cast("bigint"), lambda a, x: a + x)
    sums = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.coalesce(F.sum(tfs), F.lit(0)).alias("length")).first()
    if terms is None:
        terms = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        if lost is not None:
            terms = terms.unionByName(lost.select("term", (-F.col("df")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    files = max(1, -(-sums.postings // FILE_POSTINGS))
    terms.select("term", F.col("df").cast("bigint").alias("df")).repartitionByRange(files, "term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    return Written(one.chunks, sums.length, sums.postings, -(-one.chunks >> WINDOW_BITS) + parts, buckets)


def sent(dead: DataFrame, rows: int) -> DataFrame:
    """Replaced keys, sent to where rows and postings lie unless they are too many."""
    return F.broadcast(dead) if rows <= SENT_DEAD else dead


def _cut(placed: DataFrame) -> DataFrame:
    """``placed``: rows of ``tokenised`` with their window, the rows of a window one after the other.  The blocks: of each window and term the postings by key."""
    schema = SCHEMA.removesuffix(", bucket int")
    types = to_arrow_schema(_parse_datatype_string(schema))

    def blocks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks().sort_by([("window", "ascending"), ("pk", "ascending")])
        lists = rows.column("terms").combine_chunks()
        own = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy().astype(np.int64))
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return
        window, length = rows.column("window").to_numpy(), rows.column("length").to_numpy()
        # terms are counted by row, and then in order of window and term
        key, tf = np.unique(own * len(coded.dictionary) + coded.indices.to_numpy().astype(np.int64), return_counts=True)
        own, term = np.divmod(key, len(coded.dictionary))
        by = np.lexsort((own, term, window[own]))
        own, term, tf = own[by], term[by], tf[by]
        at = window[own]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 0) | (np.diff(term) != 0))))
        n = np.diff(np.concatenate((first, [len(own)])))
        offsets, places = pa.array(np.concatenate((first, [len(own)])).astype(np.int32)), pa.array(own)
        listed = lambda x, f: pa.ListArray.from_arrays(offsets, x.cast(f.type.value_type))
        head = [coded.dictionary.take(pa.array(term[first])), pa.array(at[first]), pa.array(n), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(length[own], first))]
        columns = [x.cast(f.type) for x, f in zip(head, types, strict=False)]
        columns += [listed(x, f) for x, f in zip([rows.column("pk").combine_chunks().take(places), pa.array(tf), pa.array(length[own]), *(rows.column(c).combine_chunks().take(places) for c in CARRIED)], list(types)[5:], strict=True)]
        out = pa.RecordBatch.from_arrays(columns, schema=types)
        for k in range(0, out.num_rows, BLOCKS_SENT):
            yield out.slice(k, BLOCKS_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            window = rows.column("window").to_numpy()
            whole = int(np.searchsorted(window, window[-1])) if len(window) else 0
            for k in _runs(window[:whole]):
                yield from blocks(rows.slice(k[0], k[1] - k[0]))
            held = rows.slice(whole)
        if held is not None and held.num_rows:
            yield from blocks(held)

    return placed.select("pk", "length", "window", "terms", *CARRIED).mapInArrow(run, schema)


def _runs(window: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of whole windows, of ``ROWS_CUT`` rows or little more."""
    a = 0
    while a < len(window):
        b = int(np.searchsorted(window, window[min(a + ROWS_CUT, len(window) - 1)]))
        b = len(window) if a + ROWS_CUT >= len(window) else b
        yield a, b
        a = b


def build(chunks: DataFrame, path: str, text: str = "text", buckets: int | None = None, tokens: Tokens = T.tokens) -> None:
    """An index of one segment under ``path``; it is to be opened with the same ``tokens``."""
    w = write(chunks, path, text, buckets, tokens=tokens)
    chunks.sparkSession.createDataFrame([(w.chunks, w.length, w.postings, w.windows, w.buckets)], "chunks bigint, length bigint, postings bigint, windows bigint, buckets int").coalesce(1).write.parquet(f"{path}/stats")


@dataclass
class Segment:
    path: str
    seq: int
    windows: int
    buckets: int


class Asked(NamedTuple):
    query_id: object
    term: str


@dataclass
class Reads:
    """Postings of the terms asked for, and those that were read."""

    postings: int = 0
    read: int = 0


class Stored:
    """An index opened once: what was current then stays what is searched.  ``dead``: pk, seq of postings replaced by a segment of that number."""

    def __init__(self, spark: SparkSession, path: str | None = None, segments: list[Segment] | None = None, stats: R.Bm25Stats | None = None, dead: DataFrame | None = None, dead_rows: int = 0, tokens: Tokens = T.tokens):
        self.tokens = tokens
        self.spark, self.dead, self.dead_rows = spark, dead, dead_rows
        if segments is None:
            row = spark.read.parquet(f"{path}/stats").first()
            segments, stats = [Segment(path, 0, row.windows, row.buckets)], R.Bm25Stats(row.chunks, row.length / row.chunks if row.length else 1.0)
        self.segments, self.stats = segments, stats
        self.reads = Reads()
        self._gone: tuple[np.ndarray, np.ndarray] | None = None
        self._tables: dict[tuple[str, str], DataFrame] = {}

    def _alive(self, pk: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Which postings no later segment has replaced."""
        if self.dead is None:
            return np.ones(len(pk), bool)
        if self._gone is None:
            got = self.dead.orderBy("pk").toArrow()
            self._gone = got.column("pk").to_numpy(), got.column("seq").to_numpy()
        keys, last = self._gone
        at = np.minimum(np.searchsorted(keys, pk), len(keys) - 1)
        return ~((keys[at] == pk) & (seq < last[at]))

    def _opened(self, path: str, schema: str) -> DataFrame:
        """A table of the index, whose files are listed once."""
        if (path, schema) not in self._tables:
            self._tables[path, schema] = self.spark.read.schema(schema).parquet(path)
        return self._tables[path, schema]

    # ---- parts of a search, as plans ----
    def _blocks(self, terms: list[str] | DataFrame, schema: str = SCHEMA, windows: dict[int, list[int]] | None = None) -> DataFrame:
        """Blocks of the terms, with the number of their segment; of some windows of each segment, if these are given."""
        parts = []
        for s in self.segments:
            if windows is not None and not windows.get(s.seq):
                continue
            df = self._opened(f"{s.path}/blocks", schema if "bucket" in schema else f"{schema}, bucket int")
            if isinstance(terms, list):
                of = self._buckets(terms, s.buckets)
                df = df.where(among("bucket", of) & among("term", terms)) if terms else df.where("false")
            else:
                df = df.join(terms.select("term", bucket(F.col("term"), s.buckets).alias("bucket")), ["bucket", "term"], "left_semi")
            if windows is not None and len(windows[s.seq]) <= WINDOWS_SPELT:
                df = df.where(among("window", windows[s.seq]))
            parts.append(df.drop("bucket").withColumn("seq", F.lit(s.seq)))
        empty = self.spark.createDataFrame([], f"{schema.removesuffix(', bucket int')}, seq int")
        return reduce(DataFrame.unionByName, parts) if parts else empty

    def _buckets(self, terms: list[str], buckets: int) -> list[int]:
        if buckets == 1 or not terms:
            return [0]
        hashed = F.array_distinct(F.transform(F.array(*map(F.lit, terms)), lambda t: bucket(t, buckets)))
        return self.spark.range(1).select(hashed.alias("b")).first().b

    def _df(self, terms: list[str] | DataFrame) -> DataFrame:
        """term, df over all segments."""
        parts = [self._opened(f"{s.path}/terms", "term string, df bigint") for s in self.segments]
        every = reduce(DataFrame.unionByName, parts)
        every = every.where(among("term", terms)) if isinstance(terms, list) else every.join(terms.select("term"), "term", "left_semi")
        return every.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _postings(self, blocks: DataFrame, keep: Column | None, live: bool = True) -> DataFrame:
        """term, seq, window, pk, tf, length of postings, by default of live ones; ``keep`` looks at kind, mode and version."""
        names = ["pks", "tfs", "lengths", *(f"{c}s" for c in CARRIED if keep is not None)]
        out = blocks.select("term", "seq", "window", F.explode(F.arrays_zip(*names)).alias("x")).select("term", "seq", "window", *[F.col(f"x.{c}").alias(c[:-1]) for c in names])
        if keep is not None:
            out = out.where(keep)
        if live and self.dead is not None:
            gone = self.dead.select(F.col("pk").alias("_pk"), F.col("seq").alias("_seq"))
            out = out.join(sent(gone, self.dead_rows), (F.col("pk") == F.col("_pk")) & (F.col("seq") < F.col("_seq")), "left_anti")
        return out

    def _scores(self, postings: DataFrame, asked: DataFrame, rows: int, wanted: DataFrame | None = None) -> DataFrame:
        """``asked``: query_id, term, df; ``wanted``: query_id, seq, window, if not all are.  query_id, pk, score."""
        met = postings.join(R.small(asked, rows), "term")
        if wanted is not None:
            met = met.join(wanted, ["query_id", "seq", "window"], "left_semi")
        return met.groupBy("query_id", "pk").agg(F.round(F.sum(R.impact(self.stats)), R.DIGITS).alias("score"))

    def _asked(self, queries: DataFrame, expand: bool) -> list[Asked]:
        """The query terms of a few queries, more than ``PUSHED`` of them if there are more; of a local table Spark answers this without a job."""
        own = queries.withColumn("query", R.expanded(F.col("query"))) if expand else queries
        rows = own.select("query_id", F.array_distinct(self.tokens(F.col("query"))).alias("terms")).limit(PUSHED + 1).collect()
        return [Asked(r.query_id, t) for r in rows for t in r.terms] if len(rows) <= PUSHED else [Asked(None, "")] * (PUSHED + 1)

    # ---- searches ----
    def scores(self, queries: DataFrame, expand: bool = False, keep: Column | None = None) -> DataFrame:
        """query_id, pk, score of every chunk with a term of the query: the full sum."""
        wanted = R.query_terms(queries, expand, self.tokens)
        held = self._asked(queries, expand)
        if len(held) > PUSHED:
            rows = wanted.count()
            terms = wanted.select("term").distinct()
            return self._scores(self._postings(self._blocks(terms), keep), wanted.join(self._df(terms), "term"), rows)
        terms = sorted({r.term for r in held})
        return self._scores(self._postings(self._blocks(terms), keep), wanted.join(F.broadcast(self._df(terms)), "term"), len(held))

    def search(self, queries: DataFrame, pool: int | None = R.POOL, expand: bool = False, keep: Column | None = None) -> DataFrame:
        """query_id, pk, score, rank: the best ``pool`` of each query, as ``retrieval.sparse_route`` gives them over the same chunks."""
        if pool is None:
            return R.ranked(self.scores(queries, expand, keep), None)
        wanted = R.query_terms(queries, expand, self.tokens)
        held = self._asked(queries, expand)
        terms = sorted({r.term for r in held})
        if len(held) > PUSHED or len(terms) * sum(s.windows for s in self.segments) > HEADS:
            return self._joined(wanted, pool, keep)
        return self._held(held, terms, wanted.schema["query_id"].dataType, pool, keep)

    def _held(self, held: list, terms: list[str], kind, pool: int, keep: Column | None) -> DataFrame:
        """With the heads of the blocks on the driver."""
        empty = self.spark.createDataFrame([], "query_id bigint, pk bigint, score double, rank bigint").withColumn("query_id", F.col("query_id").cast(kind))
        if not terms:
            return empty
        heads = self._blocks(terms, HEAD).select("term", "seq", "window", "n", "most_tf", "least_length").toArrow()
        one = len(self.segments) == 1 and self.dead is None
        col = {c: heads.column(c).to_numpy(zero_copy_only=False) for c in heads.schema.names}
        at = {t: i for i, t in enumerate(terms)}
        term = np.array([at[t] for t in col["term"].tolist()], np.int64)
        df = np.bincount(term, col["n"], len(terms)).astype(np.int64)
        if not one:
            df = np.zeros(len(terms), np.int64)
            for r in self._df(terms).collect():
                df[at[r.term]] = r.df
        if not df.any():
            return empty
        idf = np.log(1.0 + (self.stats.n - df + 0.5) / (df + 0.5))
        tf, length = col["most_tf"].astype(float), col["least_length"].astype(float)
        bound = idf[term] * tf * (R.K1 + 1.0) / (tf + R.K1 * (1.0 - R.B + R.B * length / self.stats.mean_length))
        place, where = np.unique(np.stack([col["seq"].astype(np.int64), col["window"]]), axis=1, return_inverse=True)
        where = where.reshape(-1)
        held = [r for r in held if df[at[r.term]] > 0]
        ids = sorted({r.query_id for r in held}, key=repr)
        asks = defaultdict(list)
        for r in held:
            asks[r.query_id].append(at[r.term])
        by_term = np.argsort(term, kind="stable")
        first = np.searchsorted(term[by_term], np.arange(len(terms) + 1))
        tops, chunks = {}, np.zeros(place.shape[1])
        np.maximum.at(chunks, where, col["n"])
        for q in ids:
            own = np.concatenate([by_term[first[t] : first[t + 1]] for t in asks[q]])
            tops[q] = np.bincount(where[own], bound[own], place.shape[1])
        used = np.zeros(len(term), bool)

        def scored(picks: dict) -> list[tuple]:
            """query_id, pk, score of the best hits of each query in its windows."""
            every = np.unique(np.concatenate(list(picks.values())))
            windows = defaultdict(list)
            for k in every.tolist():
                windows[int(place[0, k])].append(int(place[1, k]))
            blocks = self._blocks(terms, windows=windows)
            postings = 0
            for q, own in picks.items():
                mask = np.zeros(place.shape[1], bool)
                mask[own] = True
                for t in asks[q]:
                    rows = by_term[first[t] : first[t + 1]]
                    rows = rows[mask[where[rows]]]
                    used[rows] = True
                    postings += int(col["n"][rows].sum())
            if postings <= HELD_POSTINGS and len(every) * len(terms) <= HEADS and len(picks) <= 20 and (self.dead is None or self.dead_rows <= HELD_DEAD):
                return self._added_up(self._postings(blocks, keep, live=False), {q: ([terms[t] for t in asks[q]], place[:, own]) for q, own in picks.items()}, dict(zip(terms, idf.tolist(), strict=True)), pool)
            rows = [(q, int(place[0, k]), int(place[1, k])) for q, own in picks.items() for k in own.tolist()]
            pairs = R.small(self.spark.createDataFrame(rows, f"query_id {kind.simpleString()}, seq int, window bigint"), len(rows))
            asked = self.spark.createDataFrame([(r.query_id, r.term, int(df[at[r.term]])) for r in held], f"query_id {kind.simpleString()}, term string, df bigint")
            return [(r.query_id, r.pk, r.score) for r in R.ranked(self._scores(self._postings(blocks, keep), asked, len(held), pairs), pool).collect()]

        seeds = {}
        for q in ids:
            order = np.argsort(-tops[q], kind="stable")
            enough = int(np.searchsorted(np.cumsum(chunks[order]), SEED_CHUNKS * pool)) + 1
            order = order[: max(SEEDS, enough)]
            seeds[q] = order[tops[q][order] > 0]
        found = defaultdict(list)
        for q, pk, score in scored(seeds):
            found[q].append((-score, pk))
        rest = {}
        for q in ids:
            least = -max(s for s, _ in found[q]) if len(found[q]) >= pool else 0.0
            more = np.flatnonzero((tops[q] > 0) & (tops[q] >= least - SLACK))
            more = np.setdiff1d(more, seeds[q])
            if len(more):
                rest[q] = more
        if rest:
            for q, pk, score in scored(rest):
                found[q].append((-score, pk))
        self.reads = Reads(int(col["n"].sum()), int(col["n"][used].sum()))
        rows = [(q, pk, -s, k) for q, v in found.items() for k, (s, pk) in enumerate(sorted(v)[:pool], 1)]
        return self.spark.createDataFrame(rows, f"query_id {kind.simpleString()}, pk bigint, score double, rank bigint") if rows else empty

    def _added_up(self, postings: DataFrame, picks: dict, idf: dict[str, float], pool: int) -> list[tuple]:
        """The scores of few postings, on the driver.  ``picks``: the terms of each query, and the (seq, window) columns that it looks at."""
        got = postings.select("term", "seq", "window", "pk", "tf", "length").toArrow()
        term = np.array(got.column("term").to_pylist(), object)
        seq, window, pk, tf, length = (got.column(c).to_numpy() for c in ("seq", "window", "pk", "tf", "length"))
        live = self._alive(pk, seq)
        norm = tf + R.K1 * (1.0 - R.B + R.B * length / self.stats.mean_length)
        out = []
        for q, (own, places) in picks.items():
            wanted = {(int(a), int(b)) for a, b in places.T.tolist()}
            rows = np.flatnonzero(live & np.array([t in own for t in term.tolist()], bool) & np.array([p in wanted for p in zip(seq.tolist(), window.tolist(), strict=True)], bool))
            impact = np.array([idf[t] for t in term[rows].tolist()]) * tf[rows] * (R.K1 + 1.0) / norm[rows]
            keys, which = np.unique(pk[rows], return_inverse=True)
            score = np.floor(np.bincount(which, impact, len(keys)) * 10**R.DIGITS + 0.5) / 10**R.DIGITS
            best = np.lexsort((keys, -score))[:pool]
            out += [(q, int(keys[k]), float(score[k])) for k in best]
        return out

    def _joined(self, wanted: DataFrame, pool: int, keep: Column | None) -> DataFrame:
        """With the heads of the blocks in a table."""
        wanted = written(wanted, "asked")
        rows = wanted.count()
        terms = wanted.select("term").distinct()
        asked = written(wanted.join(self._df(terms), "term").select("query_id", "term", "df"), "asked")
        heads = self._blocks(terms, HEAD).select("term", "seq", "window", "n", F.col("most_tf").alias("tf"), F.col("least_length").alias("length"))
        tops = heads.join(R.small(asked, rows), "term").groupBy("query_id", "seq", "window").agg(F.sum(R.impact(self.stats)).alias("top"), F.max("n").alias("chunks"))
        tops = written(tops, "bounds")
        by = Window.partitionBy("query_id").orderBy(F.desc("top"), "seq", "window")
        placed = tops.withColumn("no", F.row_number().over(by)).withColumn("before", F.sum("chunks").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("chunks"))
        seeds = placed.where((F.col("no") <= SEEDS) | (F.col("before") < SEED_CHUNKS * pool)).select("query_id", "seq", "window")
        first = written(seeds, "seeds")
        if rows <= R.QUERY_TERMS:
            hits = self._met(asked, terms, pool, keep)
        else:
            postings = lambda some: self._postings(self._blocks(terms).join(some.select("seq", "window").distinct(), ["seq", "window"], "left_semi"), keep)
            hits = lambda some: self._scores(postings(some), asked, rows, some)
        found = written(R.ranked(hits(first), pool), "found")
        least = found.where(F.col("rank") == pool).select("query_id", F.col("score").alias("least"))
        more = tops.join(least, "query_id", "left").where(F.col("top") >= F.coalesce("least", F.lit(0.0)) - SLACK)
        on = ["query_id", "seq", "window"]
        more = written(more.select(*on).join(first, on, "left_anti"), "rest")
        read = _looked_at(heads.select("term", "seq", "window", "n"), asked, first.unionByName(more)).agg(F.sum("n")).first()[0]
        self.reads = Reads(int(heads.agg(F.sum("n")).first()[0] or 0), int(read or 0))
        # the sum of a row is whole where its question looks at the window; elsewhere it may lack terms, and then it is less and cannot be among the best
        every = found.select("query_id", "pk", "score").unionByName(hits(more)).groupBy("query_id", "pk").agg(F.max("score").alias("score"))
        return R.ranked(every, pool)

    def _met(self, asked: DataFrame, terms: DataFrame, pool: int, keep: Column | None) -> Callable[[DataFrame], DataFrame]:
        """From windows (query_id, seq, window) to query_id, pk, score of what can be among the best ``pool`` of each query in them.

        The blocks read are those of a window and a term that one query has and looks at; postings are shuffled by window, and no pairs."""
        held = asked.toArrow()
        questions = Questions(held.select(["query_id", "term"]))
        names = questions.terms.to_pylist()
        of = dict(zip(held.column("term").to_pylist(), held.column("df").to_pylist(), strict=True))
        weigh = R.weights(self.stats, np.array([of[t] for t in names], float))
        places = F.broadcast(self.spark.createDataFrame([(t, k) for k, t in enumerate(names)], "term string, at int"))
        kind = R.asked_kind(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, rest = Best(len(questions.ids), pool, R.DIGITS), None

            def score(rows: np.ndarray) -> None:
                key, row = np.unique(rows[0], return_inverse=True)
                questions.best(best, key, row, rows[1], weigh(rows[1], rows[2], rows[3]))

            for batch in batches:
                rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)])
                rows = rows if rest is None else np.concatenate([rest, rows], axis=1)
                whole = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
                if whole:
                    score(rows[:, :whole])
                rest = rows[:, whole:]
            if rest is not None and rest.shape[1]:
                score(rest)
            yield best.batch(questions.ids)

        def hits(some: DataFrame) -> DataFrame:
            postings = self._postings(_looked_at(self._blocks(terms), asked, some).repartition("seq", "window"), keep)
            if self.dead is not None and self.dead_rows > SENT_DEAD:
                postings = postings.repartition("pk")  # the join with what was replaced has moved them
            rows = postings.join(places, "term").select("pk", "at", "tf", "length").sortWithinPartitions("pk")
            return rows.mapInArrow(run, f"query_id {kind}, pk bigint, score double").withColumn("score", F.round("score", R.DIGITS))

        return hits


def _looked_at(blocks: DataFrame, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """The blocks (or heads) of a window and a term that one question of ``asked`` (query_id, term) has and, by ``pairs`` (query_id, seq, window), looks at."""
    own = asked.groupBy("term").agg(F.collect_set(F.xxhash64("query_id")).alias("_has"))
    windows = pairs.groupBy("seq", "window").agg(F.collect_set(F.xxhash64("query_id")).alias("_looks"))
    return blocks.join(F.broadcast(own), "term").join(windows, ["seq", "window"]).where(F.arrays_overlap("_has", "_looks")).select(*blocks.columns)


def search(spark: SparkSession, path: str, queries: DataFrame, pool: int | None = R.POOL) -> DataFrame:
    """query_id, pk, score, rank, as ``retrieval.sparse_route`` gives them over the same chunks."""
    return Stored(spark, path).search(queries, pool)
