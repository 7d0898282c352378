"""Vectors by content: a stored cache in front of an embedding service, and a dense index of cells.

Cache: vectors are kept by model and by the hash of the text they were made of.  The service is asked once for each different text that is not
there, and what it gave is appended as one named batch, so a second build, or a repeated question, asks for nothing.  What a service counts (requests,
retries) travels with its rows and is summed from the table that was committed, so tasks that ran twice count once.

Dense index: a coarse quantiser (k-means by cosine, fitted on about ``SAMPLE_PER_CELL`` vectors for each cell, those of least hash) covers
every row; vectors lie in one folder per cell, and a search reads the folders of the cells nearest to its queries: as many as hold ``TARGET`` of the
exact hits of ``CALIBRATED`` of the vectors, asked when the index is built.  Below ``LEAST_PER_CELL`` rows
for each cell the index keeps one cell and is exact."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import retrieval as R
from .best import Best, Vectors
from .stores import Log

Embed = Callable[[DataFrame], DataFrame]
CACHED = "hash string, vector array<float>"


@dataclass
class Served:
    """Texts asked for, those whose vector was there, different texts sent to the service, and what that took."""

    texts: int = 0
    hits: int = 0
    sent: int = 0
    requests: int = 0
    retries: int = 0


class Cached:
    """An embedder (pk, canonical) to (pk, vector) that asks ``embed`` only for texts that the cache under ``root`` has not."""

    def __init__(self, spark: SparkSession, root: str, model: str, embed: Embed):
        self.embed, self.served = embed, Served()
        self.log = Log(spark, f"{root.rstrip('/')}/{hashlib.sha256(model.encode()).hexdigest()[:32]}", CACHED)

    @property
    def report(self) -> dict[str, int]:
        return {f"vector_{k}": v for k, v in asdict(self.served).items()}

    def __call__(self, rows: DataFrame) -> DataFrame:
        named = written(rows.select("pk", "canonical", F.sha2(F.coalesce("canonical", F.lit("")), 256).alias("hash")), "asked")
        known = self.log.read().groupBy("hash").agg(F.first("vector").alias("vector"))
        here = written(named.select("hash").distinct().join(known, "hash"), "known")
        # a text goes under the least of its keys
        sent = written(named.join(here, "hash", "left_anti").groupBy("hash").agg(F.min(F.struct("pk", "canonical")).alias("x")).select("hash", "x.pk", "x.canonical"), "sent")
        n = sent.count()
        every = here
        if n:
            got = written(self.embed(sent.select("pk", "canonical")), "vectors")
            fresh = sent.select("hash", "pk").join(got.select("pk", F.col("vector").cast("array<float>").alias("vector")), "pk").select("hash", "vector").where("vector is not null")
            self.log.append(fresh)
            every = here.unionByName(fresh)
            cost = [c for c in ("requests", "retries") if c in got.columns]
            if cost:
                for c, v in got.agg(*[F.sum(c).alias(c) for c in cost]).first().asDict().items():
                    setattr(self.served, c, getattr(self.served, c) + int(v or 0))
        total = named.count()
        self.served.texts += total
        self.served.sent += n
        self.served.hits += named.join(here, "hash", "left_semi").count()
        return named.select("pk", "hash").join(every, "hash").select("pk", "vector")

    def queries(self, rows: DataFrame) -> DataFrame:
        """The same for questions: (query_id, query) to (query_id, vector)."""
        return self(rows.select(F.col("query_id").alias("pk"), F.col("query").alias("canonical"))).withColumnRenamed("pk", "query_id")


# ---- dense index ----
SAMPLE_PER_CELL, LEAST_PER_CELL, MOST_CELLS = 256, 39, 4096
#: Vectors that are asked of a new index, and the share of their exact hits that the cells read by a search must hold.
CALIBRATED, TARGET = 64, 0.95
CELLS = "cell int, centre array<double>"


def build(vectors: DataFrame, path: str, cells: int | None = None, seed: int = 1) -> int:
    """``vectors``: pk, vector.  Write the index under ``path``; returns the number of cells.  Rows without a vector, or with one of length zero, are no hits and are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = vectors.where("vector is not null").withColumn("_l", length).where("_l > 0").select("pk", "vector")
    n = rows.count()
    cells = min(MOST_CELLS, cells or max(1, int(n**0.5)))
    if n < LEAST_PER_CELL * cells:
        cells = 1
    if cells == 1:
        rows.withColumn("cell", F.lit(0)).write.partitionBy("cell").parquet(f"{path}/vectors")
        spark.createDataFrame([(0, [0.0])], CELLS).coalesce(1).write.parquet(f"{path}/cells")
        spark.createDataFrame([(1,)], "take int").coalesce(1).write.parquet(f"{path}/probes")
        return 1
    plain = rows.withColumn("features", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
    share = int(2**30 * min(1.0, SAMPLE_PER_CELL * cells / n))
    sample = written(rows.where(F.pmod(F.xxhash64("pk"), F.lit(2**30)) < share), "sample").withColumn("features", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
    model = KMeans(k=cells, seed=seed, maxIter=15, distanceMeasure="cosine", predictionCol="cell").fit(sample)
    model.transform(plain).select("pk", "vector", "cell").repartition("cell", F.pmod(F.xxhash64("pk"), F.lit(max(1, n // (cells * 1_000_000))))).write.partitionBy("cell").parquet(f"{path}/vectors")
    centres = [(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())]
    spark.createDataFrame(centres, CELLS).coalesce(1).write.parquet(f"{path}/cells")
    asked = written(sample.orderBy(F.xxhash64("pk"), "pk").limit(CALIBRATED).selectExpr("pk as query_id", "vector"), "asked")
    take = _enough(rows, asked, spark.read.schema("pk bigint, cell int").parquet(f"{path}/vectors"), dict(centres))
    spark.createDataFrame([(take,)], "take int").coalesce(1).write.parquet(f"{path}/probes")
    return len(centres)


def _enough(rows: DataFrame, asked: DataFrame, placed: DataFrame, centres: dict[int, list[float]]) -> int:
    """Of how many nearest cells the exact hits of ``asked`` are found in, but for the share that may be missed."""
    exact = R.dense_route(rows, asked).select("query_id", "pk")
    hits = placed.join(F.broadcast(exact), "pk").select("query_id", "cell").collect()  # of few vectors
    names, points = list(centres), np.array(list(centres.values()))
    points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    order = {r.query_id: np.argsort(-(points @ np.array(r.vector)), kind="stable") for r in asked.collect()}
    rank = {q: {names[c]: k for k, c in enumerate(o)} for q, o in order.items()}
    needed = np.sort([rank[h.query_id][h.cell] for h in hits])
    return int(needed[max(0, int(np.ceil(TARGET * len(needed))) - 1)]) + 1 if len(needed) else len(names)


class Dense:
    """A dense index opened once; its centres, at most ``MOST_CELLS``, are held."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.cells = {r.cell: np.array(r.centre) for r in spark.read.schema(CELLS).parquet(f"{path}/cells").collect()}
        self.take = spark.read.schema("take int").parquet(f"{path}/probes").first().take

    def near(self, vectors: np.ndarray, probed: float | None = None) -> np.ndarray:
        """For each of the vectors, which cells it reads: its nearest, as many as the index was built to read, or a share of all."""
        take = self.take if probed is None else max(1, round(probed * len(self.cells)))
        if take >= len(self.cells):
            return np.ones((len(vectors), len(self.cells)), bool)
        points = np.array(list(self.cells.values()))
        points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
        reads = np.zeros((len(vectors), len(points)), bool)
        np.put_along_axis(reads, np.argsort(-(vectors @ points.T), axis=1, kind="stable")[:, :take], True, axis=1)
        return reads

    def search(self, queries: DataFrame, pool: int = R.POOL, probed: float | None = None) -> DataFrame:
        """``queries``: query_id, vector.  query_id, pk, score, rank, as ``retrieval.dense_route`` gives them over the cells that are read."""
        q = queries.select("query_id", "vector").where("vector is not null")
        blocks = R.query_blocks(q)
        if blocks <= 1:
            return R.ranked(self._hits(q, pool, probed), pool)
        held = written(q.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "queries")
        parts = [written(R.ranked(self._hits(held.where(F.col("_block") == k).drop("_block"), pool, probed), pool), "hits") for k in range(blocks)]
        return reduce(DataFrame.unionByName, parts)

    def _hits(self, q: DataFrame, pool: int, probed: float | None) -> DataFrame:
        asked, names = Vectors(q.toArrow()), list(self.cells)
        reads = np.zeros((len(asked.ids), len(names)), bool)
        for dim, (at, m, _) in asked.by.items():
            # the one cell of an exact index has no centre
            reads[at] = self.near(m, probed) if len(names) > 1 and dim == len(self.cells[names[0]]) else len(names) == 1
        wanted = [c for c, some in zip(names, reads.any(axis=0), strict=True) if some]
        bits, place = np.packbits(reads, axis=0), {c: k for k, c in enumerate(names)}
        count = len(asked.ids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Best(count, pool, R.DIGITS)
            for batch in batches:
                cell = batch.column(2).to_numpy()
                for c in np.unique(cell).tolist():
                    own = np.flatnonzero(cell == c)
                    some = np.unpackbits(bits[:, place[c]], count=count).astype(bool)
                    asked.best(found, batch.column(0).to_numpy()[own], batch.column(1).take(pa.array(own)), some)
            yield found.batch(asked.ids)

        rows = self.spark.read.schema("pk bigint, vector array<float>, cell int").parquet(f"{self.path}/vectors").where(F.col("cell").isin(*wanted))
        return rows.mapInArrow(run, f"query_id {R.asked_kind(q)}, pk bigint, score double").withColumn("score", F.round("score", R.DIGITS))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the mean share of each one's exact hits that were found."""
    hits = exact.select("query_id", "pk").join(found.select("query_id", "pk", F.lit(1).alias("_f")), ["query_id", "pk"], "left")
    return hits.groupBy("query_id").agg(F.avg(F.coalesce("_f", F.lit(0))).alias("r")).agg(F.count(F.lit(1)).alias("queries"), F.avg("r").alias("recall"))
