"""An index folder of immutable segments: a change writes what changed, readers keep what they opened, versions can be gone back to.

``manifests/v%08d`` (JSON) names the segments of a version, the tables of replaced keys, counts and settings.  A publication writes its
segment and its tombstones beside what is there and then creates the next manifest, which fails if another writer has created it; so of two
writers that began from one version one is told to begin anew, and nothing of a crash is ever seen.  A row of segment s is live unless a
tombstone of a later number names its key.

Each segment has its rows, its postings with block maxima, and the counts of its terms less those of the rows that it replaced, so that
sums over segments are those of an index built at once.  Later segments are merged once there are over ``MOST_SEGMENTS``, and all is
written anew once what came later is ``FULL_RATIO`` of the first segment.  ``vacuum`` deletes what no kept version names."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import written
from . import postings
from . import retrieval as R
from .errors import IndexMismatch, IndexMissing, VersionConflict

COLUMNS = "pk bigint, content_hash string, text string, kind string, path string, section string, title string, keywords string, mode string, version string, vector array<float>"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
MOST_SEGMENTS, FULL_RATIO = 8, 0.5
#: An index of fewer rows is not written anew for its ratio.
LEAST_ROWS = 1000
ROWS_PER_FILE = 200_000


@dataclass
class Manifest:
    number: int
    segments: list[dict] = field(default_factory=list)
    tombs: list[dict] = field(default_factory=list)
    meta: dict[str, str] = field(default_factory=dict)
    #: What the version wrote, in bytes, and what it did.
    wrote: int = 0
    how: str = ""

    @property
    def name(self) -> str:
        return f"v{self.number:08d}"

    def total(self, what: str) -> int:
        return sum(s[what] for s in self.segments)


class Store:
    """The versions under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self._conf)

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}" if p else self.root)

    def _size(self, p: str) -> int:
        return self.fs.getContentSummary(self._path(p)).getLength() if self.fs.exists(self._path(p)) else 0

    # ---- versions ----
    def versions(self) -> list[int]:
        at = self._path("manifests")
        if not self.fs.exists(at):
            return []
        return sorted(int(n[1:]) for f in self.fs.listStatus(at) if (n := f.getPath().getName()).startswith("v"))

    def manifest(self, number: int | None = None) -> Manifest | None:
        """A version, by default the newest."""
        have = self.versions()
        if not have or (number is not None and number not in have):
            return None
        number = have[-1] if number is None else number
        stream = self.fs.open(self._path(f"manifests/v{number:08d}"))
        try:
            return Manifest(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, m: Manifest) -> str:
        """Create the manifest of the next version; it is there as a whole or not at all, and never over another."""
        draft, at = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{m.name}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(m.__dict__).encode()))
        out.close()
        rename = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf).rename(self.fs.makeQualified(draft), self.fs.makeQualified(at), how)
        except Exception as e:
            self.fs.delete(draft, False)
            if "AlreadyExists" in str(e):
                raise VersionConflict(f"{m.name} was published by another writer") from None
            raise
        return m.name

    def live(self) -> str | None:
        have = self.versions()
        return f"v{have[-1]:08d}" if have else None

    def meta(self) -> dict[str, str]:
        m = self.manifest()
        return dict(m.meta) if m else {}

    # ---- reading ----
    def _dead(self, m: Manifest) -> DataFrame | None:
        """pk, seq: the last version that replaced or deleted each key."""
        if not m.tombs:
            return None
        parts = [self.spark.read.schema("pk bigint").parquet(f"{self.root}/{t['name']}").withColumn("seq", F.lit(t["seq"])) for t in m.tombs]
        return reduce(DataFrame.unionByName, parts).groupBy("pk").agg(F.max("seq").alias("seq"))

    def _live(self, m: Manifest, segments: list[dict] | None = None) -> DataFrame:
        parts = [self.spark.read.schema(COLUMNS).parquet(f"{self.root}/{s['name']}/rows").select(*NAMES).withColumn("_seq", F.lit(s["seq"])) for s in (m.segments if segments is None else segments)]
        rows = reduce(DataFrame.unionByName, parts)
        if (dead := self._dead(m)) is not None:
            gone = dead.select(F.col("pk").alias("_pk"), F.col("seq").alias("_dead"))
            rows = rows.join(postings.sent(gone, sum(t["rows"] for t in m.tombs)), (F.col("pk") == F.col("_pk")) & (F.col("_seq") < F.col("_dead")), "left_anti")
        return rows.drop("_seq")

    def _need(self) -> Manifest:
        if (m := self.manifest()) is None:
            raise IndexMissing(f"no index under {self.root}")
        return m

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version as it is now; later publications do not change what was opened."""
        m = self._need() if number is None else self.manifest(number)
        if m is None:
            raise IndexMissing(f"no version {number} under {self.root}")
        return self._live(m)

    def postings(self) -> postings.Stored:
        m = self._need()
        return self._postings(m)

    def _postings(self, m: Manifest) -> postings.Stored:
        n, length = m.total("n"), m.total("length")
        segments = [postings.Segment(f"{self.root}/{s['name']}", s["seq"], s["windows"], s["buckets"]) for s in m.segments]
        return postings.Stored(self.spark, segments=segments, stats=R.Bm25Stats(n, length / n if n and length else 1.0), dead=self._dead(m), dead_rows=sum(t["rows"] for t in m.tombs))

    # ---- writing ----
    def _segment(self, rows: DataFrame, seq: int, terms: DataFrame | None = None, lost: DataFrame | None = None) -> dict:
        """Write rows and, from there, their postings as a new segment."""
        name = f"segments/s-{uuid.uuid4().hex}"
        at = f"{self.root}/{name}"
        n = rows.count()
        rows.select(*NAMES).coalesce(max(1, -(-n // ROWS_PER_FILE))).write.partitionBy("kind").parquet(f"{at}/rows")
        w = postings.write(self.spark.read.schema(COLUMNS).parquet(f"{at}/rows"), at, terms=terms, lost=lost)
        return {"name": name, "seq": seq, "rows": n, "n": w.chunks, "length": w.length, "windows": w.windows, "buckets": w.buckets}

    def publish(self, rows: DataFrame, meta: dict[str, str]) -> str:
        """All rows anew, as one segment; earlier versions stay until ``vacuum``."""
        before = self.manifest()
        m = Manifest((before.number if before else 0) + 1, meta=(before.meta if before else {}) | {k: str(v) for k, v in meta.items()}, how="full")
        m.segments = [self._segment(rows, m.number)]
        m.wrote = self._size(m.segments[0]["name"])
        return self._commit(m)

    def apply(self, rows: DataFrame, gone: DataFrame, meta: dict[str, str] | None = None) -> str:
        """``rows`` instead of those with their keys, and no rows with the keys of ``gone`` (pk): written as one more segment."""
        before = self._need()
        rows = written(rows.select(*NAMES), "rows")
        keys = written(rows.select("pk").union(gone.select("pk")).distinct(), "keys")
        dead = written(self._live(before).select("pk", "text").join(postings.sent(keys, keys.count()), "pk", "left_semi"), "dead")
        tokens = dead.select(T.tokens(F.col("text")).alias("t")).select(F.size("t").alias("length"), F.array_distinct("t").alias("t"))
        lost = tokens.select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        sums = tokens.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        m = Manifest(before.number + 1, [*before.segments], [*before.tombs], before.meta | {k: str(v) for k, v in (meta or {}).items()}, how="delta")
        segment = self._segment(rows, m.number, lost=lost)
        segment |= {"n": segment["n"] - sums.n, "length": segment["length"] - sums.length}
        m.segments.append(segment)
        if sums.n:
            name = f"tombs/t-{uuid.uuid4().hex}"
            dead.select("pk").coalesce(max(1, -(-sums.n // (10 * ROWS_PER_FILE)))).write.parquet(f"{self.root}/{name}")
            m.tombs.append({"name": name, "seq": m.number, "rows": sums.n})
            m.wrote = self._size(name)
        m.wrote += self._size(segment["name"])
        name = self._commit(m)
        try:
            self.compact()
        except VersionConflict:  # another writer goes on from here, and will see to it
            pass
        return name

    def compact(self, most: int | None = None, ratio: float | None = None) -> str | None:
        """Merge segments if there are too many, or all of them if the later ones hold too much; the rows stay the same."""
        m = self._need()
        first, later = m.segments[0], m.segments[1:]
        weight = sum(s["rows"] for s in later) + sum(t["rows"] for t in m.tombs)
        if not later:
            return None
        if weight > (FULL_RATIO if ratio is None else ratio) * max(first["rows"], LEAST_ROWS):
            new = Manifest(m.number + 1, meta=m.meta, how="rewrite")
            new.segments = [self._segment(self._live(m), new.number)]
        elif len(m.segments) > (MOST_SEGMENTS if most is None else most):
            new = Manifest(m.number + 1, tombs=m.tombs, meta=m.meta, how="merge")
            parts = [self.spark.read.schema("term string, df bigint").parquet(f"{self.root}/{s['name']}/terms") for s in later]
            terms = reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
            # the tombstones stay for the first segment, and are no later than the merged one
            merged = self._segment(self._live(m, later), later[-1]["seq"], terms=terms)
            merged |= {k: sum(s[k] for s in later) for k in ("n", "length")}
            new.segments = [first, merged]
        else:
            return None
        new.wrote = self._size(new.segments[-1]["name"])
        return self._commit(new)

    def rollback(self, number: int) -> str:
        """An earlier version, published once more."""
        m, now = self.manifest(number), self._need()
        if m is None:
            raise IndexMissing(f"no version {number} under {self.root}")
        return self._commit(Manifest(now.number + 1, m.segments, m.tombs, m.meta, how=f"rollback to {number}"))

    def vacuum(self, keep: int = 2) -> int:
        """Delete the manifests before the last ``keep`` and what they alone name; returns how many folders went.  Folders that no
        manifest names may be of a writer at work and are left."""
        numbers = self.versions()
        old, kept = numbers[: -max(1, keep)], numbers[-max(1, keep) :]
        named = lambda ns: {x["name"] for n in ns for m in [self.manifest(n)] for x in (*m.segments, *m.tombs)}
        gone = named(old) - named(kept)
        for n in old:
            self.fs.delete(self._path(f"manifests/v{n:08d}"), False)
        for name in gone:
            self.fs.delete(self._path(name), True)
        return len(gone)

    # ---- state ----
    def check(self, want: dict[str, str]) -> None:
        """The index was built with these settings; a setting that it does not know is let pass."""
        have = self.meta()
        if not have:
            raise IndexMismatch("the index has no metadata")
        wrong = {k: (have[k], str(v)) for k, v in want.items() if k in have and have[k] != str(v)}
        if wrong:
            raise IndexMismatch(f"built with other settings: {wrong}")

    def health(self) -> dict:
        from .index import statistics

        m = self.manifest()
        if m is None:
            return {"ok": False, "reason": "index_missing"}
        size = sum(self._size(x["name"]) for x in (*m.segments, *m.tombs)) / 1e6
        return {"ok": True, "version": m.name, "size_mb": round(size, 1), "segments": len(m.segments), "meta": m.meta} | statistics(self._live(m)).first().asDict()
