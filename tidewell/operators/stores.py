"""Message and audit stores: Parquet folders of named batches; what deletes rows writes a new version and moves a pointer."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import history
from .errors import VersionConflict
from .pointer import Pointer

MESSAGES = "id bigint, thread_id string, role string, content string, created_at timestamp"
AUDIT = "id bigint, thread_id string, tool string, args string, ok boolean, error string, rows bigint, truncated boolean, approved boolean, duration_ms bigint, created_at timestamp"


class Log:
    """Rows under ``root``/<version>/batch=<name>; the file CURRENT names the version.

    Every append is a batch: written aside and then moved to its name in one step, unless that name is there already, so that a batch
    that is sent again adds nothing.  What removes rows writes a new version, with the names of all batches that it holds, and moves the pointer
    if no batch has come in between; else it begins anew.  An append that finds the version moved on is sent to the new one."""

    TRIES = 5

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.names = [c.split()[0] for c in schema.split(", ")]
        self._at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.pointer = Pointer(spark, self.root)

    def _version(self) -> str:
        if (now := self.pointer.read()) is None:
            self._point(now := "first")
        return now

    def _point(self, name: str) -> None:
        self.fs.mkdirs(self._at(name))
        self.pointer.move(name)

    def batches(self, version: str | None = None) -> set[str]:
        """Names of the batches that a version holds."""
        found = [f.getPath().getName() for f in self.fs.listStatus(self._at(version or self._version()))]
        return {n.partition("=")[2] for n in found if n.startswith(("batch=", "had="))}

    def read(self) -> DataFrame:
        return self._read(self._version())

    def _read(self, version: str) -> DataFrame:
        names = sorted(b for b in self.batches(version) if self.fs.exists(self._at(f"{version}/batch={b}")))
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{version}/batch={b}" for b in names])

    def append(self, rows: DataFrame, batch: str | None = None) -> bool:
        """Add ``rows`` under the name ``batch`` (letters, digits, - and _); False if it is there already."""
        batch = batch or uuid.uuid4().hex
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"no name for a batch: {batch!r}")
        if batch in self.batches():
            return False
        aside = f"aside-{uuid.uuid4().hex}"
        rows.select(*self.names).write.parquet(f"{self.root}/{aside}")
        try:
            for _ in range(self.TRIES):
                version = self._version()
                if batch in self.batches(version):
                    return False
                if not self.fs.rename(self._at(aside), self._at(f"{version}/batch={batch}")):
                    raise VersionConflict(f"batch {batch} cannot be moved to {version}")
                if self._version() == version or batch in self.batches():
                    return True
                self.fs.rename(self._at(f"{version}/batch={batch}"), self._at(aside))  # rows were removed meanwhile, without these
            raise VersionConflict(f"{self.root} moves on too often")
        finally:
            self.fs.delete(self._at(aside), True)

    def keep(self, chosen: Callable[[DataFrame], DataFrame]) -> int:
        """Only the rows that ``chosen`` leaves of this log stay; returns how many went."""
        for _ in range(self.TRIES):
            old = self._version()
            had = self.batches(old)
            now = self._read(old)
            name = uuid.uuid4().hex
            chosen(now).select(*self.names).write.parquet(f"{self.root}/{name}/batch={name}")
            for b in had:  # their rows are in the new batch, or gone
                self.fs.mkdirs(self._at(f"{name}/had={b}"))
            left = self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}/batch={name}").count()
            gone = now.count() - left
            if self._version() == old and self.batches(old) == had:
                self.pointer.move(name)
                if self.batches(old) == had:
                    self.fs.delete(self._at(old), True)
                return gone
            self.fs.delete(self._at(name), True)
        raise VersionConflict(f"{self.root} moves on too often")


def messages(spark: SparkSession, root: str) -> Log:
    return Log(spark, root, MESSAGES)


def audit(spark: SparkSession, root: str) -> Log:
    return Log(spark, root, AUDIT)


def append_messages(log: Log, rows: DataFrame, batch: str | None = None) -> bool:
    return log.append(history.valid_messages(rows), batch)


def delete_thread(log: Log, thread_id: str) -> int:
    """Messages of a thread go; the audit trail is another log and stays."""
    return log.keep(lambda rows: history.without_thread(rows, thread_id))


def prune(log: Log, days: int, now: Column | None = None) -> int:
    return 0 if days <= 0 else log.keep(lambda rows: history.audit_kept(rows, days, now if now is not None else F.current_timestamp()))


def audit_view(rows: DataFrame, labels: dict[str, str]) -> DataFrame:
    """With the label of each tool and the time in ISO form."""
    from .metadata import labelled

    names = rows.sparkSession.createDataFrame(sorted(labels.items()), "name string, label string")
    return labelled(rows, names, "tool").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX"))
