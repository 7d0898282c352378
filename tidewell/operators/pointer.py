"""A one-line file that names the live version of a folder; it is replaced in one step."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Pointer:
    """The file ``name`` under ``root``: moving it either happens or leaves the old one, so a crash loses no version."""

    def __init__(self, spark: SparkSession, root: str, name: str = "CURRENT"):
        self.spark, self.root, self.name = spark, root, name
        jvm = spark.sparkContext._jvm
        self._at = lambda n: jvm.org.apache.hadoop.fs.Path(f"{root}/{n}")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> str | None:
        if not self.fs.exists(self._at(self.name)):
            return None
        return self.spark.read.text(f"{self.root}/{self.name}").first()[0].strip()

    def move(self, to: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        draft = self._at(f"{self.name}.next")
        out = self.fs.create(draft, True)
        out.write(bytearray(to.encode()))
        out.close()
        over = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        over[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf).rename(self.fs.makeQualified(draft), self.fs.makeQualified(self._at(self.name)), over)
