"""Local sources of control-plane data: JSON documents, sample tables, canned plans, zipped corpora."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.errors import SqlError


def json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON document, an array (a row each) or an object (one row)."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def text_document(spark: SparkSession, path: str, key: str) -> DataFrame:
    """key and payload of each object of a JSON array, the payload as text: for documents whose schema is open or recursive."""
    raw = spark.read.text(path, wholetext=True)
    one = F.explode(F.from_json("value", "array<variant>"))
    v = raw.select(one.alias("v"))
    return v.select(F.variant_get("v", f"$.{key}", "string").alias(key), F.to_json("v").alias("payload"))


_DATETIME = re.compile(r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}.*")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


def _kind(values: list) -> T.DataType:
    first = next((v for v in values if v is not None), None)
    match first:
        case bool():
            return T.BooleanType()
        case int():
            return T.LongType()
        case float():
            return T.DoubleType()
        case str() if _DATETIME.fullmatch(first):
            return T.TimestampNTZType()
        case str() if _DATE.fullmatch(first):
            return T.DateType()
    return T.StringType()


def _value(v, kind: T.DataType):
    if v is None:
        return None
    match kind:
        case T.TimestampNTZType():
            return dt.datetime.fromisoformat(v).replace(tzinfo=None)
        case T.DateType():
            return dt.date.fromisoformat(v)
        case T.DoubleType():
            return float(v)
        case T.StringType():
            return v if isinstance(v, str) else json.dumps(v)
    return v


def sample_table(spark: SparkSession, columns: list[str], rows: list[list]) -> DataFrame:
    """A small literal table; a column's type is that of its first value."""
    kinds = [_kind([r[i] for r in rows]) for i in range(len(columns))]
    schema = T.StructType([T.StructField(c, k) for c, k in zip(columns, kinds, strict=True)])
    return spark.createDataFrame([tuple(_value(v, k) for v, k in zip(r, kinds, strict=True)) for r in rows], schema)


def sample_views(spark: SparkSession, tables: dict[str, dict]) -> None:
    """{name: {columns, rows}} as temporary views; Spark's names ignore case."""
    for name, t in tables.items():
        sample_table(spark, t["columns"], t["rows"]).createOrReplaceTempView(name)


def audit_view(statements: DataFrame) -> DataFrame:
    """The virtual audit table: a fixed projection of slow statements."""
    return statements.select("sql_id", "sql_text", "db_name", "avg_elapsed_us", "exec_count")


def canned_plan(entries: list[dict], sql: str) -> dict:
    """The first entry whose ``match`` stands in the statement as a word, else the one without a match."""
    for e in entries:
        if e["match"] and re.search(rf"\b{re.escape(e['match'])}\b", sql, re.I):
            return e
    for e in entries:
        if not e["match"]:
            return e
    raise SqlError("no plan for this statement")


def unpack(archive: str, target: str) -> int:
    """Members of a zipped corpus under ``target``; returns how many were written.

    Names stored as CP437 are read as UTF-8, junk is skipped, a folder common to all is left out, and a file of the same size
    is kept as it is.  Names that lead outside ``target`` are refused."""
    root = Path(target).resolve()
    wanted: list[tuple[zipfile.ZipInfo, list[str]]] = []
    with zipfile.ZipFile(archive) as z:
        for m in z.infolist():
            name = m.filename
            if not m.flag_bits & 0x800:
                try:
                    name = name.encode("cp437").decode()
                except (UnicodeEncodeError, UnicodeDecodeError):
                    pass
            steps = [s for s in name.split("/") if s]
            if not m.is_dir() and steps and steps[0] != "__MACOSX" and not any(s.startswith(".") and s != ".." for s in steps):
                wanted.append((m, steps))
        common = os.path.commonprefix([s[:-1] for _, s in wanted]) if wanted else []
        written = 0
        for m, steps in wanted:
            to = root.joinpath(*steps[len(common) :]).resolve()
            if ".." in steps or not to.is_relative_to(root):
                raise ValueError(f"{m.filename!r} leads outside the target")
            if to.exists() and to.stat().st_size == m.file_size:
                continue
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(z.read(m))
            at = dt.datetime(*m.date_time).timestamp()
            os.utime(to, (at, at))
            written += 1
    return written
