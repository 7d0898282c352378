"""Table definitions: of catalogue tables, and made up from a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .bounded import Result, first_rows
from .sqlguard import safe_name

# Column types of a made-up definition.
KINDS = [
    (T.BooleanType, "tinyint(1)"), (T.LongType, "bigint(20)"), (T.IntegerType, "bigint(20)"), (T.ShortType, "bigint(20)"), (T.DoubleType, "decimal(10,2)"), (T.FloatType, "decimal(10,2)"),
    (T.DecimalType, "decimal(10,2)"), (T.TimestampType, "datetime"), (T.TimestampNTZType, "datetime"), (T.DateType, "date"),
]


def kind(t: T.DataType) -> str:
    return next((name for cls, name in KINDS if isinstance(t, cls)), "varchar(64)")


def definition(name: str, schema: T.StructType) -> str:
    """A CREATE TABLE text whose first column is the key."""
    name = safe_name(name)
    lines = [f"  `{f.name}` {kind(f.dataType)}{' NOT NULL' if i == 0 else ' DEFAULT NULL'}" for i, f in enumerate(schema.fields)]
    if schema.fields:
        lines.append(f"  PRIMARY KEY (`{schema.fields[0].name}`)")
    return f"CREATE TABLE `{name}` (\n" + ",\n".join(lines) + "\n)"


def show_create(spark: SparkSession, name: str) -> Result:
    """The catalogue's own definition of a table; of a view or path-backed frame, the made-up one."""
    name = safe_name(name)
    table = spark.table(name)
    try:
        return first_rows(spark.sql(f"SHOW CREATE TABLE {name}"))
    except Exception:  # temporary views have no definition of their own
        return Result(["Table", "Create Table"], [[name, definition(name, table.schema)]])


def columns(df: DataFrame, name: str) -> DataFrame:
    """One row per column: table_name, column_id (from 1), column_name, data_type."""
    rows = [(name, i + 1, f.name, kind(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_id bigint, column_name string, data_type string")
