"""Bounded, guarded SQL: at most ``max_rows`` rows reach the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import sqlguard
from .errors import SqlError

MAX_ROWS = 200


@dataclass
class Result:
    columns: list[str]
    rows: list[list] = field(default_factory=list)
    truncated: bool = False
    row_count: int = 0

    def __post_init__(self):
        self.row_count = len(self.rows) or self.row_count


def first_rows(df: DataFrame, max_rows: int = MAX_ROWS) -> Result:
    """One row more than asked for is fetched, and tells whether there are more."""
    got = df.limit(max_rows + 1).collect()
    return Result(df.columns, [list(r) for r in got[:max_rows]], len(got) > max_rows)


def run(spark: SparkSession, sql: str, max_rows: int = MAX_ROWS, send_rows: bool = True) -> Result:
    """A read-only statement; with ``send_rows`` off the count is kept and the rows are not."""
    sqlguard.check(sql)
    try:
        out = first_rows(spark.sql(sql.strip().rstrip(";")), max_rows)
    except Exception as e:
        raise SqlError(str(e)) from e
    if not send_rows:
        out.rows = []
    return out


def explain(spark: SparkSession, sql: str) -> Result:
    """The plan of a read-only statement."""
    body = sql.strip()
    body = body[7:].strip() if body.lower().startswith("explain") else body
    sqlguard.check(body)
    try:
        return first_rows(spark.sql(f"EXPLAIN FORMATTED {body.rstrip(';')}"))
    except Exception as e:
        raise SqlError(str(e)) from e
