"""Chat threads and the audit trail: lists, appends, pruning.

Stores are Parquet folders.  Appending adds files; deleting writes the rows that stay to a new version (see ``store``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut_values, title_of
from .filters import valid_thread

LIST_LIMIT, MESSAGE_LIMIT, AUDIT_LIMIT = 500, 2000, 500


def threads(messages: DataFrame, limit: int = 50) -> DataFrame:
    """One row per thread: first and last time, count, and a title from its first user message; newest first."""
    user = F.col("role") == "user"
    out = messages.groupBy("thread_id").agg(
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count(F.lit(1)).alias("message_count"),
        F.min_by(F.when(user, F.col("content")), F.when(user, F.col("id"))).alias("first_user"),
    )
    out = out.withColumn("title", title_of(F.col("first_user"))).drop("first_user")
    return out.orderBy(F.col("updated_at").desc_nulls_last(), "thread_id").limit(max(1, min(limit, LIST_LIMIT)))


def thread_messages(messages: DataFrame, thread_id, limit: int = 200) -> DataFrame:
    """The last messages of a thread, oldest first."""
    last = messages.where(F.col("thread_id") == thread_id).orderBy(F.col("id").desc()).limit(max(1, min(limit, MESSAGE_LIMIT)))
    return last.orderBy("id")


def without_thread(messages: DataFrame, thread_id) -> DataFrame:
    return messages.where(~F.col("thread_id").eqNullSafe(F.lit(thread_id)))


def valid_messages(messages: DataFrame) -> DataFrame:
    """Rows that may be appended: a plain thread id and a role that is kept."""
    return messages.where(valid_thread(F.col("thread_id")) & F.col("role").isin("user", "assistant")).withColumn("content", F.coalesce(F.col("content").cast("string"), F.lit("")))


def audit_list(events: DataFrame, thread_id=None, tool: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first; both filters are optional."""
    out = events
    if thread_id is not None:
        out = out.where(F.col("thread_id") == thread_id)
    if tool is not None:
        out = out.where(F.col("tool") == tool)
    return out.orderBy(F.col("id").desc()).limit(max(1, min(limit, AUDIT_LIMIT)))


def audit_kept(events: DataFrame, days: int, now) -> DataFrame:
    """What pruning leaves; no days or fewer keeps all."""
    return events if days <= 0 else events.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))


def audit_row(events: DataFrame) -> DataFrame:
    """Argument maps cut to what is stored."""
    return events.withColumn("args", F.to_json(cut_values(F.col("args"))))


def answers(events: DataFrame) -> DataFrame:
    """Partial answers put together: deltas of each (thread_id, turn) in order of seq."""
    parts = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return events.where(F.col("type") == "delta").groupBy("thread_id", "turn").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("content"))


def new_status(events: DataFrame) -> DataFrame:
    """Status events without those equal to the one before them in their thread."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("thread_id").orderBy("seq"))
    return events.where(F.col("type") == "status").withColumn("_before", before).where(~F.col("text").eqNullSafe(F.col("_before"))).drop("_before")
