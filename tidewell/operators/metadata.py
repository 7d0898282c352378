"""Tenants, clusters, resources, slow statements and top plans: projections, filters and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import pct
from .filters import comparison, contains_word, inner_flag

# Fields that each listing returns.
TENANT_FIELDS = ["id", "clusterId", "clusterName", "obTenantId", "description", "mode", "name"]
CLUSTER_FIELDS = ["id", "name", "clusterName", "status", "region", "obVersion", "serverCount"]
CLUSTER_STATS = [
    "clusterId", "clusterName", "clusterType", "syncStatus", "tenantCount", "unitCount", "cpuTotal", "cpuAssigned", "cpuTotalMin", "cpuTotalMax",
    "cpuAssignedMin", "cpuAssignedMax", "memoryTotalByte", "memoryAssignedByte", "systemMemoryByte", "dataDiskTotalByte", "dataDiskUsedByte",
    "logDiskTotalByte", "logDiskAssignedByte", "logDiskUsedByte",
]
SERVER_STATS = [
    "ip", "port", "zone", "partitionCount", "unitCount", "cpuTotal", "cpuAssigned", "cpuAssignedMin", "cpuAssignedMax", "memoryTotalByte", "memoryAssignedByte",
    "systemMemoryByte", "dataDiskTotalByte", "dataDiskUsedByte", "logDiskTotalByte", "logDiskAssignedByte", "logDiskUsedByte",
]
SLOW_SQL_FIELDS = [
    "sqlId", "avgAffectedRows", "avgCpuTime", "avgDiskReads", "avgElapsedTime", "avgExecuteTime", "avgExecutorRpcCount", "avgLogicalReads", "avgMemstoreReadRows",
    "avgNetWaitTime", "avgPartitionCount", "avgQueueTime", "avgReturnRows", "avgSsstoreReadRows", "avgWaitTime", "dbName", "executions",
    "failCount", "sumElapsedTime", "tableScanPercentage", "tenantName", "userName", "sqlTextShort",
]
WATER_LEVELS = [
    ("cpuAssigned", "cpuTotal", "cpuAssignedPct"),
    ("memoryAssignedByte", "memoryTotalByte", "memoryAssignedPct"),
    ("dataDiskUsedByte", "dataDiskTotalByte", "dataDiskUsedPct"),
    ("logDiskUsedByte", "logDiskTotalByte", "logDiskUsedPct"),
]


def only(df: DataFrame, fields: list[str], **renamed: str) -> DataFrame:
    """The listed fields that are there, some under another name."""
    return df.select(*[F.col(c).alias(renamed.get(c, c)) for c in dict.fromkeys(fields) if c in df.columns])


def tenants(df: DataFrame) -> DataFrame:
    return only(df, TENANT_FIELDS, id="tenantId")


def tenant(df: DataFrame, cluster_id: object, tenant_id: object) -> DataFrame:
    """All fields of one tenant; ids are compared as text."""
    own = (F.col("clusterId").cast("string") == str(cluster_id)) & (F.col("id").cast("string") == str(tenant_id))
    return df.where(own).withColumnRenamed("id", "tenantId")


def clusters(df: DataFrame) -> DataFrame:
    return only(df, CLUSTER_FIELDS, id="clusterId")


def water_levels(df: DataFrame, fields: list[str]) -> DataFrame:
    """The listed fields and a percentage for each pair that is there; null where the total is missing or zero."""
    out = only(df, fields)
    return out.withColumns({name: pct(F.col(part), F.col(total)) for part, total, name in WATER_LEVELS if part in out.columns and total in out.columns})


def of_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose cluster exists."""
    return df.join(known.select(key).distinct(), key, "left_semi")


def slow_sql(df: DataFrame, *, inner: bool = False, text: str | None = None, expression: str | None = None, limit: int = 5, text_length: int = 100, begin=None, end=None) -> DataFrame:
    """The slowest statements of a window: most average time first, ties by id."""
    out = df.where(inner_flag(F.col("inner"), inner) & contains_word(F.col("sqlTextShort"), text) & comparison(df, expression))
    if begin is not None:
        out = out.where(F.col("ts") >= begin)
    if end is not None:
        out = out.where(F.col("ts") <= end)
    out = out.withColumn("sqlTextShort", F.substring("sqlTextShort", 1, text_length))
    return only(out.orderBy(F.col("avgElapsedTime").desc_nulls_last(), "sqlId").limit(limit), SLOW_SQL_FIELDS)


def top_plans(df: DataFrame, sql_id: str) -> DataFrame:
    """Plans of one statement, newest first."""
    own = df.where(F.col("sqlId") == sql_id).orderBy(F.col("firstLoadTime").desc_nulls_last(), "uid")
    return own.select(F.lit(sql_id).alias("sql_id"), "uid", F.col("avgElapsedTime").alias("avg_elapsed_time"), F.col("firstLoadTime").alias("first_load_time"))


def sql_text(df: DataFrame, sql_id: str) -> DataFrame:
    return df.where(F.col("sqlId") == sql_id).select(F.col("fulltext").alias("sqlText"), "dbName", "tables")


def plan_of(df: DataFrame, uid: str) -> DataFrame:
    return df.where(F.col("uid") == uid)


def labelled(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """With a label for each name; a name without one is its own label.  ``labels`` (name, label) is a fixed table of the API."""
    return df.join(F.broadcast(labels.withColumnRenamed("name", key)), key, "left").withColumn("label", F.coalesce("label", key))
