"""Functions for SQL: register them in a session and call them in statements."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType

from .operators import chunks, sqlguard
from .plans import diff, normalise


@udtf(returnType="id string, depth int, operator string, name string, rows bigint, cost bigint, property string")
class PlanNodes:
    """plan_nodes(payload): the nodes of a plan payload in preorder."""

    def eval(self, payload: str):
        for n in (normalise.view(normalise._loads(payload)) or {}).get("nodes", []):
            yield n["id"], n["depth"], n["operator"], n["name"], n["rows"], n["cost"], n["property"]


@udtf(returnType="pos bigint, section string, text string")
class Sections:
    """doc_sections(body): a Markdown body in chunks."""

    def eval(self, body: str):
        for i, (s, t) in enumerate(chunks.sections(body or "")):
            yield i, s, t


def _plan_diff(before: str, after: str) -> str | None:
    a, b = (normalise.view(normalise._loads(x), True) for x in (before, after))
    return json.dumps(diff.compare(a, b), ensure_ascii=False) if a and b else None


def register(spark: SparkSession) -> None:
    spark.udtf.register("plan_nodes", PlanNodes)
    spark.udtf.register("doc_sections", Sections)
    spark.udf.register("plan_diff", _plan_diff, StringType())
    spark.udf.register("read_only_refusal", sqlguard.refusal, StringType())
