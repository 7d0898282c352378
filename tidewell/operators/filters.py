"""Predicates over metadata and index rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CONDITION = re.compile(r"^\s*@(\w+)\s*(>=|<=|>|<)\s*(-?\d+(?:\.\d+)?)\s*$")


def contains_word(c: Column, word: str | None) -> Column:
    """Case-insensitive substring, no wildcards; no word keeps all."""
    return F.lit(True) if not word else F.coalesce(F.contains(F.lower(c), F.lit(word.lower())), F.lit(False))


def inner_flag(c: Column, inner: bool) -> Column:
    return F.coalesce(c, F.lit(False)) == F.lit(inner)


def comparison(df: DataFrame, expression: str | None) -> Column:
    """``@field op number``, joined by ``and``.  A null or unknown field drops the row; anything else is an error."""
    if not expression or not expression.strip():
        return F.lit(True)
    found = []
    for part in re.split(r"(?i)\band\b", expression):
        m = _CONDITION.match(part)
        if not m:
            raise ValueError(f"not a condition: {part.strip()!r}")
        field, op, number = m.groups()
        c = df[field].cast("double") if field in df.columns else F.lit(None).cast("double")
        n = F.lit(float(number))
        test = {">": c > n, ">=": c >= n, "<": c < n, "<=": c <= n}[op]
        found.append(F.coalesce(test, F.lit(False)))
    return reduce(lambda a, b: a & b, found)


def equals_as_text(c: Column, literal: object) -> Column:
    return c.cast("string") == F.lit(str(literal))


def scalar(kind: Column, mode_col: Column, version_col: Column, mode: str = "", version: str = "", include_index: bool = False) -> Column:
    """Index rows for a question: documents (with ``include_index`` navigation pages too), of the mode or of none, of the version or of none."""
    out = kind.isin("doc", "nav") if include_index else kind == "doc"
    if mode:
        out = out & mode_col.isin(mode, "")
    if version:
        out = out & ((version_col == "") | F.startswith(version_col, F.lit(version)))
    return out


def relaxed(filtered: DataFrame, unfiltered: DataFrame, automatic: bool) -> DataFrame:
    """``filtered``; if its filters were guessed and leave nothing, ``unfiltered``."""
    return unfiltered if automatic and filtered.isEmpty() else filtered


THREAD_ID = r"^[A-Za-z0-9_-]{1,64}$"


def valid_thread(c: Column) -> Column:
    return F.coalesce(c.rlike(THREAD_ID), F.lit(False))
