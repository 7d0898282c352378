"""Read-only guard: a statement runs only if it is recognised as one that cannot write.

One pattern cuts the text into words, quoted parts and marks; comments and white space fall away.  All rules look at the
words, so nothing hides in a comment and nothing in a string or a quoted name counts.  What is not recognised is refused."""

from __future__ import annotations

import re

from .errors import ReadOnlyViolation

# Statements that may run, and words that may not stand in them.
READS = frozenset("select show explain describe desc with".split())
LISTS = frozenset("show describe desc".split())
EXPLAIN_EXTRAS = frozenset("analyze plan for extended format into".split())
WRITES = frozenset(
    """insert update delete merge upsert replace drop alter truncate create grant revoke rename call execute purge flashback load lock unlock outfile dumpfile handler
    begin commit rollback savepoint prepare deallocate kill shutdown flush install uninstall optimize repair""".split()
)
LOCKS = (("for", "update"), ("for", "share"), ("lock", "in", "share", "mode"))

_PIECE = re.compile(
    r"""(?P<run>/\*!)
      | (?P<gone>\s+ | --(?=\s|\Z)[^\n]* | \#[^\n]* | /\*.*?(?:\*/|\Z))
      | (?P<quoted>'(?:\\.|''|[^'\\])*(?:'|\\?\Z) | "(?:""|[^"])*(?:"|\Z) | `(?:``|[^`])*(?:`|\Z))
      | (?P<word>[^\W\d][\w$\#]*)
      | (?P<mark>.)""",
    re.X | re.S,
)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_$#]*(?:\.[A-Za-z_][A-Za-z0-9_$#]*)?")


def pieces(sql: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m[0].lower() if m.lastgroup == "word" else m[0]) for m in _PIECE.finditer(sql) if m.lastgroup != "gone"]


def explained(found: list[tuple[str, str]]) -> str:
    """First word of the statement that an EXPLAIN is about."""
    at = 1
    while at < len(found) and found[at][0] == "word" and found[at][1] in EXPLAIN_EXTRAS:
        at += 1
        if found[at - 1][1] == "format":
            at += at < len(found) and found[at] == ("mark", "=")
            at += at < len(found) and found[at][0] == "word"
    return found[at][1] if at < len(found) and found[at][0] == "word" else ""


def refusal(sql: str) -> str:
    """Why a statement may not run; empty if it may."""
    found = pieces(sql or "")
    while found and found[-1] == ("mark", ";"):
        del found[-1]
    if not found:
        return "empty statement"
    if ("mark", ";") in found:
        return "more than one statement"
    if any(k == "run" for k, _ in found):
        return "a comment that a server would run"
    kind = found[0][1] if found[0][0] == "word" else ""
    if kind == "explain":
        kind = explained(found)
        if kind == "explain":
            kind = ""
    if kind not in READS:
        return f"not a read: {kind or 'unknown'}"
    words = [w for k, w in found if k == "word"]
    text = f" {' '.join(words)} "
    for seq in LOCKS:
        if f" {' '.join(seq)} " in text:
            return "a read that locks"
    if kind not in LISTS:
        for w in words:
            if w in WRITES:
                return f"a word that writes: {w}"
    return ""


def check(sql: str) -> str:
    if why := refusal(sql):
        raise ReadOnlyViolation(why)
    return sql


def safe_name(name: str) -> str:
    """A table name, perhaps with a schema, without quotes; anything else is refused."""
    bare = (name or "").strip().strip('`"')
    if not _NAME.fullmatch(bare):
        raise ReadOnlyViolation(f"not a table name: {name!r}")
    return bare


def safe_plan(spark, sql: str) -> bool:
    """A second look, by Spark's own parser: no node of the plan is a command that changes anything."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    stack = [plan]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if re.search(r"Insert|Delete|Update|Merge|Create|Drop|Alter|Truncate|Replace|Load|Cache|Refresh|Set(Command|Catalog|Namespace)|Add(Jar|File|Columns)|Rename|Repair|Recover", name):
            return False
        kids = node.children()
        inner = node.innerChildren()
        stack += [kids.apply(i) for i in range(kids.size())]
        stack += [x for x in (inner.apply(i) for i in range(inner.size())) if hasattr(x, "children")]
    return True
