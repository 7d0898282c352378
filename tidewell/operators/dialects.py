"""What differs between the two kinds of tenants: statements for a table's definition and a plan, and how names are quoted.

An executor takes a dialect and a function that runs a guarded statement; the statements of the calls come from here."""

from __future__ import annotations

from collections.abc import Callable

from . import sqlguard
from .bounded import Result
from .errors import SourceError, SqlError


class Dialect:
    """The hooks that a kind of tenant fills in."""

    kind = ""

    def definitions(self, database: str, table: str) -> list[str]:
        """Statements for a table's definition, each for where the one before fails."""
        raise NotImplementedError

    def plan(self, statement: str) -> str:
        raise NotImplementedError


class MySQL(Dialect):
    kind = "MYSQL"

    def definitions(self, database: str, table: str) -> list[str]:
        return ["SHOW CREATE TABLE " + ".".join(f"`{x}`" for x in table.split("."))]

    def plan(self, statement: str) -> str:
        return f"EXPLAIN EXTENDED {statement}"


class Oracle(Dialect):
    kind = "ORACLE"

    def definitions(self, database: str, table: str) -> list[str]:
        """The whole definition, or the columns where that package is closed to the user.  The owner is the schema that the connection is for, whatever
        stands before the name; names without quotes are kept in capitals."""
        name, owner = table.rpartition(".")[2].upper(), sqlguard.safe_name(database).upper()
        columns = "column_name, data_type, data_length, data_precision, data_scale, nullable"
        return [
            f"SELECT dbms_metadata.get_ddl('TABLE', '{name}', '{owner}') AS ddl FROM dual",
            f"SELECT {columns} FROM all_tab_columns WHERE owner = '{owner}' AND table_name = '{name}' ORDER BY column_id",
        ]

    def plan(self, statement: str) -> str:
        return f"EXPLAIN {statement}"


DIALECTS = {d.kind: d for d in (MySQL(), Oracle())}


def dialect(kind: str) -> Dialect:
    if kind not in DIALECTS:
        raise ValueError(f"unknown tenant type {kind!r}: {' or '.join(DIALECTS)}")
    return DIALECTS[kind]


def table_ddl(run: Callable[[str], Result], kind: str, database: str, table: str) -> Result:
    """The definition of a table of a tenant, asked of that tenant.  What no other statement would mend (a refused one, no way to the tenant) is not asked again."""
    failed: list[str] = []
    for statement in dialect(kind).definitions(database, sqlguard.safe_name(table)):
        try:
            return run(sqlguard.check(statement))
        except (SqlError, SourceError):
            raise
        except Exception as e:
            failed.append(str(e))
    if len(failed) == 1:
        raise SqlError(failed[0])
    raise SqlError(f"neither the definition nor the columns could be read: {'; '.join(failed)}")


def explain(run: Callable[[str], Result], kind: str, statement: str) -> Result:
    """The plan of a read-only statement, asked of the tenant."""
    body = statement.strip().rstrip(";")
    return run(sqlguard.check(dialect(kind).plan(sqlguard.check(body))))
