"""The read-only guard: what may run, what may not, and what must not slip through."""

import pytest

from tidewell.operators import bounded, ddl, sqlguard
from tidewell.operators.errors import ReadOnlyViolation, SqlError

ALLOWED = [
    "select 1", "SELECT * FROM t WHERE a = 'delete'", "select 1;", "select 1 ; ;", "show tables", "show create table t", "describe t", "desc t", "explain select * from t", "explain extended select 1", "explain format=json select 1",
    "explain format = tree select 1", "with x as (select 1) select * from x", "select 'for update'", "select `update` from t", 'select "delete" from t', "select a from t -- update\n", "select a from t # drop\n", "select /* drop table t */ 1",
    "select 'it''s; fine'", "select 'a\\'b; drop'", "select updated_at, created from t", "  \n select 1", "select a--b from t", "explain plan for select 1", "select '-- not a comment'",
]
DENIED = [
    "", "   ", ";", "-- only a comment", "insert into t values (1)", "update t set a = 1", "delete from t", "drop table t", "create table t (a int)", "alter table t add b int", "truncate table t", "grant all on t to u", "call p()",
    "replace into t values (1)", "set a = 1", "select 1; drop table t", "select 1; select 2", "select * from t for update", "select * from t FOR  SHARE", "select * from t lock in share mode", "select * into outfile '/x' from t",
    "explain delete from t", "explain analyze update t set a = 1", "explain", "explain explain select 1", "with x as (select 1) delete from t", "merge into t using s on a = b", "begin", "kill 1", "(select 1)", "1",
]
BYPASSES = [
    "select * from t for -- c\n update", "select * from t for /* c */ update", "select * from t for # c\n update", "sel/**/ect 1", "select 1 /*", "/*!50000 delete */ from t", "select 1 /*! into outfile '/x' */", "explain format=json delete from t",
    "select 1;delete from t--", "select 'a' ; delete from t", "with a as (select 1), b as (select 2) insert into t select * from a", "select \"a\"; drop table t", "select 'open; drop table t", "explain into delete from t", "-- x\nupdate t set a = 1",
]


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(sql):
    assert sqlguard.refusal(sql) == ""


@pytest.mark.parametrize("sql", DENIED)
def test_denied(sql):
    with pytest.raises(ReadOnlyViolation):
        sqlguard.check(sql)


@pytest.mark.parametrize("sql", BYPASSES)
def test_bypasses(sql):
    harmless = sql in ("select 1 /*", "select 'open; drop table t")  # an open comment or string runs to the end
    assert bool(sqlguard.refusal(sql)) != harmless


@pytest.mark.parametrize("name", ["t", "s.t", "_a$1#", "`t`", '"T"'])
def test_safe_names(name):
    assert sqlguard.safe_name(name) == name.strip('`"')


@pytest.mark.parametrize("name", ["", "1t", "a.b.c", "t;drop", "t t", "a-b", "t'"])
def test_unsafe_names(name):
    with pytest.raises(ReadOnlyViolation):
        sqlguard.safe_name(name)


def test_second_look(spark):
    spark.range(3).createOrReplaceTempView("t3")
    assert sqlguard.safe_plan(spark, "with x as (select id from t3) select * from x") and sqlguard.safe_plan(spark, "select 1")
    assert not sqlguard.safe_plan(spark, "with x as (select 1 as id) insert into t3 select * from x") and not sqlguard.safe_plan(spark, "drop view t3")


def test_bounded(spark):
    spark.range(300).createOrReplaceTempView("t300")
    r = bounded.run(spark, "select id from t300 order by id")
    assert (r.row_count, r.truncated, r.rows[-1]) == (200, True, [199])
    r = bounded.run(spark, "select id from t300 where id < 200")
    assert (r.row_count, r.truncated) == (200, False)
    r = bounded.run(spark, "select id from t300", send_rows=False)
    assert (r.row_count, r.rows) == (200, [])
    with pytest.raises(ReadOnlyViolation):
        bounded.run(spark, "drop view t300")
    with pytest.raises(SqlError):
        bounded.run(spark, "select nothing from t300")
    assert "Range" in bounded.explain(spark, "explain select * from t300").rows[0][0]


def test_definitions(spark):
    spark.createDataFrame([(1, "x", 1.5, True)], "id bigint, name string, price double, ok boolean").createOrReplaceTempView("items")
    r = ddl.show_create(spark, "items")
    assert "PRIMARY KEY (`id`)" in r.rows[0][1] and "`price` decimal(10,2)" in r.rows[0][1] and "`ok` tinyint(1)" in r.rows[0][1]
    with pytest.raises(ReadOnlyViolation):
        ddl.show_create(spark, "items; drop")
