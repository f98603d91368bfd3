"""Tokens, statements and their risks: quotes, comments of any depth, and scopes of WITH."""

import random

import pytest

from loomwright.functions import lexing
from loomwright.functions import scalars as S
from loomwright.operators import safety, sqllog


def comment(depth):
    return "/* a; " * depth + "c;" + " b; */" * depth


@pytest.mark.parametrize("depth", [1, 2, 3, 7, 64, 3000])
def test_comments_nest(depth):
    assert lexing.split(f"select 1 {comment(depth)}; select 2") == [f"select 1 {comment(depth)}", "select 2"]
    assert lexing.split(f"{comment(depth)}; -- x") == []
    assert lexing.split(f"{comment(depth)[:-2]}; select 2") == [f"{comment(depth)[:-2]}; select 2"]
    assert safety.judge(f"commit {comment(depth)}")[2] == []
    assert safety.judge(f"commit {comment(depth)[:-2]}")[2] == ["SESSION_STATE_CONFLICT"]
    assert safety.judge(f"commit {comment(depth)}", "oracle")[2] == ([] if depth == 1 else ["SESSION_STATE_CONFLICT"])


@pytest.mark.parametrize(("mode", "script", "want"), [
    ("postgres", "select E'it\\'s;'; delete from a", ["select E'it\\'s;'", "delete from a"]),
    ("postgres", "select 1 as x$y$; delete from a", ["select 1 as x$y$", "delete from a"]),
    ("postgres", "select 1 as x$$; delete from a", ["select 1 as x$$", "delete from a"]),
    ("postgres", "select 1 as é$t$; delete from a", ["select 1 as é$t$", "delete from a"]),
    ("postgres", "select $1$; select 2", ["select $1$", "select 2"]),
    ("postgres", "do $f$ begin; $g$ ; end; $f$; x", ["do $f$ begin; $g$ ; end; $f$", "x"]),
    ("postgres", "/* it's */ a; b", ["/* it's */ a", "b"]),
    ("postgres", "a -- it's\r; b", ["a -- it's", "b"]),
    ("postgres", "*/ a; b", ["*/ a", "b"]),
    ("oracle", "select $$ x; delete from a", ["select $$ x", "delete from a"]),
    ("oracle", "select NQ'(It's; x)' from d; y", ["select NQ'(It's; x)' from d", "y"]),
    ("oracle", "select q'!a;'b!' from d; y", ["select q'!a;'b!' from d", "y"]),
    ("oracle", "create or replace package body p as\n procedure q;\nend;\n / \nbegin null; end;\n/\n", ["create or replace package body p as\n procedure q;\nend;", "begin null; end;"]),
    ("oracle", "select 4\n/2 from d; y", ["select 4\n/2 from d", "y"]),
    ("oracle", "/* unclosed commit;", ["/* unclosed commit;"]),
])
def test_split(mode, script, want):
    assert lexing.split(script, mode) == want


WHERE, DESTROY, UNKNOWN, SESSION = "MISSING_WHERE", "DESTRUCTIVE_DDL", "UNKNOWN_STATEMENT", "SESSION_STATE_CONFLICT"


def nested(depth):
    sql = "delete from a returning id"
    for i in range(depth):
        sql = f"with c{i} as ({sql}) select * from c{i}"
    return sql


@pytest.mark.parametrize(("mode", "sql", "kind", "risks"), [
    ("postgres", "update a set s = 'where' where_note = (select n from b where i = 1)", "WRITE", [WHERE]),
    ("postgres", "update t set a = (select 1 from u where u.x = 1)", "WRITE", [WHERE]),
    ("postgres", "delete from a where i in (select i from b)", "WRITE", []),
    ("postgres", "with d as (delete from t) update u set a = 1 where b = 2", "WRITE", [WHERE]),
    ("postgres", "with d as (delete from t where x = 1) update u set a = 1", "WRITE", [WHERE]),
    ("postgres", "with d as (delete from t where x = 1), e as materialized (select 1) update u set a = 1 where b = 2", "WRITE", []),
    ("postgres", "/* delete from h */ with x as (select $$ update t set x = 1 $$) delete from t where i in (select 1 from x)", "WRITE", []),
    ("postgres", "with c as (insert into b values (1) returning i) select * from c", "WRITE", []),
    ("postgres", "with c as (merge into b using s on b.i = s.i when matched then update set v = s.v) select * from c", "WRITE", []),
    ("postgres", "with o as (vacuum a) select * from o", "UNKNOWN", [UNKNOWN]),
    ("postgres", "with o as (drop table a) select * from o", "UNKNOWN", [UNKNOWN]),
    ("postgres", "with o as () select * from o", "UNKNOWN", [WHERE, UNKNOWN]),
    ("postgres", "with o as select 1", "UNKNOWN", [WHERE, UNKNOWN]),
    ("postgres", "with o as (select 1)", "UNKNOWN", [WHERE, UNKNOWN]),
    ("postgres", "with o as (with i as (select 1) delete from a returning id) select * from o", "WRITE", [WHERE]),
    ("postgres", "with o as ((delete from a)) select * from o", "WRITE", [WHERE]),
    ("postgres", nested(64), "WRITE", [WHERE]),
    ("postgres", "explain delete from t where i = 1", "WRITE", []),
    ("postgres", "explain (analyze, buffers) delete from t", "WRITE", [WHERE]),
    ("postgres", "explain analyze execute p(1)", "WRITE", []),
    ("postgres", "explain analyze mystery a", "UNKNOWN", [UNKNOWN]),
    ("postgres", "explain mystery a", "READ", []),
    ("postgres", "explain analyze create table b as select * from a", "DDL", []),
    ("postgres", "explain analyze with r as (delete from a returning i) select * from r", "WRITE", [WHERE]),
    ("postgres", "commit work", "TRANSACTION_CONTROL", [SESSION]),
    ("postgres", "/* x */ rollback -- y", "TRANSACTION_CONTROL", []),
    ("postgres", "begin isolation level serializable", "TRANSACTION_CONTROL", [SESSION]),
    ("oracle", "begin\n null;\nend;", "WRITE", []),
    ("oracle", "*/ delete from a", "WRITE", [WHERE]),
    ("oracle", "/* unclosed delete from a", "UNKNOWN", [UNKNOWN]),
    ("oracle", "select NQ'[It's; drop table h]' from d", "READ", []),
    ("postgres", "truncate a", "DDL", [DESTROY]),
    ("postgres", "", "UNKNOWN", [UNKNOWN]),
    ("postgres", None, "UNKNOWN", [UNKNOWN]),
])
def test_scopes(mode, sql, kind, risks):
    assert safety.judge(sql, mode)[1:] == (kind, risks)


def test_too_many_scopes_are_unknown():
    # Reading outermost scopes first or innermost first, 65 are one too many.
    assert safety.judge(nested(65))[1:] in [("WRITE", [WHERE]), ("UNKNOWN", [WHERE, UNKNOWN])]
    assert WHERE in safety.judge(nested(5000))[2]


def test_on_columns(spark):
    """Pieces of known statements, comments and quotes, put together in a text column, come apart again."""
    rng = random.Random(1)
    safe = ["select 'a;''b'", "update t set a = 1", 'drop table "x;y"', "select $q$ ; $q$ || E'\\';'", f"delete from t {comment(5)} where a = ';'"]
    rows, want = [], set()
    for i in range(300):
        mine = [rng.choice(safe) for _ in range(rng.randint(0, 6))]
        rows.append((i, rng.choice([" ; ", ";", f"; {comment(3)};\n-- it's;\n;"]).join(mine) + rng.choice(["", ";", "; "])))
        want |= {(i, k + 1, s, safety.judge(s)[1]) for k, s in enumerate(mine)}
    out = sqllog.classify_statements(sqllog.split_statements(spark.createDataFrame([*rows, (999, None)], "script_id int, script string")))
    assert {(r.script_id, r.idx, lexing.blank(r.sql).strip() and r.sql.split("*/;")[-1].split("-- it's;\n")[-1].strip("; \n"), r.kind) for r in out.collect()} == want


def test_definitions(spark):
    cases = {"select 1 ;\r\n": "select 1", "a\r\nb;": "a\nb", "select ';'": "select ';'", "select 1 -- ;": "select 1 -- ;", f"x {comment(3)};": f"x {comment(3)}", f"x {comment(3)[:-2]};": f"x {comment(3)[:-2]};", "select 'open;": "select 'open;", "$$ x; $$;": "$$ x; $$", "a;;": "a;", ";": "", None: None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "a string, want string")
    assert all(r.got == r.want for r in df.select("want", S.normalize_definition("a").alias("got")).collect())
