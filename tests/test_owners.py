"""Which qualifiers of a definition name its owner."""

import pytest

from loomwright.functions.owners import without_owner
from loomwright.plans import schemadiff


@pytest.mark.parametrize(("mode", "owner", "text", "want"), [
    ("postgres", "app", "select app.t.a, t.b from app.t", "select t.a, t.b from t"),
    ("postgres", "app", 'select "app"."t".a from "app" . "t" join App.u on u.a = app.u.a', 'select "t".a from "t" join u on u.a = u.a'),
    ("postgres", "App", 'select App.a from "App".t app', "select App.a from t app"),
    ("postgres", "App", 'select "App".f(1), app.x from app.t', "select f(1), app.x from app.t"),
    ("postgres", "app", "select 'app.t', $$ app.t $$ /* app.t /* app.u */ */ from app.t -- app.t", "select 'app.t', $$ app.t $$ /* app.t /* app.u */ */ from t -- app.t"),
    ("postgres", "app", "select app.a from other.t app", "select app.a from other.t app"),
    ("postgres", "app", "select app.a from app.t app, app.u as x", "select app.a from t app, u as x"),
    ("postgres", "app", "select app.a from app.app", "select app.a from app"),
    ("postgres", "app", "select x.a, app.f(x.a) from (select app.a from u app) x", "select x.a, f(x.a) from (select app.a from u app) x"),
    ("postgres", "app", "select app.a from t app where exists (select 1 from app.u where u.a = app.a)", "select app.a from t app where exists (select 1 from u where u.a = app.a)"),
    ("postgres", "app", "select app.a from (select 1 as a) as app", "select app.a from (select 1 as a) as app"),
    ("postgres", "app", "nextval('app.s'::regclass)", "nextval('s'::regclass)"),
    ("postgres", "app", "nextval('\"app\".\"S x\"' :: pg_catalog.regclass) || 'app.s'::text", "nextval('\"S x\"' :: pg_catalog.regclass) || 'app.s'::text"),
    ("postgres", "app", "nextval('b.s'::regclass)", "nextval('b.s'::regclass)"),
    ("postgres", "app", "select b.app.c from b.app", "select b.app.c from b.app"),
    ("postgres", "app", "create view app.v as select * from app.t", "create view v as select * from t"),
    ("postgres", "app", "create trigger g after insert on app.t for each row execute function app.f()", "create trigger g after insert on t for each row execute function f()"),
    ("postgres", "app", "insert into app.t select 1; update app.u set a = app.f(2) where u.b = 1", "insert into t select 1; update u set a = f(2) where u.b = 1"),
    ("postgres", "app", "select app.f(1) from t app", None),
    ("postgres", "app", "select app.t /* open", None),
    ("postgres", "app", "select e'it\\'s app.t' from app.t", "select e'it\\'s app.t' from t"),
    ("oracle", "APP", 'select app.t.a from App.t, "APP".u, "app".w', 'select t.a from t, u, "app".w'),
    ("oracle", "APP", "select q'[app.t]' from app.t", "select q'[app.t]' from t"),
    ("postgres", "app", None, None),
    ("postgres", "app", "", ""),
])
def test_owner(mode, owner, text, want):
    assert without_owner(text, owner, mode) == want


def test_two_owners_compare_equal(spark):
    """The same view under two owners, one of which names an alias like its owner."""
    rows = [(1, side, "VIEW", owner, owner, "v", f"select {owner}.t.a, x.b from {owner}.t join {owner}.u as x on x.a = t.a where x.c = '{'same.t'}'", "HIGH") for side, owner in (("source", "s1"), ("target", "s2"))]
    rows += [(2, side, "VIEW", owner, owner, "w", f"select {owner}.f(1) from t {owner}", "HIGH") for side, owner in (("source", "s1"), ("target", "s2"))]
    df = spark.createDataFrame(rows, "comparison_id int, side string, object_type string, owner string, schema_name string, object_name string, definition string, confidence string")
    out = {(r.comparison_id, r.side): r.definition for r in schemadiff.project_owner(df).collect()}
    assert out[1, "source"] == out[1, "target"] == "select t.a, x.b from t join u as x on x.a = t.a where x.c = 'same.t'"
    assert out[2, "source"].startswith("sha256:") and out[2, "source"] != out[2, "target"]
