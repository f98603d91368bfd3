"""Statements of change plans: order within a change, both dialects, and changes that can't be written."""

import pytest

from loomwright.plans import rendering

CHANGE = "comparison_id int, id string, kind string, object_type string, schema_name string, object_key string, path string, automation string, text string, signature string, parent string"
COLUMN = "comparison_id int, side string, object_key string, column_name string, ordinal int, type string, nullable boolean, default_value string, comment string"
CONSTRAINT = "comparison_id int, side string, object_key string, constraint_name string, kind string, columns array<string>, expression string, ref_table string, ref_columns array<string>, on_update string, on_delete string, generated boolean"
INDEX = "comparison_id int, side string, object_key string, index_name string, is_unique boolean, expressions array<string>, predicate string, generated boolean"
SEQUENCE = "comparison_id int, side string, object_key string, start_value string, increment_by string, min_value string, max_value string, cycle boolean, cache_size int"
NO = (None, None, None)


def change(id, kind, object_type, key, path="$object", auto="SAFE_AUTOMATIC", text=None, signature=None, parent=None):
    return (1, id, kind, object_type, "s", key, path, auto, text, signature, parent)


@pytest.fixture(scope="module")
def base(spark):
    columns = [(1, "source", "t", 'a"b', 1, "integer", False, " 0 ", "it's"), (1, "source", "t", "g", 2, "integer", True, "GENERATED ALWAYS AS (1) STORED", None), (1, "target", "t", "g", 2, "bigint", False, "1", "x"), (1, "target", "t", "old", 3, "text", True, None, None), (1, "source", "t", "n", 4, "text", False, None, None), (1, "target", "t", "n", 4, "text", True, "'x'", "c")]
    constraints = [(1, "source", "t", "z_pk", "PRIMARY_KEY", ["a"], *NO, None, None, False), (1, "source", "t", "auto", "UNIQUE", ["n"], *NO, None, None, True), (1, "source", "t", "a_fk", "FOREIGN_KEY", ["a"], None, "u", ["id"], "CASCADE", "SET NULL", False), (1, "source", "t", "ck", "CHECK", None, "a > 0", None, None, None, None, False), (1, "target", "t", "ck", "CHECK", None, "a > 0", None, None, None, None, False), (1, "target", "t", "z_pk", "PRIMARY_KEY", ["b"], *NO, None, None, False), (1, "source", "w", "f", "FOREIGN_KEY", ["a"], None, "u", ["id"], None, "EXPLODE", False), (1, "source", "x", "d", "UNIQUE", ["a"], *NO, None, None, False), (1, "source", "x", "d", "UNIQUE", ["b"], *NO, None, None, False)]
    indexes = [(1, "source", "t", "i", True, ["a", "lower(n)"], "a > 1", False), (1, "source", "t", "made", False, ["a"], None, True), (1, "target", "t", "j", False, ["a"], None, False), (1, "source", "w", "e", False, ["a", " "], None, False)]
    sequences = [(1, "source", "q", "1", "2", None, "9", True, 5), (1, "target", "q", "1", "1", "0", "9", True, 5), (1, "source", "r", "x", "1", None, None, False, None)]
    return [spark.createDataFrame(r, s) for r, s in ((columns, COLUMN), (constraints, CONSTRAINT), (indexes, INDEX), (sequences, SEQUENCE))]


def render(spark, base, *changes, dialect="postgres"):
    rows = rendering.render_statements(spark.createDataFrame(changes, CHANGE), *base, dialect=dialect).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.id, r.step or 0)):
        out.setdefault(r.id, [[], r.destructive, r.error])[0].append(r.sql)
    return out


def test_tables(spark, base):
    got = render(spark, base, change("a", "CREATE", "TABLE", "t"), change("b", "ALTER", "TABLE", "t", "constraints"), change("c", "ALTER", "TABLE", "t", "indexes"), change("d", "CREATE", "TABLE", "none"), change("e", "CREATE", "TABLE", "w"), change("f", "ALTER", "TABLE", "x", "constraints"), change("g", "ALTER", "TABLE", "w", "indexes"))
    fk = 'ALTER TABLE "s"."t" ADD CONSTRAINT "a_fk" FOREIGN KEY ("a") REFERENCES "s"."u" ("id") ON UPDATE CASCADE ON DELETE SET NULL;'
    index = 'CREATE UNIQUE INDEX "s"."i" ON "s"."t" (a, lower(n)) WHERE a > 1;'
    assert got["a"] == [['CREATE TABLE "s"."t" (\n    "a""b" integer DEFAULT 0 NOT NULL,\n    "g" integer GENERATED ALWAYS AS (1) STORED NULL,\n    "n" text NOT NULL,\n    UNIQUE ("n"),\n    CONSTRAINT "ck" CHECK (a > 0),\n    CONSTRAINT "z_pk" PRIMARY KEY ("a")\n);', 'COMMENT ON COLUMN "s"."t"."a""b" IS \'it\'\'s\';', fk, index], False, None]
    # Drops before adds, keys before the foreign keys that may need them; what both sides have alike stays.
    assert got["b"] == [['ALTER TABLE "s"."t" DROP CONSTRAINT "z_pk";', 'ALTER TABLE "s"."t" ADD UNIQUE ("n");', 'ALTER TABLE "s"."t" ADD CONSTRAINT "z_pk" PRIMARY KEY ("a");', fk], True, None]
    assert got["c"] == [['DROP INDEX "s"."j";', index], True, None]
    assert all(got[c] == [[None], False, "UNSUPPORTED_SHAPE"] for c in "defg")


def test_columns(spark, base):
    on = lambda id, path: change(id, "ALTER", "TABLE", "t", path)
    paths = ['columns[a"b]', "columns[old]", "columns[n].nullable", "columns[n].normalizedDefault", "columns[n].comment", "columns[g].dataType", "columns[g].normalizedDefault", "columns[n].dataTyp", "columns[gone]"]
    got = render(spark, base, *(on(str(i), p) for i, p in enumerate(paths)))
    t = 'ALTER TABLE "s"."t" '
    assert got["0"] == [[t + 'ADD COLUMN "a""b" integer DEFAULT 0 NOT NULL;', 'COMMENT ON COLUMN "s"."t"."a""b" IS \'it\'\'s\';'], False, None]
    assert got["1"] == [[t + 'DROP COLUMN "old";'], True, None]
    assert got["2"] == [[t + 'ALTER COLUMN "n" SET NOT NULL;'], True, None]
    assert got["3"] == [[t + 'ALTER COLUMN "n" DROP DEFAULT;'], True, None]
    assert got["4"] == [['COMMENT ON COLUMN "s"."t"."n" IS NULL;'], False, None]
    assert got["5"] == [[t + 'ALTER COLUMN "g" TYPE integer;'], True, None]
    assert [got[i][2] for i in "678"] == ["UNSUPPORTED_SHAPE"] * 3
    ora = render(spark, base, *(on(str(i), p) for i, p in enumerate(paths)), dialect="oracle")
    assert [ora[i][0][0] for i in "02345"] == [t + 'ADD ("a""b" integer DEFAULT 0 NOT NULL);', t + 'MODIFY ("n" NOT NULL);', t + 'MODIFY ("n" DEFAULT NULL);', 'COMMENT ON COLUMN "s"."t"."n" IS \'\';', t + 'MODIFY ("g" integer);']


def test_sequences_and_objects(spark, base):
    seq = lambda id, kind, key, path="$object": change(id, kind, "SEQUENCE", key, path)
    got = render(spark, base, seq("a", "CREATE", "q"), seq("b", "ALTER", "q", "incrementBy"), seq("c", "ALTER", "q", "minimumValue"), seq("d", "ALTER", "q", "maximumValue"), seq("e", "CREATE", "r"), change("f", "DROP", "FUNCTION", "fn", signature="integer, text"), change("g", "DROP", "TRIGGER", "tr", parent="t"), change("h", "REPLACE", "VIEW", "v", text="create view v as select 1"), change("i", "REPLACE", "MATERIALIZED_VIEW", "v", text="create x"), change("j", "DROP", "TABLE", "t", auto="MANUAL_ONLY"), change("k", "CREATE", "TYPE", "y", text=" "))
    assert got["a"] == [['CREATE SEQUENCE "s"."q" START WITH 1 INCREMENT BY 2 MAXVALUE 9 CYCLE CACHE 5;'], False, None]
    assert got["b"] == [['ALTER SEQUENCE "s"."q" INCREMENT BY 2;'], True, None]
    assert got["c"] == [['ALTER SEQUENCE "s"."q" NO MINVALUE;'], True, None]
    assert got["f"] == [['DROP FUNCTION "s"."fn"(integer, text);'], True, None]
    assert got["g"] == [['DROP TRIGGER "tr" ON "s"."t";'], True, None]
    assert got["h"] == [["CREATE OR REPLACE view v as select 1;"], True, None]
    assert [got[i][2] for i in "deik"] == ["UNSUPPORTED_SHAPE"] * 4 and got["j"][2] == "MANUAL" and got["j"][0] == [None]
