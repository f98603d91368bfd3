"""Exact values of functions, edits, exports, keyspaces and drafts on small tables."""

import glob
import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions import scalars as S
from loomwright.operators import browse, edits, exports, keyspace, migration, sqllog
from loomwright.plans import catalog
from loomwright.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("text", "kind", "want", "bad"), [(None, "varchar", None, False), ("123", "integer", "123.0000000000", False), ("1.5", "decimal", "1.5000000000", False), ("  ", "bigint", None, False), ("true", "boolean", "true", False), ("1", "boolean", "true", False), ("f", "bit", "false", False), ("", "varchar", "", False), ("2024-01-02", "date", "2024-01-02", False), ("2024-01-02", "timestamp", "2024-01-02 00:00:00", False), ("abc", "integer", None, True), ("maybe", "boolean", None, True), ("b0a1", "other", "b0a1", False), ("12:30:00", "time", "12:30:00", False)])
def test_coercion(spark, text, kind, want, bad):
    c = F.lit(text).cast("string")
    assert one(spark, S.coerce_text(c, kind).cast("string")) == want
    assert one(spark, S.coerce_error(c, kind)) is bad


def test_dump_strings_round_trip(spark):
    texts = ["a\\n'b'\n\t\r\\", "\\\\n", "''", "", "plain", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("back", S.unescape_dump_string(S.escape_dump_string("t")))
    assert all(r.t == r.back for r in df.collect())


def test_names():
    assert S.xml_name("COUNT(*)") == "COUNT___" and S.xml_name("user id") == "user_id" and S.xml_name("") == "COLUMN" and S.xml_name("1a") == "_a"


def test_cells(spark):
    assert [one(spark, S.cell_ref(i, 7)) for i in (0, 25, 26, 701, 702)] == ["A7", "Z7", "AA7", "ZZ7", "AAA7"]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "Tom"), (2, 'say "hi"\nok'), (None, "a,b"), (4, None)], "ID int, NAME string").coalesce(1)
    assert [r.line for r in exports.csv_lines(df).collect()] == ["1,Tom", '2,"say ""hi""\nok"', ',"a,b"', "4,"]
    exports.write_csv(df, str(tmp_path / "csv"))
    data = open(glob.glob(f"{tmp_path}/csv/part-*")[0], "rb").read().decode()
    assert data == '﻿ID,NAME\r\n1,Tom\r\n2,"say ""hi""\nok"\r\n,"a,b"\r\n4,\r\n'


def test_markup(spark, tmp_path):
    df = spark.createDataFrame([("a\0b\tc", 'x&"y"'), (None, "<")], "`COUNT(*)` string, `A<B` string")
    assert exports.xml_rows(df).first().line == ' <ROW>\n  <COUNT___ name="COUNT(*)">ab\tc</COUNT___>\n  <A_B name="A&lt;B">x&amp;&quot;y&quot;</A_B>\n </ROW>'
    assert exports.html_rows(df).collect()[1].line == "<tr><td></td><td>&lt;</td></tr>"
    exports.write_html(df.coalesce(1), str(tmp_path / "html"), "t & u")
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/html/part-*")))
    assert text.startswith("<!DOCTYPE html>") and "<title>t &amp; u</title>" in text and text.endswith("</html>\n") and text.count("<tr>") == 3


def test_workbooks(spark):
    df = spark.createDataFrame([(i, f"n{i}", i % 2 == 0) for i in range(25)], "id int, name string, flag boolean")
    books = exports.workbooks(df, [("id", True)], 10).orderBy("part").collect()
    assert [b.part for b in books] == [0, 1, 2]
    sheet = zipfile.ZipFile(io.BytesIO(books[0].book)).read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row") == 11 and '<c r="A2"><v>0</v></c>' in sheet and '<c r="C2" t="b"><v>1</v></c>' in sheet


def test_scripts(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 2 else f"o'{i}") for i in range(5)], "id int, `a b` string")
    lines = exports.insert_script(df, None, "t", [("id", True)], batch=2).orderBy("batch_no").collect()
    assert lines[1].line == 'INSERT INTO "t" ("id", "a b") VALUES\n  (2, NULL),\n  (3, \'o\'\'3\');'
    assert exports.script_header("s", "t", "CREATE TABLE t ()") == "-- table: s.t\n\nCREATE TABLE t ();\n\n"
    exports.export_table(df, "sql", str(tmp_path / "sql"), [("id", True)], "t")
    assert "INSERT" in "".join(open(p).read() for p in glob.glob(f"{tmp_path}/sql/part-*"))


def test_dump_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "it's; a\\b\n(x, y)"), (2, None), (3, "")], "id int, name string")
    lines = exports.migration_dump(df, "T1", {"id": ("NUMBER", 10, 0), "name": ("VARCHAR2", 0, 0)}, [("id", True)])
    lines.orderBy("seq").select("line").coalesce(1).write.text(str(tmp_path / "t1"))
    path = glob.glob(f"{tmp_path}/t1/part-*")[0]
    assert [x for x in open(path).read().splitlines() if x == "COMMIT;"] == ["COMMIT;"]
    (tmp_path / "t1.sql").write_text(open(path).read() + "-- end\nINSERT INTO t1 (id, name) VALUES (x, 'y');\n")
    back, rejects = readers.scan_insert_script(spark, str(tmp_path / "t1.sql"), T.StructType.fromDDL("id int, name string"))
    assert sorted((r.table_name, r.id, r.name) for r in back.collect()) == sorted([("t1", 1, "it's; a\\b\n(x, y)"), ("t1", 2, None), ("t1", 3, "")], key=str)
    assert rejects.count() == 1


def test_key_tree(spark):
    tree = lambda keys, sep=":": {tuple(r.path): (r.full_key, r.key_count) for r in keyspace.key_tree(spark.createDataFrame([(k,) for k in keys], "key string"), sep).collect()}
    t = tree(["user:2:name", "user:1", "order:9"])
    assert t["user",] == (None, 2) and t["user", "2"] == (None, 1) and t["user", "1"] == ("user:1", 1) and t[()] == (None, 3)
    t = tree(["user", "user:name"])
    assert t["user",] == ("user", 2)
    t = tree(["a//b", "a//b", "plain", None], "/")
    assert t[()] == (None, 2) and t["a", ""] == (None, 1) and t["a", "", "b"] == ("a//b", 1)
    assert tree(["b:c", "a:c"], "")["b:c",] == ("b:c", 1)


def test_edits(spark):
    df = spark.createDataFrame([("x", None, 1), ("x", "k", 2), ("y", "k", 3), ("y", "k", 4)], "a string, b string, v int")
    rows = [(1, 1, ("x", None), {"v": "10"}), (2, 2, ("y", "k"), {"v": "0"}), (3, 3, ("z", None), {"v": "0"}), (4, 4, ("x", "k"), {"v": None})]
    told = spark.createDataFrame(rows, "edit_id int, edit_seq int, key struct<a:string,b:string>, values map<string,string>")
    out, outcomes = edits.apply_updates(df, told, ["a", "b"])
    assert sorted(((r.a, r.b, r.v) for r in out.collect()), key=str) == sorted([("x", None, 10), ("x", "k", None), ("y", "k", 3), ("y", "k", 4)], key=str)
    assert {r.edit_id: r.status for r in outcomes.collect()} == {1: "APPLIED", 2: "AMBIGUOUS", 3: "STALE", 4: "APPLIED"}
    left, outcomes = edits.apply_ordered_deletes(df, told, ["a", "b"])
    assert left.count() == 3 and {r.edit_id: r.status for r in outcomes.collect()} == {1: "APPLIED", 2: "AMBIGUOUS", 3: "SKIPPED", 4: "SKIPPED"}
    schema = T.StructType.fromDDL("id int, at timestamp, raw binary, name string")
    assert edits.derive_row_key(schema, ["id"]) == (["id"], None)
    assert edits.derive_row_key(schema)[0] == ["id", "name"] and edits.derive_row_key(schema, ["id"], True)[0] == []


def test_table_drafts(spark):
    col = "struct<column_name:string,type:string,nullable:boolean,default_value:string,comment:string>"
    schema = f"schema_name string, table_name string, columns array<{col}>, indexes array<struct<index_name:string,is_unique:boolean,columns:array<string>>>, pk_name string, pk array<string>"
    draft = lambda cols, idx=(), pk_name="t_pk", pk=("id",): spark.createDataFrame([("s", "t", cols, list(idx), pk_name, list(pk))], schema)
    base = [("id", "integer", False, None, None)]
    script = lambda a, b, d="postgres": catalog.alter_script(a, b, d).first().script
    assert script(draft(base), draft(base)) == ""
    assert script(draft(base), draft([*base, ("age", "integer", True, None, None)])) == 'ALTER TABLE "s"."t" ADD COLUMN "age" integer;'
    assert script(draft([*base, ("age", "integer", True, None, None)]), draft(base)) == 'ALTER TABLE "s"."t" DROP COLUMN "age";'
    changed = script(draft([("n", "integer", True, None, None)]), draft([("n", "bigint", False, "0", "c")]))
    assert changed.split("\n") == ['ALTER TABLE "s"."t" ALTER COLUMN "n" TYPE bigint;', 'ALTER TABLE "s"."t" ALTER COLUMN "n" SET NOT NULL;', 'ALTER TABLE "s"."t" ALTER COLUMN "n" SET DEFAULT 0;', 'COMMENT ON COLUMN "s"."t"."n" IS \'c\';']
    assert script(draft(base), draft(base, pk=("id", "k"))).split("\n") == ['ALTER TABLE "s"."t" DROP CONSTRAINT "t_pk";', 'ALTER TABLE "s"."t" ADD PRIMARY KEY ("id", "k");']
    assert script(draft(base, [("old_ix", False, ["id"])]), draft(base, [("new_ix", False, ["id"])])).split("\n") == ['CREATE INDEX "new_ix" ON "s"."t" ("id");', 'DROP INDEX "s"."old_ix";']
    assert script(draft([("n", "number", True, "1", None)]), draft([("n", "number", False, None, None)]), "oracle") == 'ALTER TABLE "s"."t" MODIFY ("n" DEFAULT NULL NOT NULL);'


def test_fingerprints_ignore_order_and_see_every_field(spark):
    rows = [(1, i % 3, f"k{i}", f"b{i}") for i in range(20)]
    make = lambda rows: catalog.fingerprint(spark.createDataFrame(rows, "snapshot_id int, type_rank int, object_key string, body string")).first().fingerprint
    assert make(rows) == make(rows[::-1])
    for k in range(1, 4):
        other = [list(r) for r in rows]
        other[7][k] = 99 if k == 1 else None
        assert make([tuple(r) for r in other]) != make(rows)


def test_completeness_rejects_other_codes(spark):
    rows = spark.createDataFrame([(1, "TABLE", "NOT_SUPPORTED"), (1, "TABLE", "PERMISSION_DENIED"), (1, "VIEW", None)], "snapshot_id int, object_type string, code string")
    assert [tuple(r) for r in catalog.snapshot_completeness(rows).collect()] == [(1, "TABLE", "PERMISSION_DENIED")]
    with pytest.raises(Exception, match="unknown code"):
        catalog.snapshot_completeness(rows.withColumn("code", F.lit("ODD"))).collect()


@pytest.mark.parametrize(("mode", "script", "want"), [("postgres", "", []), ("postgres", "a;;b", ["a", "b"]), ("postgres", "select 'a;''b';x", ["select 'a;''b'", "x"]), ("postgres", "-- only\n; /* c; */", []), ("postgres", "$t$ ; $t$;y", ["$t$ ; $t$", "y"]), ("postgres", "select \"a;b\"; z", ['select "a;b"', "z"]), ("oracle", "begin a; b; end;\n/\nselect 1;", ["begin a; b; end;", "select 1"]), ("oracle", "select q'[it's;]' from d;x", ["select q'[it's;]' from d", "x"])])
def test_statements(spark, mode, script, want):
    df = spark.createDataFrame([(1, script)], "script_id int, script string")
    assert [r.sql for r in sqllog.split_statements(df, mode).orderBy("idx").collect()] == want


@pytest.mark.parametrize(("sql", "kind", "risks"), [("select * from t", "READ", []), ("UPDATE t SET a = 1", "WRITE", ["MISSING_WHERE"]), ("delete from t where a = 'x'", "WRITE", []), ("update t set a = 'where'", "WRITE", ["MISSING_WHERE"]), ("truncate t", "DDL", ["DESTRUCTIVE_DDL"]), ("with x as (delete from t where a = 1 returning *) select * from x", "WRITE", []), ("explain select 1", "READ", []), ("explain analyze delete from t", "WRITE", ["MISSING_WHERE"]), ("commit", "TRANSACTION_CONTROL", []), ("begin", "TRANSACTION_CONTROL", ["SESSION_STATE_CONFLICT"]), ("nonsense", "UNKNOWN", ["UNKNOWN_STATEMENT"]), ("/* delete */ select 1", "READ", [])])
def test_kinds(spark, sql, kind, risks):
    r = sqllog.classify_statements(spark.createDataFrame([(1, 1, sql)], "script_id int, idx int, sql string")).first()
    assert (r.kind, r.risks) == (kind, risks)


def test_comments_travel(spark):
    df = browse.attach_comments(spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([("a", "first"), ("b", ""), ("z", "x")], "column_name string, comment string"))
    assert browse.comments_of(df.select("b", "a"))["comment"].tolist() == [None, "first"]


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.range(100).select(F.col("id").alias("ID"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("NAME"))
    exports.write_jdbc(df, url, "APP.T", partitions=2, properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    back = readers.scan_table(spark, url, "APP.T", "ID", (0, 100), 4)
    assert back.rdd.getNumPartitions() == 4 and back.count() == 100
    names = spark.createDataFrame([("APP", "T"), ("APP", "DR$X"), ("X", "U")], "owner string, table_name string")
    assert {k: v.count() for k, v in readers.scan_schema(spark, url, names, "APP").items()} == {"T": 100}


def test_loads(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS target")
    df = spark.createDataFrame([(1, "1.50")], "ID int, AMOUNT string")
    types = {"T_LOAD": {"ID": ("INTEGER", 0, 0), "AMOUNT": ("NUMBER", 10, 2)}}
    for _ in range(2):
        assert [tuple(r) for r in migration.run_all(spark, {"T_LOAD": df}, "target", types).collect()] == [("t_load", 1)]
    assert migration.load(spark, {"T_LOAD": df}, "target", "incremental") == {"T_LOAD": "SKIPPED"}
    rows = readers.scan_catalog(spark).where("schema_name = 'target'").orderBy("ordinal").collect()
    assert [(r.table_name, r.column_name, r.data_type) for r in rows] == [("t_load", "id", "int"), ("t_load", "amount", "decimal(10,2)")]
    spark.sql("DROP DATABASE target CASCADE")


def test_keyspace_dump_and_sql(spark, tmp_path):
    spark.createDataFrame([("a:1",), ("b:1",)], "key string").write.parquet(str(tmp_path / "keys"))
    assert [r.key for r in readers.scan_keyspace(spark, str(tmp_path / "keys"), "a*").collect()] == ["a:1"]
    assert readers.scan_keyspace(spark, str(tmp_path / "keys"), " ").count() == 2
    assert readers.run_sql(spark, "select * from range(10)", 3).count() == 3 and readers.run_sql(spark, "select * from range(10)", 0).count() == 10
    (tmp_path / "h").write_text("5|Yw==||c2VsZWN0IDE=\nbad\n6|Yw==|cw==|IA==\n")
    assert [tuple(r) for r in readers.scan_history(spark, str(tmp_path / "h")).collect()] == [(5, "c", None, "select 1")]
