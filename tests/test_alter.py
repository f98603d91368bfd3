"""Alter scripts of wide tables, and of names that occur twice or are null."""

import time

from pyspark.sql import functions as F

from loomwright.plans import catalog

ITEM = "struct<column_name:string,type:string,nullable:boolean,default_value:string,comment:string>"
DRAFT = f"schema_name string, table_name string, columns array<{ITEM}>, indexes array<struct<index_name:string,is_unique:boolean,columns:array<string>>>, pk_name string, pk array<string>"


def test_a_very_wide_table(spark):
    """20,000 columns on both sides; names are matched without comparing all pairs (which takes minutes)."""
    n = 20_000
    item = lambda i, kind: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("column_name"), kind.alias("type"), F.lit(True).alias("nullable"), F.lit(None).cast("string").alias("default_value"), F.lit(None).cast("string").alias("comment")).cast(ITEM)
    side = lambda first, kind: spark.range(1).select(F.lit("s").alias("schema_name"), F.lit("t").alias("table_name"), F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda i: item(i, kind(i))).alias("columns"), F.expr("cast(array() as array<struct<index_name:string,is_unique:boolean,columns:array<string>>>)").alias("indexes"), F.lit(None).cast("string").alias("pk_name"), F.expr("cast(array() as array<string>)").alias("pk"))
    begun = time.monotonic()
    lines = catalog.alter_script(side(1, lambda i: F.lit("int")), side(2, lambda i: F.when(i % 2 == 0, "INT ").otherwise("text"))).first().script.split("\n")
    assert time.monotonic() - begun < 45
    want = [f'ALTER TABLE "s"."t" ALTER COLUMN "c{i}" TYPE text;' for i in range(3, n + 1, 2)] + [f'ALTER TABLE "s"."t" ADD COLUMN "c{n + 1}" text;', 'ALTER TABLE "s"."t" DROP COLUMN "c1";']
    assert lines == want


def test_names_that_occur_twice_and_null_ones(spark):
    before = [("s", "t", [("a", "int", True, None, "x"), ("a", "text", True, None, None), ("b", "int", True, None, None), (None, "int", True, None, None)], [("i", False, ["a"]), ("k", False, ["a"])], None, ["a"]), ("s", "gone", [], [], None, [])]
    after = [("s", "t", [("z", "int", True, None, None), ("a", "text", True, None, "x"), (None, "int", True, None, None)], [("i", True, ["a"])], None, ["a"]), ("s", "new", [], [], None, [])]
    out = catalog.alter_script(spark.createDataFrame(before, DRAFT), spark.createDataFrame(after, DRAFT)).collect()
    assert [(r.schema_name, r.table_name) for r in out] == [("s", "t")]
    t = 'ALTER TABLE "s"."t" '
    assert out[0].script.split("\n") == [t + 'ADD COLUMN "z" int;', t + 'ALTER COLUMN "a" TYPE text;', t + 'DROP COLUMN "b";', 'DROP INDEX "s"."i";', 'CREATE UNIQUE INDEX "i" ON "s"."t" ("a");', 'DROP INDEX "s"."k";']
    same = spark.createDataFrame(before, DRAFT)
    assert {r.table_name: r.script for r in catalog.alter_script(same, same).collect()}.get("gone") == ""
