"""Queries over catalogs, schema comparisons and change plans, with catalogs made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import catalog, changeplan, dependencies, rendering, schemadiff
from .registry import query, table

# A nation is a schema, a customer's segment a table, a customer a column.
_C = "(SELECT 'n' || c_nationkey AS schema_name, lower(c_mktsegment) AS table_name, 'c' || c_custkey AS column_name, c_custkey AS ordinal FROM customer)"


def columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("schema_name"), F.lower("c_mktsegment").alias("table_name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("column_name"), F.col("c_custkey").alias("ordinal"))


@query("a1_columns_with_keys", f"SELECT *, ordinal % 4 = 0 AS is_key, CASE WHEN ordinal % 3 = 1 THEN 'note' END AS comment FROM {_C}")
def a1(spark: SparkSession, d: str) -> DataFrame:
    c = columns(spark, d)
    return catalog.columns_with_keys(c, c.where("ordinal % 4 = 0"), c.where("ordinal % 3 < 2").withColumn("comment", F.when(F.col("ordinal") % 3 == 1, "note").otherwise("")))


_COLS = "string_agg(column_name, ',' ORDER BY ordinal)"


@query("a2_indexes_rollup", f"SELECT schema_name, table_name, 'i' || ordinal % 3 AS index_name, ordinal % 3 = 0 AS is_unique, {_COLS} AS columns FROM {_C} GROUP BY ALL")
def a2(spark: SparkSession, d: str) -> DataFrame:
    rows = columns(spark, d).withColumns({"index_name": F.concat(F.lit("i"), (F.col("ordinal") % 3).cast("string")), "is_unique": F.col("ordinal") % 3 == 0, "position": F.col("ordinal")})
    return catalog.indexes_rollup(rows).withColumn("columns", F.array_join("columns", ","))


_K3 = "(SELECT *, 'k_' || table_name || '_' || ordinal % 4 AS constraint_name, ordinal % 4 AS k FROM " + _C + ")"


@query("a3_constraints_rollup", f"SELECT schema_name, table_name, constraint_name, CASE k WHEN 0 THEN 'PRIMARY KEY' WHEN 1 THEN 'UNIQUE' WHEN 2 THEN 'FOREIGN KEY' ELSE 'CHECK' END AS type, CASE WHEN k = 3 THEN '' ELSE {_COLS} END AS columns FROM {_K3} GROUP BY schema_name, table_name, constraint_name, k")
def a3(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("ordinal") % 4).cast("int")
    rows = columns(spark, d).withColumns({"constraint_name": F.concat(F.lit("k_"), "table_name", F.lit("_"), k.cast("string")), "type": F.get(F.array(*map(F.lit, ("PRIMARY KEY", "UNIQUE", "FOREIGN KEY", "x"))), k), "position": F.col("ordinal")})
    out = catalog.constraints_rollup(rows.select("schema_name", "table_name", "constraint_name", "type").distinct(), rows.where(k < 3))
    return out.withColumn("columns", F.array_join("columns", ","))


@query("a4_sequence_next", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN 99999999999999999999 + c_custkey ELSE 5 END AS VARCHAR) AS next_value FROM customer")
def a4(spark: SparkSession, d: str) -> DataFrame:
    last = F.when(F.col("c_custkey") % 2 == 0, F.lit("99999999999999999999").cast("decimal(38,0)"))
    rows = table(spark, d, "customer").select("c_custkey", last.alias("last_value"), F.col("c_custkey").alias("increment_by"), F.lit(5).alias("start_value"))
    return catalog.sequence_next(rows).select("c_custkey", F.col("next_value").cast("string").alias("next_value"))


@query("a5_routines", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'PROCEDURE' ELSE 'FUNCTION' END AS kind FROM events")
def a5(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("procedure", "FUNCTION", "aggregate")))
    return catalog.routines(table(spark, d, "events").select("event_id", F.get(kinds, (F.col("event_id") % 3).cast("int")).alias("routine_type"))).select("event_id", "kind")


def drafts(spark: SparkSession, d: str, edited: bool = False) -> DataFrame:
    c = columns(spark, d)
    o = F.col("ordinal")
    if edited:
        c = c.where(o % 11 != 0)
    c = c.withColumns({"type": F.when((o % 5 == 0) & F.lit(edited), "bigint").otherwise("integer"), "nullable": o % 2 == 0, "default_value": F.when((o % 7 == 0) & F.lit(edited), " 0 "), "comment": F.when(o % 3 == 1, "it's"), "is_key": o % 4 == 0})
    i = c.where(o % 6 == 0).groupBy("schema_name", "table_name").agg(F.concat(F.lit("ix_"), F.first("table_name")).alias("index_name"), F.lit(edited).alias("is_unique"), F.sort_array(F.collect_list("column_name")).alias("columns"))
    pk = c.where("table_name = 'building'").select("schema_name", "table_name", F.lit("pk_b").alias("constraint_name"), F.lit("PRIMARY KEY").alias("type")).distinct().withColumn("columns", F.array(F.lit("c1")))
    return catalog.table_draft(c, i, pk)


_D = f"(SELECT *, ordinal % 2 = 0 AS nullable, CASE WHEN ordinal % 3 = 1 THEN 'it''s' END AS comment FROM {_C})"
_PK = "CASE WHEN table_name = 'building' THEN '\"c1\"' ELSE string_agg('\"' || column_name || '\"', ', ' ORDER BY ordinal) FILTER (ordinal % 4 = 0) END"


@query("a6_table_draft", f"SELECT schema_name, table_name, count(*) AS n_columns, CASE WHEN table_name = 'building' THEN 'pk_b' END AS pk_name, replace({_PK}, '\"', '') AS pk, coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (ordinal % 6 = 0), '') AS index_columns FROM {_D} GROUP BY schema_name, table_name")
def a6(spark: SparkSession, d: str) -> DataFrame:
    first = F.get("indexes", F.lit(0))["columns"]
    return drafts(spark, d).select("schema_name", "table_name", F.size("columns").cast("long").alias("n_columns"), "pk_name", F.nullif(F.array_join("pk", ", "), F.lit("")).alias("pk"), F.coalesce(F.array_join(first, ","), F.lit("")).alias("index_columns"))


@query("a7_table_ddl", f"SELECT schema_name, table_name, 'CREATE TABLE \"' || schema_name || '\".\"' || table_name || '\" (' || chr(10) || string_agg('    \"' || column_name || '\" ' || CASE WHEN ordinal % 2 = 0 THEN 'character varying(9)' ELSE 'numeric(9,2) NOT NULL' END || CASE WHEN ordinal % 7 = 0 THEN ' DEFAULT 0' ELSE '' END, ',' || chr(10) ORDER BY ordinal) || ',' || chr(10) || '    CONSTRAINT \"pk\" PRIMARY KEY (\"a\", \"b\")' || chr(10) || ');' AS ddl FROM {_C} GROUP BY schema_name, table_name")
def a7(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("ordinal")
    c = columns(spark, d).withColumns({"base": F.when(o % 2 == 0, "character varying").otherwise("numeric"), "length": F.lit(9), "precision": F.lit(9), "scale": F.lit(2), "nullable": o % 2 == 0, "default_value": F.when(o % 7 == 0, "0")})
    keys = c.select("schema_name", "table_name").distinct().withColumns({"constraint_name": F.lit("pk"), "columns": F.array(F.lit("a"), F.lit("b"))})
    return catalog.table_ddl(c, keys)


_NAME = "'\"' || schema_name || '\".\"' || table_name || '\"'"
_NOTES = f"coalesce(chr(10) || string_agg('COMMENT ON COLUMN ' || {_NAME} || '.\"' || column_name || '\" IS ''it''''s'';', chr(10) ORDER BY ordinal) FILTER (ordinal % 3 = 1), '')"
_IX = f"coalesce(chr(10) || 'CREATE INDEX \"ix_' || table_name || '\" ON ' || {_NAME} || ' (' || string_agg('\"' || column_name || '\"', ', ' ORDER BY column_name) FILTER (ordinal % 6 = 0) || ');', '')"


@query("a8_create_script", f"SELECT schema_name, table_name, 'CREATE TABLE ' || {_NAME} || ' (' || chr(10) || string_agg('    \"' || column_name || '\" integer' || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END, ',' || chr(10) ORDER BY ordinal) || coalesce(',' || chr(10) || '    PRIMARY KEY (' || {_PK} || ')', '') || chr(10) || ');' || {_NOTES} || {_IX} AS script FROM {_D} GROUP BY schema_name, table_name")
def a8(spark: SparkSession, d: str) -> DataFrame:
    # The keys of these scripts have no names; those of a8_create_named have.
    return catalog.create_script(drafts(spark, d).withColumn("pk_name", F.lit(None).cast("string")))


@query("a8_create_named", f"SELECT schema_name, table_name, 'CREATE TABLE ' || {_NAME} || ' (' || chr(10) || string_agg('    \"' || column_name || '\" integer' || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END, ',' || chr(10) ORDER BY ordinal) || coalesce(',' || chr(10) || '    ' || CASE WHEN table_name = 'building' THEN 'CONSTRAINT \"pk_b\" ' ELSE '' END || 'PRIMARY KEY (' || {_PK} || ')', '') || chr(10) || ');' || chr(10) || 'COMMENT ON TABLE ' || {_NAME} || ' IS ' || chr(39) || table_name || chr(39) || ';' || {_NOTES} || replace({_IX}, '\"ix_', '\"' || schema_name || '\".\"ix_') AS script FROM {_D} GROUP BY schema_name, table_name")
def a8_named(spark: SparkSession, d: str) -> DataFrame:
    return catalog.create_script(drafts(spark, d).withColumn("comment", F.col("table_name")), "oracle")


@query("a9_alter_script", f"""WITH s AS (
 SELECT schema_name, table_name, 1 AS g, ordinal AS o, CASE WHEN ordinal % 5 = 0 THEN 'ALTER TABLE ' || {_NAME} || ' ALTER COLUMN "' || column_name || '" TYPE bigint;' END AS t FROM {_C} WHERE ordinal % 11 <> 0
 UNION ALL SELECT schema_name, table_name, 1, ordinal + 0.5, CASE WHEN ordinal % 7 = 0 THEN 'ALTER TABLE ' || {_NAME} || ' ALTER COLUMN "' || column_name || '" SET DEFAULT 0;' END FROM {_C} WHERE ordinal % 11 <> 0
 UNION ALL SELECT schema_name, table_name, 2, ordinal, 'ALTER TABLE ' || {_NAME} || ' DROP COLUMN "' || column_name || '";' FROM {_C} WHERE ordinal % 11 = 0
 UNION ALL SELECT schema_name, table_name, 3, 0, CASE WHEN count(*) FILTER (ordinal % 44 = 0) > 0 AND table_name <> 'building' THEN '-- drop the old primary key by hand: its name is unknown' END FROM {_C} GROUP BY schema_name, table_name
 UNION ALL SELECT schema_name, table_name, 3, 1, CASE WHEN count(*) FILTER (ordinal % 44 = 0) > 0 AND table_name <> 'building' THEN 'ALTER TABLE ' || {_NAME} || ' ADD PRIMARY KEY (' || string_agg('"' || column_name || '"', ', ' ORDER BY ordinal) FILTER (ordinal % 4 = 0 AND ordinal % 11 <> 0) || ');' END FROM {_C} GROUP BY schema_name, table_name
 UNION ALL SELECT schema_name, table_name, 4, 0, CASE WHEN count(*) FILTER (ordinal % 6 = 0) > 0 THEN 'DROP INDEX "' || schema_name || '"."ix_' || table_name || '";' END FROM {_C} GROUP BY schema_name, table_name
 UNION ALL SELECT schema_name, table_name, 4, 1, 'CREATE UNIQUE INDEX "ix_' || table_name || '" ON ' || {_NAME} || ' (' || string_agg('"' || column_name || '"', ', ' ORDER BY column_name) || ');' FROM {_C} WHERE ordinal % 6 = 0 AND ordinal % 11 <> 0 GROUP BY schema_name, table_name
) SELECT schema_name, table_name, coalesce(string_agg(t, chr(10) ORDER BY g, o), '') AS script FROM s SEMI JOIN (SELECT schema_name, table_name FROM {_C} WHERE ordinal % 11 <> 0) USING (schema_name, table_name) GROUP BY schema_name, table_name""")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return catalog.alter_script(drafts(spark, d), drafts(spark, d, True))


@query("a10_alter_sequence", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'ALTER SEQUENCE \"s\".\"q' || c_custkey || '\" INCREMENT BY 2 CACHE 1 CYCLE;' ELSE 'ALTER SEQUENCE \"s\".\"q' || c_custkey || '\" MAXVALUE 9 RESTART WITH 7;' END AS script FROM customer")
def a10(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    base = table(spark, d, "customer").select("c_custkey", F.lit("s").alias("schema_name"), F.concat(F.lit("q"), F.col("c_custkey").cast("string")).alias("sequence_name"))
    before = base.withColumns({"increment_by": F.lit("1"), "min_value": F.lit("1"), "max_value": F.lit(" 99"), "cache_size": F.lit(20), "cycle": F.lit(False), "next_value": F.lit("5")})
    after = before.withColumns({"increment_by": F.when(k == 1, "2").otherwise(" 1 "), "max_value": F.when(k == 2, "9").otherwise("99"), "cache_size": F.when(k == 1, 0).otherwise(20), "cycle": k == 1, "next_value": F.when(k == 2, "7").otherwise("5")})
    return catalog.alter_sequence_script(before, after).select(F.regexp_extract("sequence_name", r"(\d+)", 1).cast("long").alias("c_custkey"), "script")


@query("a11_object_counts", "SELECT 'n' || c_nationkey AS schema_name, c_mktsegment AS object_type, count(*) AS n_objects FROM customer GROUP BY ALL")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return catalog.object_counts(table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("schema_name"), F.col("c_mktsegment").alias("object_type")))


@query("a12_snapshot_columns", "SELECT p_partkey, (['character varying','numeric','timestamp','integer'])[1 + p_partkey % 4] AS base_type, CASE WHEN p_partkey % 4 = 0 THEN p_size END AS length, CASE p_partkey % 4 WHEN 1 THEN p_size WHEN 2 THEN 3 END AS precision, CASE WHEN p_partkey % 4 = 1 THEN 2 END AS scale, p_partkey % 4 = 2 AS with_tz, CASE WHEN p_partkey % 4 = 3 THEN 2 ELSE 0 END AS dims, CASE WHEN p_partkey % 3 = 0 THEN 'GENERATED ALWAYS AS IDENTITY' WHEN p_partkey % 3 = 1 THEN 'GENERATED ALWAYS AS (a + 1) STORED' ELSE '0' END AS default_value FROM part")
def a12(spark: SparkSession, d: str) -> DataFrame:
    k, g, size = (F.col("p_partkey") % 4).cast("int"), F.col("p_partkey") % 3, F.col("p_size").cast("string")
    kind = F.get(F.array(F.concat(F.lit("character varying("), size, F.lit(")")), F.concat(F.lit(" NUMERIC("), size, F.lit(",2)")), F.lit("timestamp(3) with time zone"), F.lit("integer[][]")), k)
    raw = table(spark, d, "part").select(F.col("p_partkey").alias("snapshot_id"), F.lit("t").alias("object_key"), F.lit("c").alias("column_name"), F.lit(1).alias("ordinal"), F.lit(True).alias("nullable"), kind.alias("type"), F.when(g == 0, "ALWAYS").alias("identity"), F.when(g == 1, "a + 1").alias("generated"), F.when(g == 2, "0").alias("default_value"), F.lit("").alias("comment"))
    return catalog.snapshot_columns(raw).select(F.col("snapshot_id").alias("p_partkey"), "base_type", "length", "precision", "scale", "with_tz", "dims", "default_value")


def raw_constraints(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    text = lambda p: F.concat(F.lit(p), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select(F.col("p_size").alias("snapshot_id"), text("t").alias("object_key"), text("fk").alias("constraint_name"), F.lit("FOREIGN_KEY").alias("kind"), F.when(k == 0, text("t")).when(k == 1, F.lit("t1")).alias("ref_table"), F.lit("CASCADE").alias("on_update"), F.lit("RESTRICT").alias("on_delete"), F.array(F.lit("b"), F.lit("a")).alias("columns"), F.when(k < 2, F.array(F.lit("y"), F.lit("x"))).otherwise(F.expr("cast(array() as array<string>)")).alias("ref_columns"))


@query("a13_snapshot_constraints", "SELECT p_size AS snapshot_id, 't' || p_partkey AS object_key, 'b,a' AS columns, CASE WHEN p_partkey % 3 < 2 THEN 'y,x' ELSE '' END AS ref_columns, CASE p_partkey % 3 WHEN 0 THEN 't' || p_partkey WHEN 1 THEN 't1' END AS ref_table FROM part")
def a13(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.snapshot_constraints(raw_constraints(spark, d))[0]
    return out.select("snapshot_id", "object_key", F.array_join("columns", ",").alias("columns"), F.array_join("ref_columns", ",").alias("ref_columns"), "ref_table")


@query("a14_snapshot_indexes", "SELECT p_size AS snapshot_id, 'ix' || p_partkey AS index_name, 'a DESC,lower(b)' AS expressions, p_partkey % 2 = 0 AS is_unique FROM part WHERE p_partkey % 5 <> 0")
def a14(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_size").alias("snapshot_id"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("object_key"), F.concat(F.lit("ix"), F.col("p_partkey").cast("string")).alias("index_name"), (F.col("p_partkey") % 2 == 0).alias("is_unique"), F.lit("x > 0").alias("predicate"), F.posexplode(F.array(F.lit("a"), F.lit("lower(b)"))).alias("position", "expression"), "p_partkey")
    own = p.where("p_partkey % 5 = 0").select("snapshot_id", F.col("index_name").alias("constraint_name"))
    out = catalog.snapshot_indexes(p.withColumn("descending", F.col("position") == 0), own)
    return out.select("snapshot_id", "index_name", F.array_join("expressions", ",").alias("expressions"), "is_unique")


# Fixed values of Oracle's catalog: types of columns by key of a part.
_ORA = ("VARCHAR2", "NUMBER", "TIMESTAMP(6) WITH LOCAL TIME ZONE", "RAW", "POINT", "INTERVAL DAY(2) TO SECOND(6)")


@query("a12_oracle_columns", """SELECT p_size AS snapshot_id, 't' || p_partkey AS object_key, (['VARCHAR2', 'NUMBER', 'TIMESTAMP', 'RAW', 'GEO.POINT', 'INTERVAL DAY TO SECOND'])[1 + p_partkey % 6] AS base_type, CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 3 THEN 2 * p_size END AS length, CASE WHEN p_partkey % 6 = 1 THEN 9 END AS precision, p_partkey % 6 = 2 AS with_tz,
 CASE p_partkey % 5 WHEN 0 THEN 'GENERATED ALWAYS AS IDENTITY' WHEN 1 THEN 'GENERATED ALWAYS AS (a + 1) VIRTUAL' WHEN 2 THEN 'DEFAULT ON NULL a + 1' ELSE 'a + 1' END AS default_value, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS comment,
 CASE WHEN p_partkey % 5 = 2 THEN 'oracle.defaultOnNull=true;' ELSE '' END || CASE p_partkey % 5 WHEN 0 THEN 'oracle.identity=ALWAYS;oracle.identityOptions=START WITH: 1, CYCLE;' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN 'oracle.invisible=true;' ELSE '' END || CASE WHEN p_partkey % 6 = 0 THEN 'oracle.lengthSemantics=CHAR;' ELSE '' END || CASE WHEN p_partkey % 6 = 2 THEN 'oracle.timeZone=WITH LOCAL TIME ZONE;' ELSE '' END || CASE WHEN p_partkey % 6 = 4 THEN 'oracle.typeOwner=GEO;' ELSE '' END || CASE WHEN p_partkey % 5 = 1 THEN 'oracle.virtual=true;' ELSE '' END AS extensions
 FROM part WHERE p_partkey % 21 <> 8""")
def a12_oracle(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    yes = lambda c: F.when(c, "YES").otherwise("NO")
    p = table(spark, d, "part").select(F.col("p_size").alias("snapshot_id"), F.lit("OWN").alias("owner"), F.concat(F.lit("t"), k.cast("string")).alias("table_name"), F.lit("C").alias("column_name"), F.lit(1).alias("column_id"), F.get(F.array(*map(F.lit, _ORA)), (k % 6).cast("int")).alias("data_type"), (F.col("p_size") * 2).alias("data_length"), F.col("p_size").alias("char_length"), F.when(k % 6 == 0, "C").alias("char_used"), F.when(k % 6 == 1, 9).alias("data_precision"), F.lit(None).cast("int").alias("data_scale"), F.when(k % 6 == 4, "GEO").alias("data_type_owner"), F.lit(None).cast("string").alias("data_type_mod"), F.lit("Y").alias("nullable"), yes(k % 5 == 0).alias("identity_column"), yes(k % 5 == 2).alias("default_on_null"), yes(k % 5 == 1).alias("virtual_column"), yes((k % 7 == 0) | (k % 21 == 8)).alias("hidden_column"), yes(k % 7 == 0).alias("user_generated"), F.lit(" a + 1 ").alias("data_default"), "p_name", "p_partkey")
    at = ["snapshot_id", "owner", "table_name", "column_name"]
    out = catalog.oracle_columns(p.drop("p_name", "p_partkey"), p.where("p_partkey % 2 = 0").select(*at, F.col("p_name").alias("comments")), p.where("p_partkey % 5 = 0").select(*at, F.lit("ALWAYS").alias("generation_type"), F.lit(" START WITH: 1,  CYCLE ").alias("identity_options")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("extensions")), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))), "")
    return out.select("snapshot_id", "object_key", "base_type", "length", "precision", "with_tz", "default_value", "comment", text.alias("extensions"))


# Orders are constraints of their customer's table, line items the columns; foreign keys point to the constraint of the order before.
_OC = "(SELECT o_custkey % 50 AS snapshot_id, o_orderkey AS k, 't' || o_custkey AS object_key, 'c' || o_orderkey AS constraint_name, (['P', 'U', 'R', 'C', 'V'])[1 + o_orderkey % 5] AS t, CASE WHEN o_orderkey % 5 = 2 THEN o_orderkey - 1 END AS r FROM orders)"


@query("a13_oracle_constraints", f"""WITH u AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), l AS (SELECT l_orderkey AS k, string_agg('C' || l_linenumber, ',' ORDER BY l_linenumber) AS cols FROM u GROUP BY l_orderkey)
 SELECT c.snapshot_id, c.object_key, c.constraint_name, (['PRIMARY_KEY', 'UNIQUE', 'FOREIGN_KEY', 'CHECK'])[1 + c.k % 5] AS kind, coalesce(l.cols, '') AS columns, r.object_key AS ref_table, coalesce((SELECT string_agg('C' || b.l_linenumber, ',' ORDER BY b.l_linenumber) FROM u a JOIN u b USING (l_linenumber) WHERE a.l_orderkey = c.k AND b.l_orderkey = r.k), '') AS ref_columns, CASE WHEN c.k % 5 = 3 THEN 'x > 1' END AS expression, c.k % 2 = 0 AS generated
 FROM {_OC} c LEFT JOIN l ON l.k = c.k LEFT JOIN {_OC} r ON r.snapshot_id = c.snapshot_id AND r.k = c.r WHERE c.t <> 'V'""")
def a13_oracle(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.oracle_constraints(*oracle_rows(spark, d))[0]
    return out.select("snapshot_id", "object_key", "constraint_name", "kind", F.array_join("columns", ",").alias("columns"), "ref_table", F.array_join("ref_columns", ",").alias("ref_columns"), "expression", "generated")


@query("a13_oracle_dependencies", f"SELECT DISTINCT c.snapshot_id, c.object_key, r.object_key AS depends_on FROM {_OC} c JOIN {_OC} r ON r.snapshot_id = c.snapshot_id AND r.k = c.r WHERE c.object_key <> r.object_key")
def a13_oracle_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return catalog.oracle_constraints(*oracle_rows(spark, d))[1]


def oracle_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    base = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("snapshot_id"), F.lit("OWN").alias("owner"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("table_name"), F.concat(F.lit("c"), k.cast("string")).alias("constraint_name"), "o_orderkey")
    rows = base.select("snapshot_id", "owner", "table_name", "constraint_name", F.get(F.array(*map(F.lit, "PURCV")), (k % 5).cast("int")).alias("constraint_type"), F.when(k % 5 == 2, "OWN").alias("r_owner"), F.when(k % 5 == 2, F.concat(F.lit("c"), (k - 1).cast("string"))).alias("r_constraint_name"), F.lit("CASCADE").alias("delete_rule"), F.when(k % 2 == 0, "GENERATED NAME").otherwise("USER NAME").alias("generated"), F.when(k % 5 == 3, " x > 1 ").alias("search_condition"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("position"), F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("column_name")).distinct()
    return rows, base.join(lines, "o_orderkey").drop("o_orderkey")


_OI = "(SELECT DISTINCT l_orderkey AS k, l_linenumber AS o, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("a14_oracle_indexes", f"SELECT o_custkey % 50 AS snapshot_id, 't' || o_custkey AS object_key, 'i' || k AS index_name, k % 2 = 0 AS is_unique, string_agg(CASE WHEN o = 2 THEN 'lower(x)' ELSE 'C' || o END || CASE WHEN o = 3 THEN ' DESC' ELSE '' END, ',' ORDER BY o) AS expressions, k % 3 = 0 AS generated FROM {_OI} WHERE k % 7 <> 0 GROUP BY ALL")
def a14_oracle(spark: SparkSession, d: str) -> DataFrame:
    return oracle_index_rows(spark, d)[0].select("snapshot_id", "object_key", "index_name", "is_unique", F.array_join("expressions", ",").alias("expressions"), "generated")


@query("a14_oracle_rejects", f"SELECT DISTINCT o_custkey % 50 AS snapshot_id, 't' || o_custkey AS object_key, 'i' || k AS index_name, 'BITMAP' AS index_type FROM {_OI} WHERE k % 7 = 0")
def a14_rejects(spark: SparkSession, d: str) -> DataFrame:
    return oracle_index_rows(spark, d)[1].select("snapshot_id", "object_key", "index_name", "index_type")


def oracle_index_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    base = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("snapshot_id"), F.lit("OWN").alias("owner"), F.lit("OWN").alias("table_owner"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("table_name"), F.concat(F.lit("i"), k.cast("string")).alias("index_name"), F.when(k % 7 == 0, "BITMAP").when(k % 2 == 0, "NORMAL").otherwise("FUNCTION-BASED NORMAL").alias("index_type"), F.when(k % 2 == 0, "UNIQUE").otherwise("NONUNIQUE").alias("uniqueness"), "o_orderkey")
    line = F.col("l_linenumber")
    lines = base.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").distinct(), "o_orderkey").select("snapshot_id", "owner", "index_name", line.alias("position"), F.concat(F.lit("C"), line.cast("string")).alias("column_name"), F.when(line == 3, "DESC").otherwise("ASC").alias("descend"))
    backing = base.where("o_orderkey % 3 = 0").select("snapshot_id", "owner", "index_name", F.col("table_owner"), "table_name")
    return catalog.oracle_indexes(base.drop("o_orderkey"), lines, lines.where("position = 2").select("snapshot_id", "owner", "index_name", "position", F.lit("lower(x)").alias("expression")), backing)


@query("a15_snapshot_types", "SELECT c_nationkey AS snapshot_id, c_mktsegment AS type_name, 'ENUM (' || string_agg('''' || c_name || '''', ', ' ORDER BY c_custkey) || ')' AS definition FROM customer GROUP BY ALL")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return catalog.snapshot_types(table(spark, d, "customer").select(F.col("c_nationkey").alias("snapshot_id"), F.col("c_mktsegment").alias("type_name"), F.lit("enum").alias("kind"), F.col("c_name").alias("label"), F.lit("").alias("type"), F.col("c_custkey").alias("position")))


@query("a16_routine_signatures", "SELECT l_suppkey AS snapshot_id, l_orderkey AS routine_name, '(' || coalesce(string_agg(CASE WHEN l_linestatus = 'O' THEN 'INOUT ' ELSE '' END || l_returnflag, ',' ORDER BY l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'INOUT ' ELSE '' END || l_returnflag) FILTER (l_linenumber > 1 AND l_partkey % 5 <> 0), '') || ')' AS signature FROM lineitem GROUP BY ALL")
def a16(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("l_partkey") % 5 == 0, "OUT").when(F.col("l_linestatus") == "O", "INOUT").otherwise("IN")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("snapshot_id"), F.col("l_orderkey").alias("routine_name"), (F.col("l_linenumber") - 1).alias("position"), mode.alias("mode"), F.col("l_returnflag").alias("type"))
    return catalog.routine_signatures(rows)


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """Objects are parts; each depends on the one of half its number, every seventh on itself."""
    p = table(spark, d, "part")
    to = F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey")).otherwise(F.expr("p_partkey div 2"))
    return p.select(F.lit(1).alias("snapshot_id"), F.col("p_partkey").alias("object_key"), to.alias("depends_on"), F.lit(True).alias("in_schema"))


@query("a17_snapshot_dependencies", "SELECT p_partkey AS object_key, p_partkey // 2 AS depends_on FROM part WHERE p_partkey % 7 <> 0 AND p_partkey // 2 IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) AND p_partkey % 10 <> 0")
def a17(spark: SparkSession, d: str) -> DataFrame:
    objects = table(spark, d, "part").where("p_partkey % 10 <> 0").select(F.lit(1).alias("snapshot_id"), F.col("p_partkey").alias("object_key"), F.col("p_brand").alias("object_type"))
    return catalog.snapshot_dependencies(part_edges(spark, d), objects)[0].select("object_key", "depends_on")


# Raw catalog rows: five databases, where nations are schemas, customers tables and views, suppliers functions, parts types, and orders triggers,
# defaults and constraints; line items say what needs what. SQL of the same, with k for the kind of a line.
_RAW = """ns AS (SELECT n_nationkey % 5 AS s, n_nationkey AS oid, 'n' || n_nationkey AS schema_name FROM nation),
 cls AS (SELECT c_nationkey % 5 AS s, c_custkey AS oid, c_nationkey AS ns FROM customer),
 ents AS (SELECT cls.s, 'pg_class' AS c, cls.oid, schema_name FROM cls JOIN ns ON cls.s = ns.s AND cls.ns = ns.oid
  UNION ALL SELECT s_nationkey % 5, 'pg_proc', s_suppkey, schema_name FROM supplier JOIN ns ON s_nationkey = ns.oid
  UNION ALL SELECT p_partkey % 25 % 5, 'pg_type', p_partkey, schema_name FROM part JOIN ns ON p_partkey % 25 = ns.oid
  UNION ALL SELECT cls.s, k, o_orderkey, schema_name FROM orders JOIN cls ON o_custkey = cls.oid JOIN ns ON cls.ns = ns.oid CROSS JOIN (VALUES ('pg_trigger'), ('pg_attrdef'), ('pg_constraint')) v(k) WHERE k <> 'pg_attrdef' OR o_orderkey % 2 = 0),
 dep AS (SELECT c_nationkey % 5 AS s, (['pg_trigger', 'pg_class', 'pg_class', 'pg_attrdef', 'pg_constraint', 'pg_proc'])[l_linenumber] AS c, CASE WHEN l_linenumber IN (2, 3) THEN o_custkey WHEN l_linenumber = 6 THEN l_suppkey ELSE l_orderkey END AS oid,
   (['pg_proc', 'pg_type', 'pg_class', 'pg_proc', 'pg_class', 'pg_type'])[l_linenumber] AS rc, CASE WHEN l_linenumber IN (2, 6) THEN l_partkey ELSE l_suppkey END AS roid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_linenumber < 7 AND (l_linenumber <> 3 OR o_custkey % 6 = 0)),
 objs AS (SELECT c_nationkey % 5 AS s, 'pg_class' AS c, c_custkey AS oid, CASE WHEN c_custkey % 6 = 0 THEN 'VIEW' ELSE 'TABLE' END AS t, 't' || c_custkey AS key, NULL AS parent FROM customer WHERE c_custkey % 10 <> 0
  UNION ALL SELECT s_nationkey % 5, 'pg_proc', s_suppkey, 'FUNCTION', 'f' || s_suppkey, NULL FROM supplier
  UNION ALL SELECT p_partkey % 25 % 5, 'pg_type', p_partkey, 'TYPE', 'y' || p_partkey, NULL FROM part WHERE p_partkey % 3 <> 0
  UNION ALL SELECT c_nationkey % 5, k, o_orderkey, CASE k WHEN 'pg_trigger' THEN 'TRIGGER' WHEN 'pg_attrdef' THEN 'TABLE' ELSE 'CHECK_CONSTRAINT' END, CASE k WHEN 'pg_trigger' THEN 'g' || o_orderkey WHEN 'pg_attrdef' THEN 't' || o_custkey ELSE 'k' || o_orderkey END, CASE k WHEN 'pg_constraint' THEN 't' || o_custkey END FROM orders JOIN customer ON o_custkey = c_custkey CROSS JOIN (VALUES ('pg_trigger'), ('pg_attrdef'), ('pg_constraint')) v(k)),
 found AS (SELECT dep.s, se.schema_name, so.t, so.key, so.parent, tob.key AS needs FROM dep JOIN ents se ON se.s = dep.s AND se.c = dep.c AND se.oid = dep.oid JOIN ents te ON te.s = dep.s AND te.c = dep.rc AND te.oid = dep.roid AND te.schema_name = se.schema_name
  JOIN objs so ON so.s = dep.s AND so.c = dep.c AND so.oid = dep.oid LEFT JOIN objs tob ON tob.s = dep.s AND tob.c = dep.rc AND tob.oid = dep.roid WHERE NOT (dep.c = dep.rc AND dep.oid = dep.roid))"""


def raw_dependencies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    snap = lambda c: (F.col(c) % 5).cast("int").alias("snapshot_id")
    customer, supplier, part = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "part").withColumn("p_nationkey", F.col("p_partkey") % 25)
    orders = table(spark, d, "orders").join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select(snap("c_nationkey"), F.col("o_orderkey").alias("oid"), F.col("o_custkey").alias("relation"), F.lit(None).cast("long").alias("type"))
    raw = {
        "namespaces": table(spark, d, "nation").select(snap("n_nationkey"), F.col("n_nationkey").alias("oid"), text("n", "n_nationkey").alias("schema_name")),
        "pg_class": customer.select(snap("c_nationkey"), F.col("c_custkey").alias("oid"), F.col("c_nationkey").alias("namespace")),
        "pg_proc": supplier.select(snap("s_nationkey"), F.col("s_suppkey").alias("oid"), F.col("s_nationkey").alias("namespace")),
        "pg_type": part.select(snap("p_nationkey"), F.col("p_partkey").alias("oid"), F.col("p_nationkey").alias("namespace")),
        "pg_trigger": orders,
        "pg_attrdef": orders.where("oid % 2 = 0"),
        "pg_constraint": orders,
    }
    views = customer.where("c_custkey % 6 = 0").select(snap("c_nationkey"), (-F.col("c_custkey")).alias("oid"), F.col("c_custkey").alias("view"))
    line = F.col("l_linenumber")
    kinds = lambda *names: F.get(F.array(*map(F.lit, names)), line - 1)
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("oid"), "l_linenumber", "l_suppkey", "l_partkey").join(orders.select("snapshot_id", "oid", "relation"), "oid")
    source = F.when(line == 2, F.col("relation")).when(line == 3, -F.col("relation")).when(line == 6, F.col("l_suppkey")).otherwise(F.col("oid"))
    depends = lines.select("snapshot_id", kinds("pg_trigger", "pg_class", "pg_rewrite", "pg_attrdef", "pg_constraint", "pg_proc", "pg_cast").alias("catalog"), source.alias("oid"), kinds("pg_proc", "pg_type", "pg_class", "pg_proc", "pg_class", "pg_type", "pg_type").alias("ref_catalog"), F.when(line.isin(2, 6), F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("ref_oid"))
    none = F.lit(None).cast("string")
    named = lambda df, catalog, kind, key, parent=none: df.select("snapshot_id", F.lit(catalog).alias("catalog"), "oid", kind.alias("object_type"), key.alias("object_key"), parent.alias("parent_key"))
    objects = named(raw["pg_class"].where("oid % 10 <> 0"), "pg_class", F.when(F.col("oid") % 6 == 0, "VIEW").otherwise("TABLE"), text("t", "oid"))
    objects = objects.unionByName(named(raw["pg_proc"], "pg_proc", F.lit("FUNCTION"), text("f", "oid"))).unionByName(named(raw["pg_type"].where("oid % 3 <> 0"), "pg_type", F.lit("TYPE"), text("y", "oid")))
    for catalog_name, kind, key, parent in (("pg_trigger", "TRIGGER", text("g", "oid"), none), ("pg_attrdef", "TABLE", text("t", "relation"), none), ("pg_constraint", "CHECK_CONSTRAINT", text("k", "oid"), text("t", "relation"))):
        objects = objects.unionByName(named(orders, catalog_name, F.lit(kind), key, parent))
    return dependencies.numbered_dependencies(dependencies.numbered_edges(depends, views), dependencies.numbered_entities(raw), objects, raw["namespaces"].select("snapshot_id", "schema_name"))


@query("a17_raw_dependencies", f"WITH {_RAW} SELECT DISTINCT CAST(s AS INTEGER) AS snapshot_id, schema_name, h AS object_key, needs AS depends_on FROM (SELECT s, schema_name, key AS h, key, needs FROM found UNION ALL SELECT s, schema_name, parent, key, needs FROM found WHERE parent IS NOT NULL) WHERE needs IS NOT NULL AND key <> needs AND h <> needs")
def a17_raw(spark: SparkSession, d: str) -> DataFrame:
    return raw_dependencies(spark, d)[0]


@query("a17_unresolved", f"WITH {_RAW} SELECT DISTINCT CAST(s AS INTEGER) AS snapshot_id, schema_name, t AS object_type FROM found WHERE needs IS NULL")
def a17_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return raw_dependencies(spark, d)[1]


@query("a18_snapshot_completeness", "SELECT user_id AS snapshot_id, event_type AS object_type, (['PERMISSION_DENIED','METADATA_UNAVAILABLE','DEFINITION_UNAVAILABLE','DEPENDENCY_UNRESOLVED','NOT_SUPPORTED'])[1 + min(event_id % 5)] AS code FROM events WHERE event_id % 6 <> 5 GROUP BY ALL")
def a18(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("event_id") % 6 != 5, F.get(F.array(*map(F.lit, catalog.CODES)), (F.col("event_id") % 5).cast("int")))
    return catalog.snapshot_completeness(table(spark, d, "events").select(F.col("user_id").alias("snapshot_id"), F.col("event_type").alias("object_type"), code.alias("code")))


_FP = "octet_length(encode({c})) || ':' || {c} || ';'"


@query("a19_fingerprint", f"SELECT p_size AS snapshot_id, sha256('snapshot-v1;' || string_agg('1:2;' || {_FP.format(c='p_name')} || coalesce({_FP.format(c='nullif(p_brand, chr(66))')}, '-;'), '' ORDER BY p_name, p_brand)) AS fingerprint FROM part GROUP BY p_size")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return catalog.fingerprint(table(spark, d, "part").select(F.col("p_size").alias("snapshot_id"), F.lit(2).alias("type_rank"), F.col("p_name").alias("object_key"), F.col("p_brand").alias("body")))


# ---------- schema comparison: a comparison is a size, an object a part ----------

def side(spark: SparkSession, d: str, target: bool) -> DataFrame:
    """The target lacks every third part, the source every fifth; the bodies of every seventh differ."""
    p = table(spark, d, "part").where("p_partkey % 3 <> 0" if target else "p_partkey % 5 <> 0")
    body = F.when((F.col("p_partkey") % 7 == 0) & F.lit(target), F.lit(None)).otherwise(F.col("p_type"))
    return p.select(F.col("p_size").alias("comparison_id"), F.lit("TABLE").alias("object_type"), F.col("p_partkey").cast("string").alias("object_key"), body.alias("body"))


_KIND = "CASE WHEN p_partkey % 3 = 0 THEN 'MISSING_IN_TARGET' WHEN p_partkey % 5 = 0 THEN 'EXTRA_IN_TARGET' WHEN p_partkey % 7 = 0 THEN 'MODIFIED' ELSE 'EQUIVALENT' END"
_DIFF = f"(SELECT p_size AS comparison_id, 'TABLE' AS object_type, CAST(p_partkey AS VARCHAR) AS object_key, p_partkey, {_KIND} AS kind FROM part WHERE p_partkey % 15 <> 0)"


@query("d1_validate_snapshots", "SELECT p_size AS comparison_id, 'DB_TYPE' AS violation FROM part WHERE p_size % 4 = 0 GROUP BY p_size HAVING count(DISTINCT p_partkey % 2) > 1 UNION SELECT p_size, 'NULL_KEY' FROM part WHERE p_partkey % 50 = 0 UNION SELECT p_size, 'DUPLICATE_KEY' FROM part WHERE p_partkey % 40 = 1")
def d1(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("copy", F.explode(F.when(F.col("p_partkey") % 40 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return schemadiff.validate_snapshots(p.select(F.col("p_size").alias("comparison_id"), F.lit("source").alias("side"), F.lit("TABLE").alias("object_type"), F.when(F.col("p_partkey") % 50 != 0, F.col("p_partkey")).alias("object_key"), F.when((F.col("p_size") % 4 == 0) & (F.col("p_partkey") % 2 == 0), "ORACLE").otherwise("POSTGRES").alias("db_type")))


@query("d2_project_owner", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'other.' ELSE '' END || p_name || p_partkey AS object_key, CASE WHEN p_partkey % 2 = 0 THEN 'select \"' || p_partkey || '\"' END AS definition, CASE WHEN p_partkey % 4 = 0 THEN 'FOREIGN_OWNER' END AS error FROM part")
def d2(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("comparison_id"), F.lit("source").alias("side"), F.lit("VIEW").alias("object_type"), F.lit("own").alias("schema_name"), F.when(F.col("p_partkey") % 4 == 0, "other").otherwise("own").alias("owner"), F.concat("p_name", n).alias("object_name"), F.when(F.col("p_partkey") % 2 == 0, "HIGH").otherwise("LOW").alias("confidence"), F.concat(F.lit('select "own"."'), n, F.lit('"')).alias("definition"))
    out = schemadiff.project_owner(rows)
    return out.select("p_partkey", "object_key", F.when(~F.col("definition").startswith("sha256:"), F.col("definition")).alias("definition"), "error")


@query("d3_object_diff", f"SELECT comparison_id, object_type, object_key, kind FROM {_DIFF}")
def d3(spark: SparkSession, d: str) -> DataFrame:
    return schemadiff.object_diff(side(spark, d, False), side(spark, d, True))


@query("d4_mask_unavailable", f"SELECT comparison_id, object_type, object_key, CASE WHEN comparison_id % 6 = 0 THEN 'UNSUPPORTED' ELSE kind END AS kind FROM {_DIFF}")
def d4(spark: SparkSession, d: str) -> DataFrame:
    s = side(spark, d, False)
    return schemadiff.mask_unavailable(schemadiff.object_diff(s, side(spark, d, True)), s.where("comparison_id % 6 = 0").select("comparison_id", "object_type"))


def column_side(spark: SparkSession, d: str, target: bool) -> DataFrame:
    c = columns(spark, d).where("ordinal % 9 <> 0" if target else "ordinal % 8 <> 0")
    k = F.col("ordinal") % 4
    t = F.lit(target)
    return c.select(F.col("schema_name").alias("comparison_id"), F.col("table_name").alias("object_key"), "column_name", F.when(t & (k == 1), "bigint").otherwise("integer").alias("dataType"), (~t | (k != 2)).alias("nullable"), F.when(t & (k == 3), "0").alias("normalizedDefault"), "ordinal", F.lit("x").alias("comment"))


_CS = f"(SELECT schema_name AS comparison_id, table_name AS object_key, 'columns[' || column_name || ']' AS path, ordinal AS o FROM {_C})"
_BOTH = f"(SELECT DISTINCT schema_name AS comparison_id, table_name AS object_key FROM {_C} WHERE ordinal % 8 <> 0 INTERSECT SELECT DISTINCT schema_name, table_name FROM {_C} WHERE ordinal % 9 <> 0)"


@query("d5_column_properties", f"SELECT comparison_id, object_key, path, CASE WHEN o % 9 = 0 THEN 'integer' END AS source_value, CASE WHEN o % 8 = 0 THEN CASE WHEN o % 4 = 1 THEN 'bigint' ELSE 'integer' END END AS target_value FROM {_CS} SEMI JOIN {_BOTH} USING (comparison_id, object_key) WHERE (o % 9 = 0) <> (o % 8 = 0) UNION ALL SELECT comparison_id, object_key, path || (['', '.dataType', '.nullable', '.normalizedDefault'])[1 + o % 4], (['', 'integer', 'true', NULL])[1 + o % 4], (['', 'bigint', 'false', '0'])[1 + o % 4] FROM {_CS} WHERE o % 9 <> 0 AND o % 8 <> 0 AND o % 4 > 0")
def d5(spark: SparkSession, d: str) -> DataFrame:
    return schemadiff.column_property_diff(column_side(spark, d, False), column_side(spark, d, True))


@query("d6_constraint_diff", "WITH s AS (SELECT o_custkey % 50 AS c, o_custkey AS k, o_orderpriority AS b, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL), t AS (SELECT o_custkey % 50 AS c, o_custkey AS k, o_orderpriority AS b, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY ALL), j AS (SELECT coalesce(s.c, t.c) AS comparison_id, coalesce(s.k, t.k) AS object_key, coalesce(s.n, 0) - coalesce(t.n, 0) AS x FROM s FULL JOIN t ON s.k = t.k AND s.b = t.b) SELECT comparison_id, object_key, 'constraints' AS path, sum(greatest(x, 0)) AS n_source, sum(greatest(-x, 0)) AS n_target FROM j WHERE x <> 0 GROUP BY ALL")
def d6(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("comparison_id"), F.col("o_custkey").alias("object_key"), F.col("o_orderpriority").alias("body"), "o_orderkey")
    return schemadiff.multiset_diff(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 4 <> 0"), "constraints")


@query("d7_sequence_diff", "SELECT c_nationkey AS comparison_id, c_custkey AS object_key, (['incrementBy', 'extensions', 'maximumValue'])[1 + c_custkey % 3] AS path, (['1', '[{\"key\":\"a\",\"value\":\"1\"},{\"key\":\"b\",\"value\":\"2\"}]', NULL])[1 + c_custkey % 3] AS source_value, (['2', '[{\"key\":\"a\",\"value\":\"1\"}]', '9'])[1 + c_custkey % 3] AS target_value FROM customer")
def d7(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("object_key") % 3
    base = table(spark, d, "customer").select(F.col("c_nationkey").alias("comparison_id"), F.col("c_custkey").alias("object_key"), F.lit("1").alias("startValue"), F.lit("1").alias("incrementBy"), F.lit("1").alias("minimumValue"), F.lit(None).cast("string").alias("maximumValue"), F.lit(False).alias("cycle"), F.lit(20).alias("cacheSize"), F.expr("map('b', '2', 'a', '1')").alias("extensions"), F.expr("array('y', 'x')").alias("dependencies"))
    changed = base.withColumns({"incrementBy": F.when(k == 0, "2").otherwise("1"), "maximumValue": F.when(k == 2, "9"), "extensions": F.when(k == 1, F.expr("map('a', '1')")).otherwise(F.expr("map('a', '1', 'b', '2')")), "dependencies": F.expr("array('x', 'y')")})
    return schemadiff.sequence_diff(base, changed)


@query("d8_definition_diff", "SELECT p_size AS comparison_id, p_partkey AS object_key, 'sha256:' || sha256(p_name) AS source_digest, 'sha256:' || sha256(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END) AS target_digest, p_partkey % 5 <> 0 AS reliable FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 3 = 0")
def d8(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_size").alias("comparison_id"), F.col("p_partkey").alias("object_key"), F.col("p_name").alias("definition"), F.lit("HIGH").alias("confidence"), "p_type")
    t = p.withColumns({"definition": F.when(F.col("object_key") % 3 == 0, F.col("p_type")).otherwise(F.col("definition")), "confidence": F.when(F.col("object_key") % 5 == 0, "LOW").otherwise("HIGH")})
    return schemadiff.definition_diff(p, t)


def graded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    diff = schemadiff.object_diff(side(spark, d, False), side(spark, d, True))
    n = F.col("object_key").cast("long")
    diff = diff.withColumns({"confidence": F.when(n % 4 == 0, "LOW").otherwise("HIGH"), "reliable": n % 4 != 0, "is_definition": n % 2 == 0})
    props = diff.where("kind = 'MODIFIED'").select("comparison_id", "object_key", F.explode(F.when(n % 3 == 1, F.array(F.lit("columns[x]"))).otherwise(F.array(F.lit("normalizedDefinition"), F.lit("dependencies")))).alias("path"))
    return diff, props.withColumns({"safe_add": F.col("path") == "columns[x]", "isolatable": F.col("object_key").cast("long") % 5 != 1})


_RISK = "CASE kind WHEN 'EQUIVALENT' THEN 'LOW' WHEN 'MISSING_IN_TARGET' THEN CASE WHEN p_partkey % 4 = 0 THEN 'HIGH' ELSE 'LOW' END WHEN 'EXTRA_IN_TARGET' THEN CASE WHEN p_partkey % 4 = 0 THEN 'HIGH' ELSE 'CRITICAL' END ELSE CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 = 1 THEN 'LOW' ELSE 'HIGH' END END"
_AUTO = "CASE WHEN kind = 'EQUIVALENT' THEN 'SAFE_AUTOMATIC' WHEN p_partkey % 4 = 0 THEN 'MANUAL_ONLY' WHEN kind = 'MISSING_IN_TARGET' THEN 'SAFE_AUTOMATIC' WHEN kind = 'EXTRA_IN_TARGET' THEN 'DESTRUCTIVE_OPT_IN' WHEN p_partkey % 3 = 1 THEN 'SAFE_AUTOMATIC' ELSE 'DESTRUCTIVE_OPT_IN' END"


@query("d9_risk_automation", f"SELECT comparison_id, object_key, kind, {_RISK} AS risk, {_AUTO} AS automation FROM {_DIFF}")
def d9(spark: SparkSession, d: str) -> DataFrame:
    return schemadiff.risk_automation(*graded(spark, d)).select("comparison_id", "object_key", "kind", "risk", "automation")


@query("d10_rename_suggestions", "WITH m AS (SELECT p_size AS c, p_type AS s, count(*) AS n, min(p_partkey) AS k FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL HAVING n = 1), x AS (SELECT p_size AS c, p_type AS s, count(*) AS n, min(p_partkey) AS k FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL HAVING n = 1) SELECT m.c AS comparison_id, 'TABLE' AS object_type, x.k AS old_key, m.k AS new_key, 1.0 AS score FROM m JOIN x ON m.c = x.c AND m.s = x.s")
def d10(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_size").alias("comparison_id"), F.lit("TABLE").alias("object_type"), F.col("p_partkey").alias("object_key"), F.lit("").alias("signature"), F.col("p_type").alias("structure"))
    return schemadiff.rename_suggestions(p.where("object_key % 2 = 0"), p.where("object_key % 2 = 1"))


# ---------- change plans ----------

def planned(spark: SparkSession, d: str) -> DataFrame:
    diff, props = graded(spark, d)
    return changeplan.expand_changes(schemadiff.risk_automation(diff, props), props)


_STUCK = "(p_partkey % 4 = 0 OR p_partkey % 5 = 1)"
_PLAN = f"""(SELECT comparison_id, object_type, object_key, p_partkey, '$object' AS path, CASE WHEN p_partkey % 4 = 0 THEN 'MANUAL' WHEN kind = 'MISSING_IN_TARGET' THEN 'CREATE' ELSE 'DROP' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN 'HIGH' WHEN kind = 'MISSING_IN_TARGET' THEN 'LOW' ELSE 'CRITICAL' END AS risk FROM {_DIFF} WHERE kind IN ('MISSING_IN_TARGET', 'EXTRA_IN_TARGET')
 UNION ALL SELECT comparison_id, object_type, object_key, p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 'columns[x]' ELSE 'normalizedDefinition' END, CASE WHEN {_STUCK} THEN 'MANUAL' ELSE 'REPLACE' END, 'HIGH' FROM {_DIFF} WHERE kind = 'MODIFIED' AND p_partkey % 2 = 0
 UNION ALL SELECT comparison_id, object_type, object_key, p_partkey, 'columns[x]', CASE WHEN {_STUCK} THEN 'MANUAL' ELSE 'ALTER' END, CASE WHEN {_STUCK} THEN 'HIGH' ELSE 'LOW' END FROM {_DIFF} WHERE kind = 'MODIFIED' AND p_partkey % 2 = 1 AND p_partkey % 3 = 1
 UNION ALL SELECT comparison_id, object_type, object_key, p_partkey, unnest(['normalizedDefinition', 'dependencies']), CASE WHEN {_STUCK} THEN 'MANUAL' ELSE 'ALTER' END, 'HIGH' FROM {_DIFF} WHERE kind = 'MODIFIED' AND p_partkey % 2 = 1 AND p_partkey % 3 = 2)"""


@query("d11_expand_changes", f"SELECT comparison_id, object_key, path, kind, risk FROM {_PLAN}")
def d11(spark: SparkSession, d: str) -> DataFrame:
    return planned(spark, d).select("comparison_id", "object_key", "path", "kind", "risk")


_FIELD = "unhex(printf('%08X', octet_length(encode({c})))) || encode({c})"
_CHG = " || ".join(_FIELD.format(c=c) for c in ("'change-v1'", "kind", "object_type", "object_key", "object_key", "'false'", "''", "path"))


@query("d12_change_ids", f"SELECT comparison_id, object_key, path, 'chg:' || sha256({_CHG}) AS id FROM {_PLAN}")
def d12(spark: SparkSession, d: str) -> DataFrame:
    return changeplan.change_ids(planned(spark, d)).select("comparison_id", "object_key", "path", "id")


def simple_changes(spark: SparkSession, d: str, comparison: str = "p_partkey div 64 % 8") -> DataFrame:
    """A change for each part, by default all in one of eight comparisons; every third part is dropped."""
    p = table(spark, d, "part")
    n = F.col("p_partkey")
    kind = F.when(n % 3 == 0, "DROP").when(n % 17 == 0, "MANUAL").otherwise("ALTER")
    return p.select(F.expr(comparison).alias("comparison_id"), F.get(F.array(*map(F.lit, ("TABLE", "INDEX", "VIEW"))), (n % 3).cast("int")).alias("object_type"), n.alias("object_key"), F.lit("dependencies").alias("path"), kind.alias("kind"), F.lit("LOW").alias("risk"), F.when(n % 17 == 0, "MANUAL_ONLY").otherwise("SAFE_AUTOMATIC").alias("automation"), F.concat(F.lit("i"), n.cast("string")).alias("id"))


def simple_deps(spark: SparkSession, d: str, comparison: str = "p_partkey div 64 % 8") -> DataFrame:
    """Part n depends on n - 3 (of the same kind) and n - 1, within a run of 64; every 64th also on the one 6 ahead, a cycle."""
    p = table(spark, d, "part").select("p_partkey", F.expr(comparison).alias("comparison_id"))
    steps = F.array(F.lit(3), F.lit(1))
    down = p.select("comparison_id", "p_partkey", F.explode(steps).alias("s")).where("p_partkey % 64 >= s")
    up = p.where("p_partkey % 64 = 1").select("comparison_id", "p_partkey", F.lit(-6).alias("s"))
    return down.union(up).select("comparison_id", F.col("p_partkey").alias("object_key"), (F.col("p_partkey") - F.col("s")).alias("depends_on"))


_SC = "(SELECT p_partkey // 64 % 8 AS comparison_id, p_partkey AS n, p_partkey % 3 = 0 AS dr, p_partkey % 17 = 0 AND p_partkey % 3 <> 0 AS manual, 'i' || p_partkey AS id FROM part)"
_SD = "(SELECT comparison_id, n, n - s AS m FROM (SELECT *, unnest([3, 1]) AS s FROM " + _SC + ") WHERE n % 64 >= s UNION ALL SELECT comparison_id, n, n + 6 FROM " + _SC + " WHERE n % 64 = 1)"
_SE = f"(SELECT DISTINCT e.comparison_id, CASE WHEN a.dr THEN b.id ELSE a.id END AS id, CASE WHEN a.dr THEN a.id ELSE b.id END AS needs FROM {_SD} e JOIN {_SC} a ON a.n = e.n AND a.comparison_id = e.comparison_id JOIN {_SC} b ON b.n = e.m AND b.comparison_id = e.comparison_id WHERE a.dr = b.dr)"


@query("d13_wire_dependencies", f"SELECT comparison_id, id, needs FROM {_SE}")
def d13(spark: SparkSession, d: str) -> DataFrame:
    return changeplan.wire_dependencies(simple_changes(spark, d), simple_deps(spark, d))


@query("d14_unreleasable_drops", f"SELECT DISTINCT e.comparison_id, b.id FROM {_SD} e JOIN {_SC} a ON a.n = e.n AND a.comparison_id = e.comparison_id JOIN {_SC} b ON b.n = e.m AND b.comparison_id = e.comparison_id WHERE NOT a.dr AND b.dr AND (e.n % 2 = 0 OR a.n % 17 = 0)")
def d14(spark: SparkSession, d: str) -> DataFrame:
    deps = simple_deps(spark, d)
    return changeplan.unreleasable_drops(simple_changes(spark, d), deps, deps.where("object_key % 2 = 0"))[0]


@query("d15_cycles_to_manual", f"WITH RECURSIVE e AS {_SE}, r(comparison_id, id, needs) AS (SELECT * FROM e UNION SELECT r.comparison_id, r.id, e.needs FROM r JOIN e ON e.comparison_id = r.comparison_id AND e.id = r.needs) SELECT c.comparison_id, c.id AS old_id, CASE WHEN y.id IS NOT NULL OR c.manual THEN 'MANUAL' WHEN c.dr THEN 'DROP' ELSE 'ALTER' END AS kind, CASE WHEN y.id IS NOT NULL THEN 'HIGH' ELSE 'LOW' END AS risk FROM {_SC} c LEFT JOIN (SELECT DISTINCT comparison_id, id FROM r WHERE id = needs) y ON y.comparison_id = c.comparison_id AND y.id = c.id")
def d15(spark: SparkSession, d: str) -> DataFrame:
    changes = simple_changes(spark, d)
    return changeplan.cycles_to_manual(changes, changeplan.wire_dependencies(changes, simple_deps(spark, d))).select("comparison_id", "old_id", "kind", "risk")


_SC64 = _SC.replace("p_partkey // 64 % 8", "p_partkey // 64")
_SE64 = _SE.replace(_SC, _SC64)
#: One heap a comparison: in each step the least of the changes whose needs are all placed.
_D16 = f"""WITH RECURSIVE e AS MATERIALIZED {_SE64},
r(comparison_id, id, needs) AS (SELECT * FROM e UNION SELECT r.comparison_id, r.id, e.needs FROM r JOIN e ON e.comparison_id = r.comparison_id AND e.id = r.needs),
y AS MATERIALIZED (SELECT DISTINCT comparison_id, id FROM r WHERE id = needs),
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY comparison_id ORDER BY dr, CASE WHEN dr THEN -2 ELSE 2 + n % 3 * 2 END, n) AS key FROM {_SC64}),
w AS (SELECT e.comparison_id, e.id, list(b.key) AS needs FROM e JOIN k b ON b.comparison_id = e.comparison_id AND b.id = e.needs
  WHERE NOT (EXISTS (SELECT 1 FROM y WHERE y.comparison_id = e.comparison_id AND y.id = e.id) AND EXISTS (SELECT 1 FROM y WHERE y.comparison_id = e.comparison_id AND y.id = e.needs)) GROUP BY ALL),
f AS MATERIALIZED (SELECT k.comparison_id, k.id, k.key, coalesce(w.needs, []) AS needs FROM k LEFT JOIN w ON w.comparison_id = k.comparison_id AND w.id = k.id),
s(comparison_id, placed, position, key) AS (SELECT DISTINCT comparison_id, CAST([] AS BIGINT[]), 0, CAST(0 AS BIGINT) FROM f
  UNION ALL SELECT s.comparison_id, list_append(any_value(s.placed), min(f.key)), any_value(s.position) + 1, min(f.key) FROM s JOIN f ON f.comparison_id = s.comparison_id
  WHERE NOT list_contains(s.placed, f.key) AND list_has_all(s.placed, f.needs) GROUP BY s.comparison_id)
SELECT f.comparison_id, f.id, s.position FROM s JOIN f ON f.comparison_id = s.comparison_id AND f.key = s.key"""


@query("d16_order_changes", _D16)
def d16(spark: SparkSession, d: str) -> DataFrame:
    changes = simple_changes(spark, d, "p_partkey div 64")
    edges = changeplan.ordering_edges(changeplan.wire_dependencies(changes, simple_deps(spark, d, "p_partkey div 64")))
    return changeplan.order_changes(changes, edges).select("comparison_id", "id", "position")


@query("d17_select_changes", f"WITH RECURSIVE e AS {_SE}, w AS (SELECT comparison_id, id FROM {_SC} WHERE NOT manual AND n % 29 <> 0 AND n % 17 <> 0), b(comparison_id, id) AS (SELECT w.comparison_id, w.id FROM w JOIN e ON e.comparison_id = w.comparison_id AND e.id = w.id WHERE NOT EXISTS (SELECT 1 FROM w w2 WHERE w2.comparison_id = e.comparison_id AND w2.id = e.needs) UNION SELECT w.comparison_id, w.id FROM b JOIN e ON e.comparison_id = b.comparison_id AND e.needs = b.id JOIN w ON w.comparison_id = e.comparison_id AND w.id = e.id) SELECT w.comparison_id, w.id, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.comparison_id = w.comparison_id AND b.id = w.id) THEN 'BLOCKED' ELSE 'SELECTED' END AS state FROM w")
def d17(spark: SparkSession, d: str) -> DataFrame:
    changes = simple_changes(spark, d)
    return changeplan.select_changes(changes, changeplan.wire_dependencies(changes, simple_deps(spark, d)), changes.where("object_key % 29 <> 0"))


_DG = " || ".join(_FIELD.format(c=c) for c in ("'selection-v1'", "'s' || comparison_id", "'t' || comparison_id", "CAST(count(*) AS VARCHAR)", "string_agg(id, chr(10) ORDER BY id)"))


@query("d18_selection_digest", f"SELECT comparison_id, sha256({_DG}) AS digest FROM {_SC} GROUP BY comparison_id")
def d18(spark: SparkSession, d: str) -> DataFrame:
    changes = simple_changes(spark, d)
    text = lambda p: F.concat(F.lit(p), F.col("comparison_id").cast("string"))
    return changeplan.selection_digest(changes, changes.select("comparison_id").distinct().withColumns({"source_fingerprint": text("s"), "target_fingerprint": text("t")}))


@query("d19_filter_changes", "SELECT p_partkey // 64 % 8 AS comparison_id, object_type, count(*) AS n_changes, min(p_partkey) AS first_position FROM (SELECT *, (['TABLE', 'INDEX', 'VIEW'])[1 + p_partkey % 3] AS object_type FROM part) WHERE p_partkey % 3 < 2 AND p_partkey % 2 = 0 AND contains(CAST(p_partkey AS VARCHAR), '4') GROUP BY ALL")
def d19(spark: SparkSession, d: str) -> DataFrame:
    changes = simple_changes(spark, d).withColumns({"selected": F.col("object_key") % 2 == 0, "position": F.col("object_key")})
    return changeplan.group_by_type(changeplan.filter_changes(changes, types=["TABLE", "INDEX"], state="SELECTED", search=" 4 "))


@query("d20_drift_gate", "SELECT p_partkey AS comparison_id, CASE WHEN p_partkey % 5 = 0 THEN 'BLOCKED_INCOMPLETE' WHEN p_partkey % 3 = 0 THEN 'BLOCKED_DRIFT' ELSE 'READY' END AS gate FROM part")
def d20(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("comparison_id"), F.lit("POSTGRES").alias("db_type"), F.col("p_brand").alias("schema_name"), F.sha2("p_name", 256).alias("fingerprint"))
    fresh = p.where("comparison_id % 10 <> 0").withColumns({"fingerprint": F.when(F.col("comparison_id") % 3 == 0, "other").otherwise(F.col("fingerprint")), "complete": F.col("comparison_id") % 5 != 0})
    return changeplan.drift_gate(p, fresh)


@query("d22_label_outcomes", f"WITH RECURSIVE e AS {_SE}, f AS (SELECT comparison_id, min(n) AS n FROM {_SC} WHERE n % 64 = 7 GROUP BY comparison_id), r(comparison_id, id) AS (SELECT e.comparison_id, e.id FROM e JOIN f ON f.comparison_id = e.comparison_id AND e.needs = 'i' || f.n UNION SELECT e.comparison_id, e.id FROM r JOIN e ON e.comparison_id = r.comparison_id AND e.needs = r.id) SELECT c.comparison_id, c.id, c.n AS position, CASE WHEN c.n > f.n AND c.comparison_id <> 2 AND EXISTS (SELECT 1 FROM r WHERE r.comparison_id = c.comparison_id AND r.id = c.id) THEN 'SKIPPED_DEPENDENCY' WHEN c.n > f.n THEN 'SKIPPED_FAIL_FAST' WHEN c.n = f.n THEN CASE WHEN c.comparison_id = 2 THEN 'CANCELLED' ELSE 'FAILED' END ELSE 'SUCCEEDED' END AS state FROM {_SC} c LEFT JOIN f ON f.comparison_id = c.comparison_id")
def d22(spark: SparkSession, d: str) -> DataFrame:
    changes = simple_changes(spark, d)
    bad = F.col("object_key") % 64 == 7
    steps = changes.select("comparison_id", "id", F.col("object_key").alias("position"), F.when(bad & (F.col("comparison_id") == 2), "CANCELLED").when(bad, "FAILED").otherwise("SUCCEEDED").alias("state"))
    return changeplan.label_outcomes(steps, changeplan.wire_dependencies(changes, simple_deps(spark, d)))


@query("d23_render_changes", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'DROP FOREIGN KEY \"s\".\"t\";' WHEN 1 THEN 'ALTER TABLE \"s\".\"t\" ADD COLUMN \"x\" integer NOT NULL;' WHEN 2 THEN 'ALTER TABLE \"s\".\"t\" ALTER COLUMN \"x\" TYPE ' || p_type || ';' WHEN 3 THEN 'ALTER TABLE \"s\".\"t\" ALTER COLUMN \"x\" SET NOT NULL;' WHEN 4 THEN 'COMMENT ON COLUMN \"s\".\"t\".\"x\" IS ''it''''s'';' END AS sql, p_partkey % 6 IN (0, 2, 3) AS destructive, CASE WHEN p_partkey % 6 = 5 THEN 'MANUAL' END AS error FROM part")
def d23(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("p_partkey") % 6).cast("int")
    pick = lambda *v: F.get(F.array(*(x if not isinstance(x, str) and x is not None else F.lit(x) for x in v)), k)
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("comparison_id"), F.col("p_partkey").cast("string").alias("id"), pick("DROP", "ALTER", "ALTER", "ALTER", "ALTER", "MANUAL").alias("kind"), pick("FOREIGN_KEY", "TABLE", "TABLE", "TABLE", "TABLE", "TABLE").alias("object_type"), F.lit("s").alias("schema_name"), F.lit("t").alias("object_key"), pick("$object", "columns[x]", "columns[x].dataType", "columns[x].nullable", "columns[x].comment", "$object").alias("path"), pick(None, None, F.col("p_type"), "false", "it's", None).alias("new_value"), F.when(k == 1, "integer NOT NULL").alias("text"), F.when(k == 5, "MANUAL_ONLY").otherwise("SAFE_AUTOMATIC").alias("automation"))
    return changeplan.render_changes(rows).select(F.col("id").cast("long").alias("p_partkey"), "sql", "destructive", "error")


# Parts are tables (or sequences), the line numbers that occur with a part its columns.
_LC = "(SELECT DISTINCT l_partkey AS k, l_linenumber AS o FROM lineitem)"
_CLAUSE = "'\"c' || o || '\" ' || CASE o % 2 WHEN 0 THEN 'text' ELSE 'integer' END || CASE o % 3 WHEN 0 THEN ' DEFAULT 0' ELSE '' END || CASE o % 2 WHEN 0 THEN ' NULL' ELSE ' NOT NULL' END"
_COLS_OF = "string_agg('\"c' || o || '\"', ', ' ORDER BY o)"
_T = "'\"s\".\"t' || k || '\"'"
_FK = "' ADD CONSTRAINT \"fk\" FOREIGN KEY (' || cols || ') REFERENCES \"s\".\"t1\" (' || cols || ') ON DELETE CASCADE;'"


@query("d23_render_statements", f"""WITH p AS (SELECT p_partkey AS k, p_size AS c FROM part), l AS (SELECT k, {_COLS_OF} AS cols, string_agg({_CLAUSE}, ',' || chr(10) || '    ' ORDER BY o) AS body FROM {_LC} GROUP BY k),
 st AS (SELECT k, 0 AS ph, '' AS r, 'CREATE TABLE ' || {_T} || ' (' || chr(10) || '    ' || body || ',' || chr(10) || '    CONSTRAINT "pk" PRIMARY KEY (' || cols || ')' || chr(10) || ');' AS sql FROM l WHERE k % 8 = 0
  UNION ALL SELECT k, 1, CAST(o AS VARCHAR), 'COMMENT ON COLUMN ' || {_T} || '."c' || o || '" IS ''it''''s'';' FROM {_LC} WHERE o % 3 = 1 AND k % 8 = 0
  UNION ALL SELECT k, 2, 'fk', 'ALTER TABLE ' || {_T} || {_FK} FROM l WHERE k % 8 = 0 AND k % 3 = 0
  UNION ALL SELECT k, 3, 'ix', 'CREATE UNIQUE INDEX "s"."ix" ON ' || {_T} || ' (' || replace(cols, '"', '') || ') WHERE c1 > 0;' FROM l WHERE k % 8 = 0
  UNION ALL SELECT k, 0, '', 'ALTER TABLE ' || {_T} || ' ADD COLUMN ' || {_CLAUSE} || ';' FROM {_LC} WHERE k % 8 = 1 AND o = 1
  UNION ALL SELECT k, 1, '', 'COMMENT ON COLUMN ' || {_T} || '."c1" IS ''it''''s'';' FROM {_LC} WHERE k % 8 = 1 AND o = 1
  UNION ALL SELECT k, 0, 'old', 'ALTER TABLE ' || {_T} || ' DROP CONSTRAINT "old";' FROM p WHERE k % 8 = 2
  UNION ALL SELECT k, 1, 'pk', 'ALTER TABLE ' || {_T} || ' ADD CONSTRAINT "pk" PRIMARY KEY (' || cols || ');' FROM l WHERE k % 8 = 2
  UNION ALL SELECT k, 2, 'fk', 'ALTER TABLE ' || {_T} || {_FK} FROM l WHERE k % 8 = 2 AND k % 3 = 0
  UNION ALL SELECT k, 1, 'ix', 'CREATE UNIQUE INDEX "s"."ix" ON ' || {_T} || ' (' || replace(cols, '"', '') || ') WHERE c1 > 0;' FROM l WHERE k % 8 = 3
  UNION ALL SELECT k, 0, '', CASE k % 8 WHEN 4 THEN 'CREATE SEQUENCE ' || {_T} || ' START WITH 1 INCREMENT BY 2 MAXVALUE 99 NO CYCLE CACHE 20;' WHEN 5 THEN 'ALTER SEQUENCE ' || {_T} || ' INCREMENT BY 2;' ELSE 'DROP FUNCTION ' || {_T} || '(integer);' END FROM p WHERE k % 8 IN (4, 5, 6))
 SELECT c AS comparison_id, 'i' || p.k AS id, CAST(CASE WHEN sql IS NOT NULL THEN row_number() OVER (PARTITION BY p.k ORDER BY ph, r) END AS INTEGER) AS step, sql, p.k % 8 IN (2, 5, 6) AS destructive, CASE WHEN p.k % 8 = 7 THEN 'MANUAL' WHEN sql IS NULL THEN 'UNSUPPORTED_SHAPE' END AS error FROM p LEFT JOIN st USING (k)""")
def d23_statements(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_size").alias("comparison_id"), F.col("p_partkey").alias("k"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("object_key"), F.lit("source").alias("side"))
    kind = (F.col("k") % 8).cast("int")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), kind)
    none = F.lit(None).cast("string")
    changes = part.select("comparison_id", F.concat(F.lit("i"), F.col("k").cast("string")).alias("id"), pick("CREATE", "ALTER", "ALTER", "ALTER", "CREATE", "ALTER", "DROP", "MANUAL").alias("kind"), pick("TABLE", "TABLE", "TABLE", "TABLE", "SEQUENCE", "SEQUENCE", "FUNCTION", "VIEW").alias("object_type"), F.lit("s").alias("schema_name"), "object_key", pick("$object", "columns[c1]", "constraints", "indexes", "$object", "incrementBy", "$object", "$object").alias("path"), F.lit("SAFE_AUTOMATIC").alias("automation"), none.alias("text"), F.lit("integer").alias("signature"), none.alias("parent"))
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("ordinal")).distinct().join(part, "k")
    o = F.col("ordinal")
    name = F.concat(F.lit("c"), o.cast("string"))
    columns = lines.select("comparison_id", "side", "object_key", name.alias("column_name"), o, F.when(o % 2 == 0, "text").otherwise("integer").alias("type"), (o % 2 == 0).alias("nullable"), F.when(o % 3 == 0, "0").alias("default_value"), F.when(o % 3 == 1, "it's").alias("comment"))
    lists = lines.groupBy("comparison_id", "side", "object_key", "k").agg(F.array_sort(F.collect_list(name)).alias("columns"))
    empty = F.expr("cast(array() as array<string>)")
    fields = lambda df, name, kind, cols, ref, action: df.select("comparison_id", "side", "object_key", F.lit(name).alias("constraint_name"), F.lit(kind).alias("kind"), cols.alias("columns"), none.alias("expression"), ref.alias("ref_table"), (cols if action else empty).alias("ref_columns"), none.alias("on_update"), F.lit(action).cast("string").alias("on_delete"), F.lit(False).alias("generated"))
    constraints = fields(lists, "pk", "PRIMARY_KEY", F.col("columns"), none, None).unionByName(fields(lists.where("k % 3 = 0"), "fk", "FOREIGN_KEY", F.col("columns"), F.lit("t1"), "CASCADE"))
    constraints = constraints.unionByName(fields(part.where("k % 8 = 2").withColumn("side", F.lit("target")), "old", "UNIQUE", F.array(F.lit("x")), none, None))
    indexes = lists.select("comparison_id", "side", "object_key", F.lit("ix").alias("index_name"), F.lit(True).alias("is_unique"), F.col("columns").alias("expressions"), F.lit("c1 > 0").alias("predicate"), F.lit(False).alias("generated"))
    both = part.where("k % 8 in (4, 5)").withColumn("side", F.explode(F.array(F.lit("source"), F.lit("target"))))
    sequences = both.select("comparison_id", "side", "object_key", F.lit("1").alias("start_value"), F.when(F.col("side") == "source", "2").otherwise("1").alias("increment_by"), none.alias("min_value"), F.lit("99").alias("max_value"), F.lit(False).alias("cycle"), F.lit(20).alias("cache_size"))
    return rendering.render_statements(changes, columns, constraints, indexes, sequences)
