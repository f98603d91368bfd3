"""Queries over sources, migrations and statement logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.scalars import escape_dump_string
from .operators import exports, loads, migration, sqllog
from .registry import query, table
from .shared import kept, one_process
from .sources import catalogs, readers

# ---------- sources ----------


@query("s2_owned_tables", "SELECT p_name AS table_name FROM part WHERE p_brand = 'Brand#11' AND p_partkey % 4 = 0")
def s2(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("MLOG$_"), "p_name")).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("RUPD$x"), "p_name")).otherwise(F.concat(F.lit("DR$"), "p_name"))
    return readers.owned_tables(table(spark, d, "part").select(F.col("p_brand").alias("owner"), name.alias("table_name")), "Brand#11")


@query("s3_insert_script", "SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN '''s' || chr(10) || 'x, y' ELSE '' END AS c_name, CAST(c_acctbal AS DECIMAL(15,2)) AS c_acctbal, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS seg FROM customer WHERE c_custkey % 10 <> 7")
def s3(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    name = escape_dump_string(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, "'s\nx, y").otherwise("")))
    seg = F.when(F.col("c_custkey") % 3 != 0, escape_dump_string("c_mktsegment")).otherwise("NULL")
    number = F.when(F.col("c_custkey") % 10 == 7, "oops").otherwise(F.col("c_custkey").cast("string"))
    line = F.concat(F.lit("  insert INTO customer (c_custkey, c_name, c_acctbal, seg) VALUES ("), number, F.lit(", "), name, F.lit(", "), F.col("c_acctbal").cast("decimal(15,2)").cast("string"), F.lit(", "), seg, F.lit(");"))
    lines = c.select(line.alias("line")).union(c.select(F.lit("COMMIT;"))).union(c.select(F.lit("-- note")))
    schema = T.StructType.fromDDL("c_custkey bigint, c_name string, c_acctbal decimal(15,2), seg string")
    return readers.typed_rows(readers.insert_lines(lines), schema)[0]


@query("s6_history", "SELECT event_id * 1000 AS ts, event_type AS conn, CAST(NULL AS VARCHAR) AS schema_name, 'select ' || user_id AS sql FROM events WHERE event_id % 4 = 0")
def s6(spark: SparkSession, d: str) -> DataFrame:
    b64 = lambda c: F.base64(c.cast("binary"))
    ts = F.when(F.col("event_id") % 4 == 1, "x").otherwise((F.col("event_id") * 1000).cast("string"))
    sql = F.when(F.col("event_id") % 4 == 2, " ").otherwise(F.concat(F.lit("select "), F.col("user_id").cast("string")))
    parts = [ts, b64(F.col("event_type")), b64(F.lit(" ")), F.when(F.col("event_id") % 4 == 3, "%%%").otherwise(b64(sql))]
    return readers.parse_history(table(spark, d, "events").select(F.concat_ws("|", *parts).alias("line")))


@query("s7_run_sql", "SELECT o_orderstatus, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(15,2))) AS total FROM orders GROUP BY o_orderstatus")
def s7(spark: SparkSession, d: str) -> DataFrame:
    return readers.run_sql(spark, f"SELECT o_orderstatus, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(15,2))) AS total FROM parquet.`{d}/orders.parquet` GROUP BY o_orderstatus")


# ---------- migration ----------

_KINDS = ("VARCHAR2", "NUMBER", "DATE", "CLOB")
_TYPE = "CASE k WHEN 0 THEN 'VARCHAR(' || p_size || ')' WHEN 1 THEN 'NUMERIC(' || p_size || ')' WHEN 2 THEN 'TIMESTAMP' ELSE 'TEXT' END"
_COLS = f"(SELECT p_brand AS owner, p_type AS table_name, p_partkey AS column_id, lower(p_name) AS name, p_partkey % 4 AS k, p_size, {_TYPE} AS type, CASE WHEN p_partkey % 3 = 0 THEN 'note ' || p_partkey END AS comment FROM (SELECT *, p_partkey % 4 AS k FROM part))"


def catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    """Catalog rows from part: a brand is an owner, a type a table, a part a column."""
    k = (F.col("p_partkey") % 4).cast("int")
    kind = F.get(F.array(*map(F.lit, _KINDS)), k)
    return table(spark, d, "part").select(
        F.col("p_brand").alias("owner"), F.col("p_type").alias("table_name"), F.col("p_partkey").alias("column_id"), F.upper("p_name").alias("column_name"), kind.alias("data_type"), F.col("p_size").alias("data_length"),
        F.col("p_size").alias("data_precision"), F.lit(0).alias("data_scale"), F.when(F.col("p_partkey") % 2 == 0, "N").otherwise("Y").alias("nullable"), F.when(k == 2, " SYSDATE ").alias("data_default"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("note "), F.col("p_partkey").cast("string"))).alias("comment"),
    )


@query("m1_map_columns", f"SELECT owner, table_name, column_id, name AS target_name, type AS target_type, column_id % 2 = 0 AS not_null, CASE WHEN k = 2 THEN 'CURRENT_TIMESTAMP' END AS target_default, comment FROM {_COLS}")
def m1(spark: SparkSession, d: str) -> DataFrame:
    return migration.map_columns(catalog_columns(spark, d))


@query("m2_create_tables", f"""SELECT owner, table_name, '-- about ' || table_name || chr(10) || 'CREATE TABLE IF NOT EXISTS ' || lower(table_name) || ' (' || chr(10) || string_agg('    ' || name || ' ' || type || CASE WHEN column_id % 2 = 0 THEN ' NOT NULL' ELSE '' END || CASE WHEN k = 2 THEN ' DEFAULT CURRENT_TIMESTAMP' ELSE '' END || coalesce(' /* ' || comment || ' */', ''), ',' || chr(10) ORDER BY column_id) || chr(10) || ');' || chr(10) || chr(10) || 'COMMENT ON TABLE ' || lower(table_name) || ' IS ''about ' || table_name || ''';' || chr(10) || string_agg(coalesce('COMMENT ON COLUMN ' || lower(table_name) || '.' || name || ' IS ''' || comment || ''';' || chr(10), ''), '' ORDER BY column_id) AS script FROM {_COLS} GROUP BY owner, table_name""")
def m2(spark: SparkSession, d: str) -> DataFrame:
    columns = catalog_columns(spark, d)
    comments = columns.select("owner", "table_name").distinct().withColumn("comment", F.concat(F.lit("about "), "table_name"))
    return migration.create_table_script(columns, comments)


def order_columns(spark: SparkSession, d: str, group: str, kind: str, yes: str, no: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.lit("S").alias("owner"), F.concat(F.lit("N"), F.col("o_custkey").cast("string")).alias(group), F.concat(F.lit("T"), (F.col("o_custkey") % 7).cast("string")).alias("table_name"), F.when(F.col("o_custkey") % 2 == 0, yes).otherwise(no).alias(kind), F.col("o_orderkey").alias("position"), F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("column_name"))


_LIST = "string_agg('c' || o_orderkey, ', ' ORDER BY o_orderkey)"


@query("m3_indexes", f"SELECT 'S' AS owner, 'N' || o_custkey AS index_name, CASE WHEN o_custkey % 2 = 0 THEN 'CREATE UNIQUE INDEX IF NOT EXISTS ' ELSE 'CREATE INDEX IF NOT EXISTS ' END || 'n' || o_custkey || ' ON t' || o_custkey % 7 || ' (' || {_LIST} || ');' AS script FROM orders GROUP BY o_custkey")
def m3(spark: SparkSession, d: str) -> DataFrame:
    return migration.index_script(order_columns(spark, d, "index_name", "uniqueness", "UNIQUE", "NONUNIQUE"))


@query("m3_constraints", f"SELECT 'S' AS owner, 'N' || o_custkey AS constraint_name, 'ALTER TABLE t' || o_custkey % 7 || chr(10) || '    ADD CONSTRAINT n' || o_custkey || ' PRIMARY KEY (' || {_LIST} || ');' AS script FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey")
def m3c(spark: SparkSession, d: str) -> DataFrame:
    return migration.constraint_script(order_columns(spark, d, "constraint_name", "constraint_type", "P", "C"))


@query("m4_sequences", "SELECT c_mktsegment AS owner, c_name AS sequence_name, 'CREATE SEQUENCE IF NOT EXISTS ' || lower(c_name) || chr(10) || '    INCREMENT BY ' || (1 + c_custkey % 3) || chr(10) || '    MINVALUE 1' || chr(10) || '    MAXVALUE ' || c_custkey * 100 || chr(10) || '    START WITH 1' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN '    CYCLE' || chr(10) ELSE '' END || '    CACHE 20;' || chr(10) || chr(10) || 'CREATE OR REPLACE FUNCTION ' || lower(c_name) || '_nextval()' || chr(10) || 'RETURNS BIGINT AS $$' || chr(10) || 'BEGIN' || chr(10) || '    RETURN NEXTVAL(''' || lower(c_name) || ''');' || chr(10) || 'END;' || chr(10) || '$$ LANGUAGE plpgsql;' || chr(10) AS script FROM customer")
def m4(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return migration.sequence_script(c.select(F.col("c_mktsegment").alias("owner"), F.col("c_name").alias("sequence_name"), (F.col("c_custkey") % 3 + 1).alias("increment_by"), F.lit(1).alias("min_value"), (F.col("c_custkey") * 100).alias("max_value"), F.when(F.col("c_custkey") % 2 == 0, "Y").otherwise("N").alias("cycle_flag"), F.lit(20).alias("cache_size")))


@query("m5_routine_source", "SELECT role AS owner, CAST(conv_id AS VARCHAR) AS name, 'FUNCTION' AS type, '-- TODO rewrite by hand: function ' || conv_id || chr(10) || string_agg('-- line ' || turn, chr(10) ORDER BY turn) AS source FROM conversations WHERE conv_id % 3 <> 0 GROUP BY role, conv_id")
def m5(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return migration.routine_source(c.select(F.col("role").alias("owner"), F.col("conv_id").cast("string").alias("name"), F.lit("FUNCTION").alias("type"), F.when(F.col("conv_id") % 3 == 0, "INVALID").otherwise("VALID").alias("status"), F.col("turn").alias("line"), F.concat(F.lit("line "), F.col("turn").cast("string"), F.lit("\n")).alias("text")))


@query("m7_migrate_table", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice, o_orderkey % 2 <> 0 AS flag, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, left(o_orderpriority, 3) AS o_orderpriority FROM orders")
def m7(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 2).alias("FLAG"), "o_orderdate", "o_orderpriority")
    types = {"o_orderkey": ("INTEGER", 0, 0), "o_totalprice": ("NUMBER", 12, 2), "FLAG": ("NUMBER", 1, 0), "o_orderdate": ("DATE", 0, 0), "o_orderpriority": ("CLOB", 0, 0)}
    return migration.migrate_table(o, types, {"FLAG"}, text_limit=3)


_COUNTS = "(" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")) + ")"


def counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        one = table(spark, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows"))
        out = one if out is None else out.unionAll(one)
    return out


def held(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d).where(F.length("table_name") != 6).select(F.upper("table_name").alias("table_name"), F.when(F.col("n_rows") > 100, F.col("n_rows")).otherwise(0).alias("n_rows"))


@query("m8_load_plan", f"SELECT table_name, n_rows, CASE WHEN length(table_name) = 6 THEN 'CREATE_AND_INSERT' WHEN n_rows > 100 THEN 'SKIP' ELSE 'INSERT' END AS action FROM {_COUNTS}")
def m8(spark: SparkSession, d: str) -> DataFrame:
    return migration.load_plan(counts(spark, d), held(spark, d), "incremental")


@query("m9_missing_tables", f"SELECT table_name, n_rows FROM {_COUNTS} WHERE length(table_name) = 6")
def m9(spark: SparkSession, d: str) -> DataFrame:
    return migration.missing_tables(counts(spark, d), held(spark, d))


@query("m10_load_stats", f"SELECT count(*) FILTER (s = 'LOADED') AS n_loaded, count(*) FILTER (s = 'FAILED') AS n_failed, count(*) FILTER (s = 'SKIPPED') AS n_skipped, sum(n_rows) FILTER (s = 'LOADED') AS n_rows, coalesce(string_agg(CASE WHEN s = 'FAILED' THEN table_name END, ', ' ORDER BY table_name), '') AS failed FROM (SELECT *, CASE WHEN length(table_name) = 6 THEN 'LOADED' WHEN length(table_name) = 8 THEN 'FAILED' ELSE 'SKIPPED' END AS s FROM {_COUNTS})")
def m10(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("table_name")
    return migration.load_stats(counts(spark, d).withColumn("status", F.when(n == 6, "LOADED").when(n == 8, "FAILED").otherwise("SKIPPED")))


@query("m10_table_counts", f"SELECT count(*) FILTER (length(table_name) <> 6) AS n_before, count(*) AS n_after, count(*) FILTER (length(table_name) = 6) AS n_new, string_agg(table_name, ', ' ORDER BY table_name) FILTER (length(table_name) = 6) AS new FROM {_COUNTS}")
def m10_tables(spark: SparkSession, d: str) -> DataFrame:
    return migration.table_counts(held(spark, d), counts(spark, d))


@query("m11_verify_totals", f"SELECT (SELECT count(*) FROM {_COUNTS}) AS n_tables, (SELECT sum(n_rows) FROM {_COUNTS}) AS n_rows, (SELECT count(*) FROM events WHERE event_type = 'view') AS n_sequences, (SELECT count(*) FROM events WHERE event_type IN ('click', 'error')) AS n_routines")
def m11(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "SEQUENCE").when(F.col("event_type") == "click", "FUNCTION").when(F.col("event_type") == "error", "PROCEDURE").otherwise("TABLE")
    return migration.verify_totals(counts(spark, d), table(spark, d, "events").select(kind.alias("object_type")))


@query("m12_top_tables", f"SELECT table_name, n_rows FROM {_COUNTS} ORDER BY n_rows DESC, table_name LIMIT 5")
def m12(spark: SparkSession, d: str) -> DataFrame:
    return migration.top_tables(counts(spark, d), 5)


# ---------- statement logs ----------

@query("l1_dedupe_history", "SELECT epoch_us(max(ts)) AS ts, 'select ' || event_type || ' ' || user_id % 50 AS sql FROM events GROUP BY sql ORDER BY ts DESC, sql LIMIT 200")
def l1(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return sqllog.dedupe_history(e.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit(" select "), "event_type", F.lit(" "), (F.col("user_id") % 50).cast("string")).alias("sql")))


@query("l1_history_per_user", "SELECT user_id, epoch_us(m) AS ts, sql FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, sql) AS r FROM (SELECT user_id, max(ts) AS m, 'select ' || event_type AS sql FROM events GROUP BY user_id, event_type)) WHERE r <= 3")
def l1u(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return sqllog.dedupe_history(e.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("select "), "event_type").alias("sql")), 3, ["user_id"])


def scripts(spark: SparkSession, d: str) -> DataFrame:
    """Scripts by construction: six shapes with the event's number in them."""
    n = F.col("event_id").cast("string")
    shapes = F.array(
        F.concat(F.lit("select ';' from t"), n, F.lit("; update t set a = 1;")),
        F.concat(F.lit("-- note ;\ndelete from t"), n, F.lit(" where id = 1 /* a; /* b; */ c; */ ; ; commit")),
        F.concat(F.lit("insert into t values (E'it\\'s; ok', $q$ ; $q$, "), n, F.lit(")")),
        F.concat(F.lit("with x as (select 1) select * from x, t"), n),
        F.concat(F.lit("drop table \"a;b"), n, F.lit("\"")),
        F.concat(F.lit("frobnicate "), n, F.lit("; -- end")),
    )
    return table(spark, d, "events").select(F.col("event_id").alias("script_id"), F.get(shapes, (F.col("event_id") % 6).cast("int")).alias("script"))


_SCRIPTS = """(SELECT event_id AS script_id, unnest([
 {idx: 1, sql: CASE event_id % 6 WHEN 0 THEN 'select '';'' from t' || event_id WHEN 1 THEN '-- note ;' || chr(10) || 'delete from t' || event_id || ' where id = 1 /* a; /* b; */ c; */' WHEN 2 THEN 'insert into t values (E''it\\''s; ok'', $q$ ; $q$, ' || event_id || ')' WHEN 3 THEN 'with x as (select 1) select * from x, t' || event_id WHEN 4 THEN 'drop table "a;b' || event_id || '"' ELSE 'frobnicate ' || event_id END},
 {idx: 2, sql: CASE event_id % 6 WHEN 0 THEN 'update t set a = 1' WHEN 1 THEN 'commit' END}]) AS s, event_id % 6 AS k FROM events)"""


@query("l2_split_statements", f"SELECT script_id, s.idx AS idx, s.sql AS sql FROM {_SCRIPTS} WHERE s.sql IS NOT NULL")
def l2(spark: SparkSession, d: str) -> DataFrame:
    return sqllog.split_statements(scripts(spark, d))


_KIND = "CASE k WHEN 0 THEN CASE s.idx WHEN 1 THEN 'READ' ELSE 'WRITE' END WHEN 1 THEN CASE s.idx WHEN 1 THEN 'WRITE' ELSE 'TRANSACTION_CONTROL' END WHEN 2 THEN 'WRITE' WHEN 3 THEN 'READ' WHEN 4 THEN 'DDL' ELSE 'UNKNOWN' END"
_RISK = "CASE WHEN k = 0 AND s.idx = 2 THEN 'MISSING_WHERE' WHEN k = 1 AND s.idx = 2 THEN 'SESSION_STATE_CONFLICT' WHEN k = 4 THEN 'DESTRUCTIVE_DDL' WHEN k = 5 THEN 'UNKNOWN_STATEMENT' ELSE '' END"


@query("l3_classify_statements", f"SELECT script_id, s.idx AS idx, {_KIND} AS kind, {_RISK} AS risks FROM {_SCRIPTS} WHERE s.sql IS NOT NULL")
def l3(spark: SparkSession, d: str) -> DataFrame:
    out = sqllog.classify_statements(sqllog.split_statements(scripts(spark, d)))
    return out.select("script_id", "idx", "kind", F.array_join("risks", ",").alias("risks"))


@query("l4_policy_decision", "SELECT event_id AS script_id, CASE WHEN event_id % 6 = 1 THEN 'blocked' WHEN event_id % 5 = 0 AND event_id % 6 <> 3 THEN 'blocked' WHEN event_id % 6 IN (0, 4) THEN 'confirm' WHEN event_id % 2 = 0 AND event_id % 6 = 2 THEN 'confirm' ELSE 'allow' END AS decision, CASE WHEN event_id % 6 = 1 THEN CASE WHEN event_id % 5 = 0 THEN '1,2' ELSE '2' END WHEN event_id % 6 = 0 THEN '2' WHEN event_id % 6 = 3 THEN '' WHEN event_id % 5 = 0 OR event_id % 6 IN (2, 4) THEN '1' ELSE '' END AS relevant FROM events")
def l4(spark: SparkSession, d: str) -> DataFrame:
    out = sqllog.classify_statements(sqllog.split_statements(scripts(spark, d)))
    out = out.withColumn("environment", F.when(F.col("script_id") % 2 == 0, "PRODUCTION").otherwise("TEST")).withColumn("read_only", F.col("script_id") % 5 == 0)
    return sqllog.policy_decision(out).withColumn("relevant", F.array_join(F.transform("relevant", lambda i: i.cast("string")), ","))


@query("l5_single_source_table", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 't' || event_id WHEN 1 THEN 's.\"T 1\"' WHEN 5 THEN 'u' END AS source_table FROM events")
def l5(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    shapes = F.array(F.concat(F.lit("select a, 'x from y' from t"), n, F.lit(" where b = (select 1 from z)")), F.lit('SELECT * FROM s."T 1" AS q ORDER BY 1'), F.lit("select * from a, b"), F.lit("select * from a join b on true"), F.lit("select 1 from a union select 2 from b"), F.lit("select max(x) -- c\n from u /* from w */ limit 3;"), F.lit("with q as (select 1) select * from q"))
    return sqllog.single_source_table(table(spark, d, "events").select("event_id", F.get(shapes, (F.col("event_id") % 7).cast("int")).alias("sql"))).select("event_id", "source_table")


@query("l6_audit_commands", "SELECT event_id, (['get|a b', 'flushall', 'CONFIG|set|x|1', 'xread|block|0', NULL, 'set|k|it''s'])[1 + event_id % 6] AS tokens, (['NORMAL', 'CONFIRM', 'CONFIRM', 'BLOCKED', 'NORMAL', 'NORMAL'])[1 + event_id % 6] AS policy, CASE WHEN event_id % 6 = 4 THEN 'UNCLOSED' END AS error FROM events")
def l6(spark: SparkSession, d: str) -> DataFrame:
    shapes = F.array(*map(F.lit, ('get "a b"', " flushall ", "CONFIG set x 1", "xread block 0", "get 'a", "set k it\\'s")))
    out = sqllog.audit_commands(table(spark, d, "events").select("event_id", F.get(shapes, (F.col("event_id") % 6).cast("int")).alias("line")))
    return out.select("event_id", F.array_join("tokens", "|").alias("tokens"), "policy", "error")


def _derby(d: str, name: str) -> str:
    """An embedded database in memory: one for each run, seen by the tasks of a local session alone."""
    return f"jdbc:derby:memory:{name}{uuid.uuid4().hex};create=true"


_DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def _local(spark: SparkSession) -> None:
    if not one_process(spark):  # each executor would open an empty database of its own
        raise RuntimeError("this query's database is in the memory of one process")


@query("e8_write_jdbc", "SELECT c_custkey, c_name FROM customer")
def e8(spark: SparkSession, d: str) -> DataFrame:
    _local(spark)
    url = _derby(d, "e8")
    exports.write_jdbc(table(spark, d, "customer").selectExpr("c_custkey as C_CUSTKEY", "c_name as C_NAME"), url, "APP.CUSTOMERS", partitions=4, properties=_DRIVER)
    return spark.read.format("jdbc").options(url=url, dbtable="APP.CUSTOMERS", **_DRIVER).load().select(F.col("C_CUSTKEY").alias("c_custkey"), F.col("C_NAME").alias("c_name"))


@query("s1_scan_table", "SELECT c_custkey, CAST(c_nationkey AS INTEGER) AS c_nationkey FROM customer")
def s1(spark: SparkSession, d: str) -> DataFrame:
    _local(spark)
    url, rows = _derby(d, "s1"), table(spark, d, "customer").selectExpr("c_custkey as C_CUSTKEY", "cast(c_nationkey as int) as C_NATIONKEY")
    exports.write_jdbc(rows, url, "APP.CUSTOMERS", partitions=4, properties=_DRIVER)
    bounds = rows.agg(F.min("C_CUSTKEY"), F.max("C_CUSTKEY")).first()
    return readers.scan_table(spark, url, "APP.CUSTOMERS", "C_CUSTKEY", tuple(bounds), 4, properties=_DRIVER).select(F.col("C_CUSTKEY").alias("c_custkey"), F.col("C_NATIONKEY").alias("c_nationkey"))


@query("s4_scan_catalog", "SELECT 'n' || c_nationkey AS schema_name, lower(c_mktsegment) AS table_name, 'c' || c_custkey AS column_name, CASE WHEN c_custkey % 2 = 0 THEN 'INTEGER' ELSE 'VARCHAR(9)' END AS data_type, c_custkey % 2 = 1 AS nullable, CAST(row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS INTEGER) AS ordinal FROM customer")
def s4(spark: SparkSession, d: str) -> DataFrame:
    """A database whose schemas are nations, tables segments and columns customers, read back from its catalog."""
    _local(spark)
    url, k = _derby(d, "s4"), F.col("c_custkey")
    clause = F.concat(F.lit('"c'), k.cast("string"), F.when(k % 2 == 0, '" INTEGER NOT NULL').otherwise('" VARCHAR(9)'))
    schema = F.concat(F.lit('"n'), F.col("c_nationkey").cast("string"), F.lit('"'))
    rows = table(spark, d, "customer").groupBy(schema.alias("s"), F.lower("c_mktsegment").alias("t")).agg(F.transform(F.array_sort(F.collect_list(F.struct(k, clause.alias("c")))), lambda x: x["c"]).alias("cs"))
    scripts = rows.select("s", F.concat(F.lit("CREATE TABLE "), "s", F.lit('."'), "t", F.lit('" ('), F.array_join("cs", ", "), F.lit(")")).alias("ddl")).collect()  # a script a table
    loads.run_statements(spark, url, [*(f"CREATE SCHEMA {s}" for s in sorted({r.s for r in scripts})), *(r.ddl for r in scripts)], _DRIVER)
    return catalogs.scan_remote_catalog(spark, url, "columns", "derby", partitions=6, properties=_DRIVER)


@query("s5_scan_keyspace", "SELECT 'orders:' || o_orderpriority || ':' || o_orderkey AS key FROM orders WHERE o_orderpriority LIKE '1%'")
def s5(spark: SparkSession, d: str) -> DataFrame:
    keys = kept(table(spark, d, "orders").select(F.concat_ws(":", F.lit("orders"), "o_orderpriority", F.col("o_orderkey").cast("string")).alias("key")), "keys")
    return readers.scan_keyspace(spark, keys.inputFiles()[0].rsplit("/", 1)[0], "orders:1*").select("key")
