"""Queries over rows: browsing, scalar functions, edits, exports and keyspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import browse, edits, exports, keyspace
from .registry import query, table

MONEY = "decimal(15,2)"


# ---------- browsing ----------

@query("b1_page", "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(15,2)) AS o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderstatus NULLS LAST, o_orderkey DESC LIMIT 50 OFFSET 100")
def b1(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast(MONEY).alias("o_totalprice"))
    return browse.page(df, 100, 50, [("o_orderstatus", True), ("o_orderkey", False)], "o_totalprice > 1000")


@query("b2_page_with_more", "SELECT o_orderkey, o_orderpriority, (SELECT count(*) FROM orders) > 60 AS has_more FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def b2(spark: SparkSession, d: str) -> DataFrame:
    return browse.page_with_more(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), 40, 20, [("o_orderkey", True)])


@query("b3_count", "SELECT count(*) AS n_rows FROM orders WHERE o_orderstatus = 'F'")
def b3(spark: SparkSession, d: str) -> DataFrame:
    return browse.count_rows(table(spark, d, "orders"), "o_orderstatus = 'F'")


@query("b4_sort_nulls", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY status DESC NULLS FIRST, o_orderkey NULLS LAST")
def b4(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return browse.sort_by(df, [("status", False), ("o_orderkey", True)])


@query("b5_number_rows", "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey NULLS LAST) + 10 AS row_no FROM orders")
def b5(spark: SparkSession, d: str) -> DataFrame:
    return browse.number_rows(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [("o_orderdate", False), ("o_orderkey", True)], 10)


@query("b6_iterate_pages", "SELECT c_custkey, CAST(ceil(row_number() OVER (ORDER BY c_custkey) / 200.0) AS BIGINT) AS page_no FROM customer")
def b6(spark: SparkSession, d: str) -> DataFrame:
    return browse.page_number(table(spark, d, "customer").select("c_custkey"), 200, "c_custkey")


_PARTLY = "CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority END"


def partly(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"))


@query("b6_pages_by_keys", f"SELECT o_orderkey, o_orderstatus, priority, (row_number() OVER (ORDER BY priority DESC NULLS FIRST, o_orderstatus NULLS LAST, o_orderkey) - 1) // 70 + 1 AS page_no FROM (SELECT o_orderkey, o_orderstatus, {_PARTLY} AS priority FROM orders)")
def b6_keys(spark: SparkSession, d: str) -> DataFrame:
    return browse.Pages(partly(spark, d), 70, [("priority", False), ("o_orderstatus", True), ("o_orderkey", True)]).numbered()


@query("b6_page_starts", f"SELECT priority, o_orderstatus, o_orderkey, n // 70 + 1 AS page_no FROM (SELECT o_orderkey, o_orderstatus, {_PARTLY} AS priority, row_number() OVER (ORDER BY {_PARTLY} DESC NULLS FIRST, o_orderstatus NULLS LAST, o_orderkey) - 1 AS n FROM orders) WHERE n % 70 = 0")
def b6_starts(spark: SparkSession, d: str) -> DataFrame:
    return browse.Pages(partly(spark, d), 70, [("priority", False), ("o_orderstatus", True), ("o_orderkey", True)]).starts()


@query("b7_preview", "SELECT conv_id, turn, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS text, CASE WHEN octet_length(encode(text)) > 64 THEN left(lower(hex(encode(text))), 128) || '...(' || octet_length(encode(text)) || ' bytes)' ELSE lower(hex(encode(text))) END AS raw FROM conversations")
def b7(spark: SparkSession, d: str) -> DataFrame:
    return browse.preview(table(spark, d, "conversations").select("conv_id", "turn", "text", F.col("text").cast("binary").alias("raw")))


@query("b8_attach_comments", "SELECT c_custkey, c_name, 'unique number' AS comment_of_key FROM customer")
def b8(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").select("c_custkey", "c_name")
    comments = table(spark, d, "region").where("r_regionkey = 0").select(F.explode(F.expr("map('c_custkey', 'unique number', 'c_phone', 'telephone')")).alias("column_name", "comment"))
    out = browse.attach_comments(df, comments)
    return out.withColumn("comment_of_key", F.lit(out.schema["c_custkey"].metadata["comment"]))


# ---------- scalar functions ----------

RAW = "CASE event_id % 9 WHEN 0 THEN cast(event_id AS {t}) WHEN 1 THEN concat(' ', cast(event_id AS {t}), '.5 ') WHEN 2 THEN '  ' WHEN 3 THEN 'abc' WHEN 4 THEN 'TRUE' WHEN 5 THEN '2024-01-02' WHEN 6 THEN '2024-01-02 03:04:05' WHEN 7 THEN 'n' END"


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.expr(RAW.format(t="string")).alias("raw"))


_R = f"(SELECT event_id, {RAW.format(t='varchar')} AS raw FROM events)"
_BLANK = "(raw IS NULL OR trim(raw) = '')"
_NUM = "CASE WHEN event_id % 9 IN (0, 1) THEN CAST(CAST(trim(raw) AS DECIMAL(38,10)) AS VARCHAR) END"


@query("f1_coerce_text", f"SELECT event_id, {_NUM} AS num, event_id % 9 NOT IN (0, 1) AND NOT {_BLANK} AS num_bad, CASE WHEN event_id % 9 = 5 THEN CAST(raw AS DATE) END AS day, event_id % 9 <> 5 AND NOT {_BLANK} AS day_bad, raw AS txt FROM {_R}")
def f1(spark: SparkSession, d: str) -> DataFrame:
    num = S.coerce_text("raw", "decimal")
    return raw_events(spark, d).select("event_id", num.cast("string").alias("num"), S.coerce_error("raw", "decimal").alias("num_bad"), S.coerce_text("raw", "date").alias("day"), S.coerce_error("raw", "date").alias("day_bad"), S.coerce_text("raw", "varchar").alias("txt"))


@query("f2_parse_bool", "SELECT event_id, CASE WHEN lower(w) IN ('true', 't', '1', 'yes', 'y') THEN true WHEN lower(w) IN ('false', 'f', '0', 'no', 'n') THEN false END AS flag FROM (SELECT event_id, (['True','t','1','YES','y','false','F','0','no','N','2','maybe'])[1 + event_id % 12] AS w FROM events)")
def f2(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*map(F.lit, ("True", "t", "1", "YES", "y", "false", "F", "0", "no", "N", "2", "maybe")))
    return table(spark, d, "events").select("event_id", S.parse_bool(F.get(words, (F.col("event_id") % 12).cast("int"))).alias("flag"))


@query("f3_normalize_timestamp", f"SELECT event_id, CASE event_id % 9 WHEN 5 THEN TIMESTAMP '2024-01-02 00:00:00' WHEN 6 THEN TIMESTAMP '2024-01-02 03:04:05' END AS at FROM {_R}")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return raw_events(spark, d).select("event_id", F.when(F.col("event_id") % 9 > 1, S.coerce_text("raw", "timestamp")).alias("at"))


_CUST = "c_custkey, c_name, CAST(c_acctbal AS DECIMAL(15,2)) AS bal, c_acctbal > 0 AS pos, encode(c_name) AS raw, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment || '''s' END AS seg"


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast(MONEY).alias("bal"), (F.col("c_acctbal") > 0).alias("pos"), F.col("c_name").cast("binary").alias("raw"), F.when(F.col("c_custkey") % 5 != 0, F.concat("c_mktsegment", F.lit("'s"))).alias("seg"))


def literals(spark: SparkSession, d: str, dialect: str) -> DataFrame:
    df = customers(spark, d)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select("c_custkey", *(S.sql_literal(c, kinds[c], dialect).alias(f"{c}_text") for c in ("bal", "pos", "seg") + (("raw",) if dialect != "generic" else ())))


_SEG = "coalesce('''' || replace(seg, '''', '''''') || '''', 'NULL') AS seg_text"


@query("f4_literal_postgres", f"SELECT c_custkey, CAST(bal AS VARCHAR) AS bal_text, CASE WHEN pos THEN 'TRUE' ELSE 'FALSE' END AS pos_text, {_SEG}, '''\\x' || lower(hex(raw)) || '''' AS raw_text FROM (SELECT {_CUST} FROM customer)")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return literals(spark, d, "postgres")


@query("f5_literal_oracle", f"SELECT c_custkey, CAST(bal AS VARCHAR) AS bal_text, CASE WHEN pos THEN '1' ELSE '0' END AS pos_text, {_SEG}, 'HEXTORAW(''' || lower(hex(raw)) || ''')' AS raw_text FROM (SELECT {_CUST} FROM customer)")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return literals(spark, d, "oracle")


@query("f6_literal_generic", f"SELECT c_custkey, CAST(bal AS VARCHAR) AS bal_text, CASE WHEN pos THEN 'TRUE' ELSE 'FALSE' END AS pos_text, {_SEG} FROM (SELECT {_CUST} FROM customer)")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return literals(spark, d, "generic")


@query("f5_literal_oracle_times", "SELECT o_orderkey, 'TO_TIMESTAMP(''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '.0'', ''YYYY-MM-DD HH24:MI:SS.FF'')' AS at_text, 'TO_DATE(''' || strftime(o_orderdate, '%Y-%m-%d') || ''', ''YYYY-MM-DD'')' AS day_text FROM orders")
def f5_times(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", F.date_trunc("second", "o_orderdate").alias("at"), F.to_date("o_orderdate").alias("day"))
    return df.select("o_orderkey", S.sql_literal("at", "timestamp", "oracle").alias("at_text"), S.sql_literal("day", "date", "oracle").alias("day_text"))


_ESC = "'''' || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '''', ''''''), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || ''''"


@query("f7_migration_literal", f"SELECT c.conv_id, c.turn, {_ESC} AS clob, CASE WHEN turn % 2 = 0 THEN 'FALSE' ELSE 'TRUE' END AS flag, CAST(turn AS VARCHAR) AS num, CASE WHEN octet_length(encode(text)) > 10000 THEN 'NULL' ELSE '''\\x' || lower(hex(encode(text))) || '''::bytea' END AS blob FROM conversations c")
def f7(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "conversations")
    return df.select("conv_id", "turn", S.migration_literal("text", "string", "CLOB", most_text=50_000).alias("clob"), S.migration_literal(F.col("turn") % 2, "bigint", "NUMBER", 1, 0, True).alias("flag"), S.migration_literal("turn", "bigint", "NUMBER", 10, 0).alias("num"), S.migration_literal(F.col("text").cast("binary"), "binary", "BLOB", most_bytes=10_000).alias("blob"))


@query("f8_dump_string", f"SELECT conv_id, turn, {_ESC} AS escaped, text AS back FROM conversations")
def f8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").withColumn("escaped", S.escape_dump_string("text")).select("conv_id", "turn", "escaped", S.unescape_dump_string("escaped").alias("back"))


@query("f9_identifiers", "SELECT p_partkey, '\"' || p_name || '\"' AS quoted, CASE WHEN regexp_matches(p_name, '^[A-Za-z_][A-Za-z0-9_$#]*$') THEN p_name ELSE '\"' || p_name || '\"' END AS needed, lower(p_brand) AS folded_pg, upper(p_brand) AS folded_ora, CASE WHEN p_partkey % 3 = 0 THEN '\"' || p_name || '\"' ELSE '\"' || p_brand || '\".\"' || p_name || '\"' END AS full_name FROM part")
def f9(spark: SparkSession, d: str) -> DataFrame:
    schema = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", S.quote_ident("p_name").alias("quoted"), S.quote_if_needed("p_name").alias("needed"), S.fold_ident("p_brand").alias("folded_pg"), S.fold_ident("p_brand", "oracle").alias("folded_ora"), S.qualify(schema, F.col("p_name")).alias("full_name"))


_KINDS = "['VARCHAR2','NUMBER','DATE','CLOB','BLOB','FLOAT','TIMESTAMP WITH TIME ZONE','TIMESTAMP(6)','CHAR','XMLTYPE']"


@query("f10_convert_type", f"SELECT p_partkey, CASE k WHEN 'VARCHAR2' THEN 'VARCHAR(' || p_size || ')' WHEN 'CHAR' THEN 'CHAR(' || p_size || ')' WHEN 'NUMBER' THEN CASE WHEN p = 0 AND s = 0 THEN 'NUMERIC' WHEN s > 0 THEN 'NUMERIC(' || p || ',' || s || ')' ELSE 'NUMERIC(' || p || ')' END WHEN 'DATE' THEN 'TIMESTAMP' WHEN 'CLOB' THEN 'TEXT' WHEN 'BLOB' THEN 'BYTEA' WHEN 'FLOAT' THEN 'DOUBLE PRECISION' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'TIMESTAMPTZ' WHEN 'XMLTYPE' THEN 'XML' ELSE k END AS target FROM (SELECT p_partkey, p_size, ({_KINDS})[1 + p_partkey % 10] AS k, p_partkey // 10 % 20 AS p, p_size % 3 AS s FROM part)")
def f10(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").select("p_partkey", "p_size", F.get(F.array(*(F.lit(x.strip("'")) for x in _KINDS[1:-1].split(","))), (F.col("p_partkey") % 10).cast("int")).alias("k"), F.expr("int(p_partkey div 10 % 20)").alias("p"), (F.col("p_size") % 3).alias("s"))
    return df.select("p_partkey", S.convert_type("k", "p_size", "p", "s").alias("target"))


@query("f11_f13_defaults_comments", "SELECT event_id, (['CURRENT_TIMESTAMP','CURRENT_TIMESTAMP','gen_random_uuid()','0'])[1 + event_id % 4] AS dflt, ([true, true, true, false])[1 + event_id % 4] AS is_bool, (['a * / b','/ * c','x',''])[1 + event_id % 4] AS comment FROM events")
def f11(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (F.col("event_id") % 4).cast("int"))
    return table(spark, d, "events").select("event_id", S.convert_default(pick("SYSDATE", "sysTimestamp", "SYS_GUID() ", "0")).alias("dflt"), S.is_bool_comment(pick("1 是 0 否", "True or False", "flag Y/N", "note")).alias("is_bool"), S.escape_comment(pick("a */ b", "/* c", "x", None)).alias("comment"))


_CSV = "CASE WHEN regexp_matches(text, '[,\"\\n\\r]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END"
_HTML = "replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("f14_csv_field", f"SELECT conv_id, turn, {_CSV} AS field FROM conversations")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", S.csv_field("text").alias("field"))


@query("f15_markup_escape", f"SELECT page_id, {_HTML.format(c='html')} AS html_text, {_HTML.format(c='html')} AS xml_text FROM pages")
def f15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", S.html_escape("html").alias("html_text"), S.xml_escape("html").alias("xml_text"))


@query("f16_f17_names", "SELECT c_custkey, 'COUNT___' AS tag, 'AB' || c_custkey AS ref FROM customer")
def f16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.lit(S.xml_name("COUNT(*)")).alias("tag"), S.cell_ref(27, F.col("c_custkey")).alias("ref"))


@query("f18_format_pg_type", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'character varying(' || p_size || ')' WHEN 1 THEN CASE WHEN p_size % 3 > 0 THEN 'numeric(' || p_size || ',' || p_size % 3 || ')' ELSE 'numeric(' || p_size || ')' END WHEN 2 THEN 'integer' ELSE 'text' END AS type FROM part")
def f18(spark: SparkSession, d: str) -> DataFrame:
    base = F.get(F.array(*map(F.lit, ("character varying", "numeric", "integer", "text"))), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, d, "part").select("p_partkey", S.format_pg_type(base, F.col("p_size"), F.col("p_size"), F.col("p_size") % 3).alias("type"))


@query("f19_normalize_definition", "SELECT event_id, (['SELECT ' || event_id, 'SELECT '';''', 'SELECT 1 -- ;', 'a' || chr(10) || 'b', '$$ x; $$', 'SELECT 1 /* ; */'])[1 + event_id % 6] AS body FROM events")
def f19(spark: SparkSession, d: str) -> DataFrame:
    texts = (F.concat(F.lit("SELECT "), F.col("event_id").cast("string"), F.lit(" ;\r\n")), F.lit(" SELECT ';'"), F.lit("SELECT 1 -- ;"), F.lit("a\r\nb;"), F.lit("$$ x; $$;"), F.lit("SELECT 1 /* ; */"))
    return table(spark, d, "events").select("event_id", S.normalize_definition(F.get(F.array(*texts), (F.col("event_id") % 6).cast("int"))).alias("body"))


@query("f20_identity_key", "SELECT p_partkey, 'table' || chr(0) || p_brand || chr(0) || p_name AS pg, '5:table' || length(p_brand) || ':' || p_brand || length(p_name) || ':' || p_name AS ora, NOT regexp_matches(p_name, '^[a-z_][a-z0-9_$]*$') AS quote_pg FROM part")
def f20(spark: SparkSession, d: str) -> DataFrame:
    args = F.lit("table"), F.col("p_brand"), F.col("p_name")
    return table(spark, d, "part").select("p_partkey", S.identity_key(*args).alias("pg"), S.identity_key(*args, dialect="oracle").alias("ora"), S.needs_quoting("p_name").alias("quote_pg"))


@query("f21_display", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '0xff00' WHEN 1 THEN event_type ELSE '0x' || lower(hex(encode(event_type))) || '01' END AS shown FROM events")
def f21(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.unhex(F.lit("ff00"))).when(F.col("event_id") % 3 == 1, F.col("event_type").cast("binary")).otherwise(F.concat(F.col("event_type").cast("binary"), F.unhex(F.lit("01"))))
    return table(spark, d, "events").select("event_id", S.display(raw).alias("shown"))


_FIELD = "unhex(printf('%08X', octet_length(encode({c})))) || encode({c})"


@query("f22_canonical_hash", f"SELECT p_partkey, sha256({_FIELD.format(c=chr(39) + 'part' + chr(39))} || {_FIELD.format(c='p_name')} || {_FIELD.format(c='p_brand')}) AS digest FROM part")
def f22(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.canonical_hash("part", "p_name", "p_brand").alias("digest"))


# ---------- exports ----------

def plain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast(MONEY).alias("c_acctbal"), F.when(F.col("c_custkey") % 5 != 0, F.concat("c_mktsegment", F.lit(", \"x\" & <y>"))).alias("user id"))


_PLAIN = "(SELECT c_custkey, c_name, CAST(c_acctbal AS DECIMAL(15,2)) AS c_acctbal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment || ', \"x\" & <y>' END AS u FROM customer)"
_U = _HTML.format(c="u")


@query("e1_csv_lines", f"SELECT c_custkey || ',' || c_name || ',' || c_acctbal || ',' || coalesce('\"' || replace(u, '\"', '\"\"') || '\"', '') AS line FROM {_PLAIN}")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return exports.csv_lines(plain(spark, d))


@query("e2_html_rows", f"SELECT '<tr><td>' || c_custkey || '</td><td>' || c_name || '</td><td>' || c_acctbal || '</td><td>' || coalesce({_U}, '') || '</td></tr>' AS line FROM {_PLAIN}")
def e2(spark: SparkSession, d: str) -> DataFrame:
    return exports.html_rows(plain(spark, d))


@query("e3_xml_rows", f"SELECT ' <ROW>' || chr(10) || '  <c_custkey>' || c_custkey || '</c_custkey>' || chr(10) || '  <c_name>' || c_name || '</c_name>' || chr(10) || '  <c_acctbal>' || c_acctbal || '</c_acctbal>' || chr(10) || coalesce('  <user_id name=\"user id\">' || {_U} || '</user_id>' || chr(10), '') || ' </ROW>' AS line FROM {_PLAIN}")
def e3(spark: SparkSession, d: str) -> DataFrame:
    return exports.xml_rows(plain(spark, d))


_X = "CAST(1 + row_number() OVER (ORDER BY c_custkey) AS VARCHAR)"


@query("e4_xlsx_rows", f"SELECT CAST(r AS BIGINT) AS row_no, '<row r=\"' || r || '\"><c r=\"A' || r || '\"><v>' || c_custkey || '</v></c><c r=\"B' || r || '\" t=\"inlineStr\"><is><t xml:space=\"preserve\">' || c_name || '</t></is></c><c r=\"C' || r || '\"><v>' || c_acctbal || '</v></c>' || coalesce('<c r=\"D' || r || '\" t=\"inlineStr\"><is><t xml:space=\"preserve\">' || {_U} || '</t></is></c>', '') || '</row>' AS xml FROM (SELECT *, {_X} AS r FROM {_PLAIN})")
def e4(spark: SparkSession, d: str) -> DataFrame:
    return exports.xlsx_rows(plain(spark, d), [("c_custkey", True)])


_VALUES = "c_custkey || ', ''' || c_name || ''', ' || c_acctbal || ', ' || coalesce('''' || u || '''', 'NULL')"


@query("e5_insert_statements", f"SELECT 'INSERT INTO customer (c_custkey, c_name, c_acctbal, \"user id\") VALUES (' || {_VALUES} || ');' AS line FROM {_PLAIN}")
def e5(spark: SparkSession, d: str) -> DataFrame:
    return exports.insert_statements(plain(spark, d), "customer")


@query("e6_insert_script", f"SELECT b AS batch_no, 'INSERT INTO \"s\".\"customer\" (\"c_custkey\", \"c_name\", \"c_acctbal\", \"user id\") VALUES' || chr(10) || string_agg('  (' || {_VALUES} || ')', ',' || chr(10) ORDER BY c_custkey) || ';' AS line FROM (SELECT *, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS b FROM {_PLAIN}) GROUP BY b")
def e6(spark: SparkSession, d: str) -> DataFrame:
    return exports.insert_script(plain(spark, d), "s", "customer", [("c_custkey", True)])


_DUMP = "'INSERT INTO customer (c_custkey, c_name, c_acctbal) VALUES (' || c_custkey || ', ''' || c_name || ''', ' || c_acctbal || ');'"


@query("e7_migration_dump", f"WITH r AS (SELECT 2 * row_number() OVER (ORDER BY c_custkey) AS seq, {_DUMP} AS line FROM {_PLAIN}) SELECT seq, line FROM r UNION ALL SELECT seq + 1, 'COMMIT;' FROM r WHERE seq % 1000 = 0 OR seq = (SELECT max(seq) FROM r)")
def e7(spark: SparkSession, d: str) -> DataFrame:
    types = {"c_custkey": ("NUMBER", 10, 0), "c_name": ("VARCHAR2", 0, 0), "c_acctbal": ("NUMBER", 15, 2)}
    return exports.migration_dump(plain(spark, d).drop("user id"), "CUSTOMER", types, [("c_custkey", True)], commit_every=500)


@query("e10_dump_stats", "SELECT c_mktsegment AS table_name, count(*) AS n_rows, sum(length('INSERT INTO ' || c_name) + 1) AS n_chars, 'ok' AS status FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'none', 0, 8, 'empty'")
def e10(spark: SparkSession, d: str) -> DataFrame:
    dumps = table(spark, d, "customer").select(F.col("c_mktsegment").alias("table_name"), F.concat(F.lit("INSERT INTO "), "c_name").alias("line"))
    return exports.dump_stats(dumps.union(table(spark, d, "region").where("r_regionkey = 0").select(F.lit("none"), F.lit("COMMIT;"))))


@query("e10_dump_totals", "SELECT count(*) FILTER (s = 'ok') AS n_ok, count(*) FILTER (s = 'empty') AS n_empty, count(*) FILTER (s = 'failed') AS n_failed, coalesce(sum(n) FILTER (s = 'ok'), 0) AS n_rows, coalesce(sum(c) FILTER (s = 'ok'), 0) AS n_chars, string_agg(t, ', ' ORDER BY t) FILTER (s = 'failed') AS failed FROM (SELECT n_name AS t, count(c_custkey) AS n, coalesce(sum(length(c_name) + 13), 0) + 8 AS c, CASE WHEN n_nationkey % 5 = 0 THEN 'failed' WHEN count(c_custkey) = 0 THEN 'empty' ELSE 'ok' END AS s FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_nationkey % 7 <> 0 GROUP BY n_name, n_nationkey)")
def e10_totals(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("table_name"))
    rows = table(spark, d, "customer").where("c_nationkey % 7 <> 0").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("table_name", F.concat(F.lit("INSERT INTO "), "c_name").alias("line"))
    ends = nations.select("table_name", F.lit("COMMIT;").alias("line"))
    return exports.dump_totals(exports.dump_stats(rows.union(ends), nations.where("n_nationkey % 5 = 0")))


# ---------- edits ----------

def order_edits(spark: SparkSession, d: str) -> DataFrame:
    """Edits of orders: of each ten, some hit, one is stale, one sets null, and every twentieth order has two."""
    o = table(spark, d, "orders").where("o_orderkey % 10 < 3")
    key = F.struct(F.when(F.col("o_orderkey") % 10 == 2, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).cast("string").alias("o_orderkey"))
    values = F.when(F.col("o_orderkey") % 10 == 0, F.create_map(F.lit("o_orderstatus"), F.lit("X"))).otherwise(F.create_map(F.lit("o_orderpriority"), F.lit(None).cast("string"), F.lit("o_custkey"), F.lit(" 7 ")))
    one = o.select(F.col("o_orderkey").alias("edit_id"), F.lit(1).alias("edit_seq"), key.alias("key"), values.alias("values"))
    two = o.where("o_orderkey % 20 = 0").select((F.col("o_orderkey") + 1_000_000_000).alias("edit_id"), F.lit(2).alias("edit_seq"), key.alias("key"), F.create_map(F.lit("o_orderstatus"), F.lit("Y")).alias("values"))
    return one.union(two)


def base_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("c2_changed_values", "SELECT o_orderkey, 'UPDATE' AS op, CASE WHEN o_orderkey % 2 = 0 THEN 'o_orderstatus=Z' ELSE 'o_custkey=' || (o_custkey + 1) END AS changed FROM orders WHERE o_orderkey % 10 IN (0, 1) AND (o_orderkey % 2 = 1 OR o_orderstatus <> 'Z')")
def c2(spark: SparkSession, d: str) -> DataFrame:
    before = base_orders(spark, d)
    after = before.where("o_orderkey % 10 in (0, 1)").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1).alias("o_custkey"), F.when(F.col("o_orderkey") % 2 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority")
    out = edits.changed_values(before, after, ["o_orderkey"])
    return out.select("o_orderkey", "op", F.array_join(F.transform(F.map_entries("changed"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("changed"))


@query("c3_changes_key", "SELECT o_orderkey AS edit_id, o_orderkey % 10 <> 0 AS touches_key FROM orders WHERE o_orderkey % 10 < 3 UNION ALL SELECT o_orderkey + 1000000000, false FROM orders WHERE o_orderkey % 20 = 0")
def c3(spark: SparkSession, d: str) -> DataFrame:
    return edits.changes_key(order_edits(spark, d), ["o_custkey"]).select("edit_id", "touches_key")


@query("c4_validate_edits", "SELECT o_orderkey AS edit_id, 'o_custkey' AS column_name, 'bigint' AS kind, 'x' || o_custkey AS value, 'BAD_VALUE' AS error FROM orders WHERE o_orderkey % 10 = 1 UNION ALL SELECT o_orderkey, 'no_such', NULL, '1', 'UNKNOWN_COLUMN' FROM orders WHERE o_orderkey % 10 = 2 UNION ALL SELECT o_orderkey, NULL, NULL, NULL, 'NO_VALUES' FROM orders WHERE o_orderkey % 10 = 3")
def c4(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("o_orderkey") % 10
    none = F.expr("cast(map() as map<string,string>)")
    values = F.when(m == 0, F.create_map(F.lit("o_custkey"), F.lit(" 12 "))).when(m == 1, F.create_map(F.lit("o_custkey"), F.concat(F.lit("x"), F.col("o_custkey").cast("string")))).when(m == 2, F.create_map(F.lit("no_such"), F.lit("1"))).otherwise(none)
    orders = base_orders(spark, d)
    return edits.validate_edits(orders.where(m < 4).select(F.col("o_orderkey").alias("edit_id"), values.alias("values")), orders.schema)


@query("c5_apply_inserts", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders UNION ALL SELECT o_orderkey + 1000000000, 5, 'O', NULL FROM orders WHERE o_orderkey % 10 = 0")
def c5(spark: SparkSession, d: str) -> DataFrame:
    df = base_orders(spark, d)
    rows = df.where("o_orderkey % 10 = 0").select(F.create_map(F.lit("o_orderkey"), (F.col("o_orderkey") + 1_000_000_000).cast("string"), F.lit("o_custkey"), F.lit("5")).alias("values"))
    return edits.apply_inserts(df, rows, {"o_orderstatus": F.lit("O")})


@query("c6_apply_updates", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 7 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 20 = 0 THEN 'Y' WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 10 <> 1 THEN o_orderpriority END AS o_orderpriority FROM orders")
def c6(spark: SparkSession, d: str) -> DataFrame:
    return edits.apply_updates(base_orders(spark, d), order_edits(spark, d), ["o_orderkey"])[0]


_LINES = "(SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)"


def line_edits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    named = lines.select("l_orderkey", "l_linenumber").distinct().where("l_orderkey % 7 = 0")
    key = F.struct(F.col("l_orderkey").cast("string").alias("l_orderkey"), F.when(F.col("l_linenumber") == 1, "99").otherwise(F.col("l_linenumber").cast("string")).alias("l_linenumber"))
    return lines, named.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edit_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edit_seq"), key.alias("key"))


@query("c7_apply_deletes", f"SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l JOIN {_LINES} k ON l.l_orderkey = k.l_orderkey AND l.l_linenumber = k.l_linenumber WHERE NOT (l.l_orderkey % 7 = 0 AND k.n = 1 AND l.l_linenumber <> 1)")
def c7(spark: SparkSession, d: str) -> DataFrame:
    return edits.apply_deletes(*line_edits(spark, d), ["l_orderkey", "l_linenumber"])[0]


_FAIL = f"(SELECT l_orderkey * 10 + l_linenumber AS edit_id, CASE WHEN l_linenumber = 1 THEN 0 ELSE n END AS matched FROM {_LINES} WHERE l_orderkey % 7 = 0)"
_STATUS = "CASE WHEN matched = 1 THEN 'APPLIED' WHEN matched = 0 THEN 'STALE' ELSE 'AMBIGUOUS' END"


@query("c8_ordered_deletes", f"SELECT edit_id, 'DELETE' AS op, matched, CASE WHEN edit_id > (SELECT min(edit_id) FROM {_FAIL} WHERE matched <> 1) THEN 'SKIPPED' ELSE {_STATUS} END AS status FROM {_FAIL}")
def c8(spark: SparkSession, d: str) -> DataFrame:
    return edits.apply_ordered_deletes(*line_edits(spark, d), ["l_orderkey", "l_linenumber"])[1].drop("message")


@query("c9_edit_outcomes", f"SELECT edit_id, 'DELETE' AS op, matched, {_STATUS} AS status FROM {_FAIL}")
def c9(spark: SparkSession, d: str) -> DataFrame:
    lines, told = line_edits(spark, d)
    return edits.outcomes(lines, told, ["l_orderkey", "l_linenumber"], "DELETE")


def batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Several edits an order, each on what the one before left: renamed keys, inserts that are deleted again, keys that are taken, gone or bad."""
    o = base_orders(spark, d)
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 10
    one = lambda when, seq, op, key, values: F.when(when, F.struct(F.lit(seq).alias("edit_seq"), F.lit(op).alias("op"), F.struct(key.cast("string").alias("o_orderkey")).alias("key"), values.alias("values")))
    sets = lambda *kv: F.create_map(*(x if i % 2 else F.lit(x) for i, x in enumerate(kv)))
    none, text = F.lit(None).cast("map<string,string>"), lambda c: c.cast("string")
    far = k + 1_000_000_000
    steps = F.array(
        one(m == 1, 1, "UPDATE", k, sets("o_orderkey", text(far))), one(m == 1, 2, "UPDATE", far, sets("o_orderstatus", F.lit("Z"))),
        one(m == 2, 1, "INSERT", F.lit(None), sets("o_orderkey", text(far), "o_custkey", F.lit("7"))), one(m == 2, 3, "DELETE", far, none), one(m == 2, 4, "DELETE", far, none),
        one(m == 3, 1, "INSERT", F.lit(None), sets("o_orderkey", text(k))), one(m == 3, 2, "UPDATE", k, sets("o_orderstatus", F.lit("N"))),
        one(m == 4, 1, "DELETE", k, none), one(m == 4, 2, "UPDATE", k, sets("o_orderstatus", F.lit("N"))),
        one(m == 5, 1, "UPDATE", k, sets("o_custkey", F.lit("x"))), one(m == 5, 2, "DELETE", F.lit("x"), none),
        one(m == 6, 1, "UPDATE", k, sets("o_orderkey", text(far))), one(m == 6, 2, "UPDATE", far, sets("o_orderkey", text(k), "o_custkey", F.lit("8"))),
    )
    each = o.select("o_orderkey", F.posexplode(steps).alias("i", "e")).where("e is not null")
    return o, each.select((F.col("o_orderkey") * 100 + F.col("i")).alias("edit_id"), "e.*")


@query("c9_replay_outcomes", """SELECT o_orderkey * 100 + e.i AS edit_id, e.op AS op, CAST(e.n AS BIGINT) AS matched, e.s AS status, e.m AS message FROM (SELECT o_orderkey, unnest(CASE o_orderkey % 10
 WHEN 1 THEN [{i: 0, op: 'UPDATE', n: 1, s: 'APPLIED', m: NULL}, {i: 1, op: 'UPDATE', n: 1, s: 'APPLIED', m: NULL}]
 WHEN 2 THEN [{i: 2, op: 'INSERT', n: 1, s: 'APPLIED', m: NULL}, {i: 3, op: 'DELETE', n: 1, s: 'APPLIED', m: NULL}, {i: 4, op: 'DELETE', n: 0, s: 'STALE', m: 'no row has the old key values'}]
 WHEN 3 THEN [{i: 5, op: 'INSERT', n: 1, s: 'APPLIED', m: NULL}, {i: 6, op: 'UPDATE', n: 2, s: 'AMBIGUOUS', m: '2 rows have the old key values'}]
 WHEN 4 THEN [{i: 7, op: 'DELETE', n: 1, s: 'APPLIED', m: NULL}, {i: 8, op: 'UPDATE', n: 0, s: 'STALE', m: 'no row has the old key values'}]
 WHEN 5 THEN [{i: 9, op: 'UPDATE', n: 0, s: 'INVALID', m: 'o_custkey: BAD_VALUE'}, {i: 10, op: 'DELETE', n: 0, s: 'INVALID', m: 'BAD_KEY'}]
 WHEN 6 THEN [{i: 11, op: 'UPDATE', n: 1, s: 'APPLIED', m: NULL}, {i: 12, op: 'UPDATE', n: 1, s: 'APPLIED', m: NULL}] END) AS e FROM orders WHERE o_orderkey % 10 BETWEEN 1 AND 6)""")
def c9_replay(spark: SparkSession, d: str) -> DataFrame:
    return edits.replay(*batch(spark, d), ["o_orderkey"])[1]


@query("c6_replay_batch", "SELECT CASE WHEN o_orderkey % 10 = 1 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 10 = 6 THEN 8 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 10 = 1 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 4 UNION ALL SELECT o_orderkey, NULL, NULL, NULL FROM orders WHERE o_orderkey % 10 = 3")
def c6_replay(spark: SparkSession, d: str) -> DataFrame:
    return edits.replay(*batch(spark, d), ["o_orderkey"])[0]


# ---------- keyspaces ----------

_KEYS = "(SELECT event_type || ':' || user_id || ':' || event_id AS key FROM events)"


def keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("key"))


@query("k1_match_keys", f"SELECT key FROM {_KEYS} WHERE regexp_matches(key, '^c.*[a-k]:[0-9]*5:.*1$')")
def k1(spark: SparkSession, d: str) -> DataFrame:
    return keyspace.match_keys(keys(spark, d), "c*[a-k]:*5:*1")


@query("k2_key_tree", "WITH k AS (SELECT DISTINCT url AS key, string_split(url, '/') AS p FROM pages), n AS (SELECT p[1:i] AS path, i AS depth, CASE WHEN i = len(p) THEN key END AS fk FROM (SELECT key, p, unnest(range(len(p) + 1)) AS i FROM k)) SELECT array_to_string(path, '|') AS path, CAST(depth AS INTEGER) AS depth, CASE WHEN depth > 0 THEN path[-1] ELSE '' END AS segment, max(fk) AS full_key, count(*) AS key_count FROM n GROUP BY ALL")
def k2(spark: SparkSession, d: str) -> DataFrame:
    return keyspace.key_tree(table(spark, d, "pages").select(F.col("url").alias("key")), "/").withColumn("path", F.array_join("path", "|"))


@query("k3_keyspace_sizes", "SELECT CAST(i AS INTEGER) AS db, coalesce((SELECT max(o_custkey) FROM orders WHERE o_orderkey % 32 = i), 0) AS n_keys FROM range(16) t(i)")
def k3(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 32).alias("db")).agg(F.max("o_custkey").alias("n"))
    return keyspace.keyspace_sizes(o.select(F.when(F.col("db") < 16, F.format_string("db%d:keys=%d,expires=0", "db", "n")).otherwise("# Keyspace").alias("line")))


@query("k4_fold_pairs", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ODD_LENGTH' END AS error, CASE WHEN c_custkey % 3 = 1 THEN '' WHEN c_custkey % 3 = 2 THEN 'name=' || c_name || ';seg=' || c_mktsegment END AS pairs FROM customer")
def k4(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("c_custkey") % 3
    items = F.when(m == 0, F.array(F.lit("name"))).when(m == 1, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("name"), F.col("c_name"), F.lit("seg"), F.col("c_mktsegment")))
    out = keyspace.fold_pairs(table(spark, d, "customer").select("c_custkey", items.alias("items")))
    return out.select("c_custkey", "error", F.array_join(F.transform("pairs", lambda p: F.concat(p["field"], F.lit("="), p["value"])), ";").alias("pairs"))


@query("k5_list_page", "SELECT o_custkey AS key, CAST(i - 1 AS INTEGER) AS idx, l[i] AS item, CAST(len(l) AS INTEGER) AS length, len(l) > 7 AS has_next FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey), range(3, 8) t(i) WHERE i <= len(l)")
def k5(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("items"))
    return keyspace.list_page(lists, 2, 5)


@query("k6_value_preview", "SELECT page_id AS key, CAST(octet_length(encode(html)) AS INTEGER) AS length, lower(hex(CASE WHEN octet_length(encode(html)) > 1000 THEN encode(html)[1:100] ELSE encode(html) END)) AS value, octet_length(encode(html)) > 1000 AS is_preview FROM pages")
def k6(spark: SparkSession, d: str) -> DataFrame:
    out = keyspace.value_preview(table(spark, d, "pages").select(F.col("page_id").alias("key"), F.col("html").cast("binary").alias("value")), 1000, 100)
    return out.withColumn("value", F.lower(F.hex("value")))


@query("k7_ttl_state", "SELECT event_id AS key, event_id % 5 - 2 AS ttl, (['missing', 'persistent', 'expiring', 'expiring', 'expiring'])[1 + event_id % 5] AS state FROM events")
def k7(spark: SparkSession, d: str) -> DataFrame:
    return keyspace.ttl_state(table(spark, d, "events").select(F.col("event_id").alias("key"), (F.col("event_id") % 5 - 2).alias("ttl")))
