"""Whole-schema migration: catalog tables to scripts, typed copies, loads and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import convert_default, convert_type, escape_comment


def _ordered(rows: DataFrame, by: list[str], order: str, text: str, sep: str, name: str) -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text])
    return rows.groupBy(*by).agg(F.array_join(texts, sep).alias(name))


def map_columns(columns: DataFrame) -> DataFrame:
    """(owner, table_name, column_id, target_name, target_type, not_null, target_default, comment) of catalog columns."""
    default = F.trim("data_default")
    return columns.select(
        "owner", "table_name", "column_id", F.lower("column_name").alias("target_name"), convert_type("data_type", "data_length", "data_precision", "data_scale").alias("target_type"),
        (F.col("nullable") == "N").alias("not_null"), F.when(default != "", convert_default(default)).alias("target_default"), "comment",
    )


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))


def create_table_script(columns: DataFrame, comments: DataFrame) -> DataFrame:
    """(owner, table_name, script): CREATE TABLE and comments of each table; comments (owner, table_name, comment)."""
    c = map_columns(columns)
    clause = F.concat(F.lit("    "), "target_name", F.lit(" "), "target_type", F.when(F.col("not_null"), " NOT NULL").otherwise(""), F.coalesce(F.concat(F.lit(" DEFAULT "), "target_default"), F.lit("")), F.when(F.col("comment").isNotNull(), F.concat(F.lit(" /* "), escape_comment("comment"), F.lit(" */"))).otherwise(""))
    note = F.when(F.col("comment").isNotNull(), F.concat(F.lit("COMMENT ON COLUMN "), F.lower("table_name"), F.lit("."), "target_name", F.lit(" IS '"), _escaped(F.col("comment")), F.lit("';\n")))
    rows = c.select("owner", "table_name", "column_id", clause.alias("clause"), F.coalesce(note, F.lit("")).alias("note"))
    body = _ordered(rows, ["owner", "table_name"], "column_id", "clause", ",\n", "body").join(_ordered(rows, ["owner", "table_name"], "column_id", "note", "", "notes"), ["owner", "table_name"])
    out = body.join(comments.withColumnRenamed("comment", "tc"), ["owner", "table_name"], "left")
    low = F.lower("table_name")
    head = F.coalesce(F.concat(F.lit("-- "), "tc", F.lit("\n")), F.lit(""))
    about = F.coalesce(F.concat(F.lit("COMMENT ON TABLE "), low, F.lit(" IS '"), _escaped(F.col("tc")), F.lit("';\n")), F.lit(""))
    return out.select("owner", "table_name", F.concat(head, F.lit("CREATE TABLE IF NOT EXISTS "), low, F.lit(" (\n"), "body", F.lit("\n);\n\n"), about, "notes").alias("script"))


def _joined(rows: DataFrame, by: list[str]) -> DataFrame:
    return _ordered(rows.withColumn("column_name", F.lower("column_name")), by, "position", "column_name", ", ", "columns")


def index_script(indexes: DataFrame) -> DataFrame:
    """(owner, index_name, script) from (owner, index_name, table_name, uniqueness, position, column_name)."""
    rows = _joined(indexes, ["owner", "index_name", "table_name", "uniqueness"])
    head = F.when(F.col("uniqueness") == "UNIQUE", "CREATE UNIQUE INDEX IF NOT EXISTS ").otherwise("CREATE INDEX IF NOT EXISTS ")
    return rows.select("owner", "index_name", F.concat(head, F.lower("index_name"), F.lit(" ON "), F.lower("table_name"), F.lit(" ("), "columns", F.lit(");")).alias("script"))


def constraint_script(constraints: DataFrame) -> DataFrame:
    """(owner, constraint_name, script) of primary keys (P) and unique constraints (U)."""
    rows = _joined(constraints.where(F.col("constraint_type").isin("P", "U")), ["owner", "constraint_name", "table_name", "constraint_type"])
    kind = F.when(F.col("constraint_type") == "P", "PRIMARY KEY").otherwise("UNIQUE")
    return rows.select("owner", "constraint_name", F.concat(F.lit("ALTER TABLE "), F.lower("table_name"), F.lit("\n    ADD CONSTRAINT "), F.lower("constraint_name"), F.lit(" "), kind, F.lit(" ("), "columns", F.lit(");")).alias("script"))


def sequence_script(sequences: DataFrame) -> DataFrame:
    """(owner, sequence_name, script): CREATE SEQUENCE from 1 on, and a function for its next value."""
    name, text = F.lower("sequence_name"), lambda c: F.col(c).cast("string")
    cycle = F.when(F.col("cycle_flag") == "Y", "    CYCLE\n").otherwise("")
    body = F.concat(F.lit("CREATE SEQUENCE IF NOT EXISTS "), name, F.lit("\n    INCREMENT BY "), text("increment_by"), F.lit("\n    MINVALUE "), text("min_value"), F.lit("\n    MAXVALUE "), text("max_value"), F.lit("\n    START WITH 1\n"), cycle, F.lit("    CACHE "), text("cache_size"), F.lit(";\n\nCREATE OR REPLACE FUNCTION "), name, F.lit("_nextval()\nRETURNS BIGINT AS $$\nBEGIN\n    RETURN NEXTVAL('"), name, F.lit("');\nEND;\n$$ LANGUAGE plpgsql;\n"))
    return sequences.select("owner", "sequence_name", body.alias("script"))


def routine_source(lines: DataFrame) -> DataFrame:
    """(owner, name, type, source) of valid routines: their lines in order, commented out, behind a reminder."""
    rows = lines.where(F.col("status") == "VALID").withColumn("text", F.concat(F.lit("-- "), F.regexp_replace("text", "\n$", "")))
    out = _ordered(rows, ["owner", "name", "type"], "line", "text", "\n", "body")
    return out.select("owner", "name", "type", F.concat(F.lit("-- TODO rewrite by hand: "), F.lower("type"), F.lit(" "), F.lower("name"), F.lit("\n"), "body").alias("source"))


def migrate_table(df: DataFrame, types: dict[str, tuple[str, int, int]], bool_columns: set[str] = frozenset(), text_limit: int | None = None, bytes_limit: int | None = None) -> DataFrame:
    """A typed copy: lower-case names, and values by their source types (type, precision, scale). A number that its target
    can't hold is null. Flags become booleans, and so does their column's type."""
    out = []
    for f in df.schema.fields:
        kind, precision, scale = types[f.name]
        c = F.col(f.name)
        if kind == "NUMBER" and f.name in bool_columns and (precision, scale) == (1, 0):
            c = c != 0
        elif kind == "NUMBER":
            c = c.try_cast(f"decimal({precision},{scale})" if 1 <= precision <= 38 else "decimal(38,10)")
        elif kind in ("FLOAT", "BINARY_FLOAT", "BINARY_DOUBLE"):
            c = c.cast("double")
        elif kind in ("DATE", "TIMESTAMP"):
            c = c.cast("timestamp_ntz")
        elif kind in ("CLOB", "NCLOB") and text_limit:
            c = F.left(c, F.lit(text_limit))
        elif kind in ("BLOB", "RAW") and bytes_limit:
            c = F.when(F.octet_length(c) <= bytes_limit, c)
        out.append(c.alias(f.name.lower()))
    return df.select(*out)


def load_plan(tables: DataFrame, existing: DataFrame, mode: str = "full") -> DataFrame:
    """(table_name, n_rows, action) for tables (table_name, n_rows) against existing (table_name, n_rows): full inserts
    always, creating what is missing; incremental skips tables that hold rows. Names match in any case."""
    there = existing.select(F.lower("table_name").alias("name"), F.col("n_rows").alias("held"))
    rows = tables.join(there, F.lower("table_name") == F.col("name"), "left")
    action = F.when((F.lit(mode) == "incremental") & (F.col("held") > 0), "SKIP").when(F.col("held").isNull(), "CREATE_AND_INSERT").otherwise("INSERT")
    return rows.select("table_name", "n_rows", action.alias("action"))


def load(spark: SparkSession, tables: dict[str, DataFrame], database: str, mode: str = "full") -> dict[str, str]:
    """Loads tables into a database of the session; the outcome of each by name. Each is written as a whole, so that a
    retried task leaves no rows behind; overwrite replaces what is there."""
    out = {}
    for name, df in tables.items():
        target = f"{database}.{name.lower()}"
        there = spark.catalog.tableExists(target)
        if mode == "incremental" and there and not spark.table(target).isEmpty():
            out[name] = "SKIPPED"
            continue
        df.write.mode("overwrite" if mode == "overwrite" else "append").saveAsTable(target)
        out[name] = "LOADED"
    return out


def missing_tables(scripted: DataFrame, existing: DataFrame) -> DataFrame:
    """The tables of the scripts that the target lacks, in any case of letters."""
    low = lambda df: df.withColumn("__low", F.lower("table_name"))
    return low(scripted).join(low(existing).select("__low"), "__low", "left_anti").drop("__low")


def load_stats(outcomes: DataFrame) -> DataFrame:
    """One row of totals of outcomes (table_name, status, n_rows), with the failed names in order."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return outcomes.agg(n("LOADED").alias("n_loaded"), n("FAILED").alias("n_failed"), n("SKIPPED").alias("n_skipped"), F.coalesce(F.sum(F.when(F.col("status") == "LOADED", F.col("n_rows"))), F.lit(0)).alias("n_rows"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "FAILED", F.col("table_name")))), ", ").alias("failed"))


def table_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: n_before and n_after tables of the target (table_name) around a load, n_new, how many more there are, and new, the
    names that came, in order. Names match in any case of letters."""
    named = lambda df, side: df.where("table_name is not null").select(F.lower("table_name").alias("name"), F.lit(side).alias("side"))
    each = named(before, 0).union(named(after, 1)).groupBy("name").agg(F.min("side").alias("low"), F.max("side").alias("high"))
    n = lambda c: F.count(F.when(c, 1))
    came = F.array_join(F.array_sort(F.collect_list(F.when(F.col("low") == 1, F.col("name")))), ", ")
    held = (n(F.col("low") == 0).alias("n_before"), n(F.col("high") == 1).alias("n_after"))
    return each.agg(*held, (n(F.col("high") == 1) - n(F.col("low") == 0)).alias("n_new"), came.alias("new"))


def verify_totals(counts: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: tables and rows from counts (table_name, n_rows), sequences and routines from catalog (object_type)."""
    kinds = catalog.agg(F.count(F.when(F.col("object_type") == "SEQUENCE", 1)).alias("n_sequences"), F.count(F.when(F.col("object_type").isin("FUNCTION", "PROCEDURE"), 1)).alias("n_routines"))
    return counts.agg(F.count("*").alias("n_tables"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")).crossJoin(F.broadcast(kinds))  # one row each


def top_tables(counts: DataFrame, n: int = 10) -> DataFrame:
    return counts.orderBy(F.desc("n_rows"), "table_name").limit(n)


def run_all(spark: SparkSession, tables: dict[str, DataFrame], database: str, types: dict[str, dict[str, tuple[str, int, int]]]) -> DataFrame:
    """Copies tables with their types, loads them incrementally and verifies: (table_name, n_rows) by exact counts."""
    load(spark, {n: migrate_table(df, types[n]) for n, df in tables.items()}, database, "incremental")
    counts = [spark.table(f"{database}.{n.lower()}").agg(F.lit(n.lower()).alias("table_name"), F.count("*").alias("n_rows")) for n in tables]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out
