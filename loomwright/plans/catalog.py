"""Catalog roll-ups: rows of columns, indexes, constraints and the like to tables, scripts and snapshots, for many schemas at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import format_pg_type, qualify, quote_ident
from ..shared import kept

TABLE = ["schema_name", "table_name"]


def _list(order: str, value: str | Column) -> Column:
    """Values of a group in the order of a column."""
    v = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), v.alias("v")))), lambda x: x["v"])


def columns_with_keys(columns: DataFrame, keys: DataFrame, comments: DataFrame) -> DataFrame:
    """columns with is_key and comment; an empty comment is none."""
    on = [*TABLE, "column_name"]
    out = columns.join(keys.select(*on, F.lit(True).alias("is_key")).distinct(), on, "left").join(comments.select(*on, F.nullif("comment", F.lit("")).alias("comment")), on, "left")
    return out.withColumn("is_key", F.coalesce("is_key", F.lit(False)))


def indexes_rollup(rows: DataFrame) -> DataFrame:
    """One row an index, with its columns in key order."""
    return rows.groupBy(*TABLE, "index_name", "is_unique").agg(_list("position", "column_name").alias("columns"))


def constraints_rollup(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """One row a constraint, with its columns in order, none for a check; unknown types are checks."""
    known = F.when(F.col("type").isin("PRIMARY KEY", "UNIQUE", "FOREIGN KEY"), F.col("type")).otherwise("CHECK")
    cols = usage.groupBy("schema_name", "constraint_name").agg(_list("position", "column_name").alias("columns"))
    out = constraints.join(cols, ["schema_name", "constraint_name"], "left")
    return out.select("schema_name", "table_name", "constraint_name", known.alias("type"), F.coalesce("columns", F.expr("cast(array() as array<string>)")).alias("columns"))


def sequence_next(sequences: DataFrame) -> DataFrame:
    """sequences with next_value: the last value and the increment, or the start of a sequence never used."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    return sequences.withColumn("next_value", F.coalesce(big("last_value") + big("increment_by"), big("start_value")).cast("decimal(38,0)"))


def routines(rows: DataFrame) -> DataFrame:
    return rows.withColumn("kind", F.when(F.upper("routine_type") == "PROCEDURE", "PROCEDURE").otherwise("FUNCTION"))


def object_counts(objects: DataFrame) -> DataFrame:
    return objects.groupBy("schema_name", "object_type").agg(F.count("*").alias("n_objects"))


def table_draft(columns: DataFrame, indexes: DataFrame, constraints: DataFrame) -> DataFrame:
    """(schema_name, table_name, columns, indexes, pk_name, pk): one nested row a table. The key is that of the first primary
    key constraint by name, else the columns flagged is_key."""
    cols = columns.groupBy(*TABLE).agg(_list("ordinal", F.struct("column_name", "type", "nullable", "default_value", "comment")).alias("columns"), F.filter(_list("ordinal", F.when(F.col("is_key"), F.col("column_name"))), lambda c: c.isNotNull()).alias("flagged"))
    idx = indexes.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("index_name", "is_unique", "columns"))).alias("indexes"))
    pk = constraints.where("type = 'PRIMARY KEY'").groupBy(*TABLE).agg(F.min_by(F.struct("constraint_name", "columns"), "constraint_name").alias("p"))
    out = cols.join(idx, TABLE, "left").join(pk, TABLE, "left")
    none = F.expr("cast(array() as array<struct<index_name:string,is_unique:boolean,columns:array<string>>>)")
    return out.select(*TABLE, "columns", F.coalesce("indexes", none).alias("indexes"), F.col("p.constraint_name").alias("pk_name"), F.coalesce("p.columns", "flagged").alias("pk"))


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _literal(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def _names(c: Column | str) -> Column:
    return F.array_join(F.transform(c, quote_ident), ", ")


def _clause(c: Column) -> Column:
    return F.concat(quote_ident(c["column_name"]), F.lit(" "), c["type"], F.when(c["nullable"], "").otherwise(" NOT NULL"), F.when(_filled(c["default_value"]), F.concat(F.lit(" DEFAULT "), F.trim(c["default_value"]))).otherwise(""))


def table_ddl(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(schema_name, table_name, ddl) from columns (base, length, precision, scale, ...) and keys (constraint_name, columns)."""
    clause = F.concat(F.lit("    "), quote_ident("column_name"), F.lit(" "), format_pg_type("base", "length", "precision", "scale"), F.when(F.col("nullable"), "").otherwise(" NOT NULL"), F.coalesce(F.concat(F.lit(" DEFAULT "), "default_value"), F.lit("")))
    body = columns.groupBy(*TABLE).agg(_list("ordinal", clause).alias("c")).join(keys, TABLE, "left")
    key = F.when(F.col("constraint_name").isNotNull(), F.array(F.concat(F.lit("    CONSTRAINT "), quote_ident("constraint_name"), F.lit(" PRIMARY KEY ("), _names("columns"), F.lit(")")))).otherwise(F.expr("cast(array() as array<string>)"))
    return body.select(*TABLE, F.concat(F.lit("CREATE TABLE "), qualify("schema_name", "table_name"), F.lit(" (\n"), F.array_join(F.concat("c", key), ",\n"), F.lit("\n);")).alias("ddl"))


def _create_index(table: Column, name: Column, unique: Column, columns: Column, schema: Column | None = None) -> Column:
    return F.concat(F.lit("CREATE "), F.when(unique, "UNIQUE ").otherwise(""), F.lit("INDEX "), quote_ident(name) if schema is None else qualify(schema, name), F.lit(" ON "), table, F.lit(" ("), _names(columns), F.lit(");"))


def create_script(drafts: DataFrame, dialect: str = "postgres") -> DataFrame:
    """(schema_name, table_name, script) of drafts: CREATE TABLE with its key (named by pk_name, where that is filled), the comments of the
    table (column comment, where drafts have it) and its columns, and its indexes; Oracle's are named with their schema."""
    t = qualify("schema_name", "table_name")
    named = F.when(_filled(F.col("pk_name")), F.concat(F.lit("CONSTRAINT "), quote_ident("pk_name"), F.lit(" "))).otherwise("")
    key = F.when(F.size("pk") > 0, F.array(F.concat(named, F.lit("PRIMARY KEY ("), _names("pk"), F.lit(")")))).otherwise(F.expr("cast(array() as array<string>)"))
    lines = F.transform(F.concat(F.transform("columns", _clause), key), lambda c: F.concat(F.lit("    "), c))
    head = F.concat(F.lit("CREATE TABLE "), t, F.lit(" (\n"), F.array_join(lines, ",\n"), F.lit("\n);"))
    about = F.when(_filled(F.col("comment")), F.concat(F.lit("COMMENT ON TABLE "), t, F.lit(" IS "), _literal(F.col("comment")), F.lit(";"))) if "comment" in drafts.columns else F.lit(None).cast("string")
    notes = F.transform(F.filter("columns", lambda c: _filled(c["comment"])), lambda c: F.concat(F.lit("COMMENT ON COLUMN "), t, F.lit("."), quote_ident(c["column_name"]), F.lit(" IS "), _literal(c["comment"]), F.lit(";")))
    idx = F.transform("indexes", lambda i: _create_index(t, i["index_name"], i["is_unique"], i["columns"], F.col("schema_name") if dialect == "oracle" else None))
    return drafts.select(*TABLE, F.array_join(F.concat(F.array(head, about), notes, idx), "\n").alias("script"))


def alter_script(before: DataFrame, after: DataFrame, dialect: str = "postgres") -> DataFrame:
    """(schema_name, table_name, script): what turns the drafts `before` into `after`, '' for no difference. Added and changed
    columns come first, then dropped ones, the key, indexes and comments; types and defaults compare trimmed and in any case.

    Columns and indexes of both sides meet by name in joins, so the work grows with their number, however many a table has; of
    several with one name the first is the old one. A table's statements are put together at the end."""
    ora = dialect == "oracle"
    before, after = kept(before, "before"), kept(after, "after")
    both = kept(after.select(*TABLE, "pk").join(before.select(*TABLE, F.col("pk").alias("opk"), F.col("pk_name").alias("opk_name")).hint("merge"), TABLE), "both")
    t = qualify("schema_name", "table_name")
    alter = F.concat(F.lit("ALTER TABLE "), t, F.lit(" "))
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))

    def changed(c: Column, o: Column) -> Column:
        name = quote_ident(c["column_name"])
        if ora:
            diff = (norm(o["type"]) != norm(c["type"])) | (norm(o["default_value"]) != norm(c["default_value"])) | (o["nullable"] != c["nullable"])
            parts = F.concat(
                F.when(norm(o["type"]) != norm(c["type"]), F.concat(F.lit(" "), c["type"])).otherwise(""),
                F.when(norm(o["default_value"]) == norm(c["default_value"]), "").when(_filled(c["default_value"]), F.concat(F.lit(" DEFAULT "), F.trim(c["default_value"]))).otherwise(" DEFAULT NULL"),
                F.when(o["nullable"] == c["nullable"], "").when(c["nullable"], " NULL").otherwise(" NOT NULL"),
            )
            full = F.concat(quote_ident(c["column_name"]), F.lit(" "), c["type"], F.when(_filled(c["default_value"]), F.concat(F.lit(" DEFAULT "), F.trim(c["default_value"]))).otherwise(""), F.when(c["nullable"], "").otherwise(" NOT NULL"))
            return F.when(o.isNull(), F.array(F.concat(alter, F.lit("ADD ("), full, F.lit(");")))).otherwise(F.array(F.when(diff, F.concat(alter, F.lit("MODIFY ("), name, parts, F.lit(");")))))
        column = F.concat(alter, F.lit("ALTER COLUMN "), name)
        return F.when(o.isNull(), F.array(F.concat(alter, F.lit("ADD COLUMN "), _clause(c), F.lit(";")))).otherwise(F.array(
            F.when(norm(o["type"]) != norm(c["type"]), F.concat(column, F.lit(" TYPE "), c["type"], F.lit(";"))),
            F.when(o["nullable"] != c["nullable"], F.concat(column, F.when(c["nullable"], " DROP NOT NULL;").otherwise(" SET NOT NULL;"))),
            F.when(norm(o["default_value"]) != norm(c["default_value"]), F.concat(column, F.when(_filled(c["default_value"]), F.concat(F.lit(" SET DEFAULT "), F.trim(c["default_value"]), F.lit(";"))).otherwise(" DROP DEFAULT;"))),
        ))

    drop_key = F.lit("DROP PRIMARY KEY;") if ora else F.concat(F.lit("DROP CONSTRAINT "), quote_ident("opk_name"), F.lit(";"))
    key = F.when(F.col("opk") != F.col("pk"), F.array(
        F.when(F.size("opk") > 0, F.concat(alter, drop_key) if ora else F.when(_filled(F.col("opk_name")), F.concat(alter, drop_key)).otherwise("-- drop the old primary key by hand: its name is unknown")),
        F.when(F.size("pk") > 0, F.concat(alter, F.lit("ADD PRIMARY KEY ("), _names("pk"), F.lit(");"))),
    )).otherwise(F.expr("cast(array() as array<string>)"))
    gone = lambda i: F.concat(F.lit("DROP INDEX "), qualify(F.col("schema_name"), i["index_name"]), F.lit(";"))

    def index(i: Column, o: Column) -> Column:
        new = _create_index(t, i["index_name"], i["is_unique"], i["columns"])
        return F.when(o.isNull(), F.array(new)).when((o["is_unique"] != i["is_unique"]) | (o["columns"] != i["columns"]), F.array(gone(i), new)).otherwise(F.array(F.lit(None).cast("string")))

    def note(c: Column, o: Column) -> Column:
        cleared = "''" if ora else "NULL"
        text = F.concat(F.lit("COMMENT ON COLUMN "), t, F.lit("."), quote_ident(c["column_name"]), F.lit(" IS "), F.when(_filled(c["comment"]), _literal(c["comment"])).otherwise(cleared), F.lit(";"))
        return F.when(F.trim(F.coalesce(o["comment"], F.lit(""))) != F.trim(F.coalesce(c["comment"], F.lit(""))), text)

    def steps(phase: int, lines: Column, df: DataFrame) -> DataFrame:
        """The lines of a phase with their places: that of the item they are of, then their own."""
        rows = df.select(*TABLE, "at", F.posexplode(lines).alias("nth", "line")).where("line is not null")
        return rows.select(*TABLE, F.struct(F.lit(phase).alias("phase"), "at", "nth", "line").alias("step"))

    def matched(field: str, name: str) -> tuple[DataFrame, DataFrame]:
        """(items of after, each with the first of before that has its name, old items whose name after lacks)."""
        items = lambda df: df.join(both.select(*TABLE), TABLE, "left_semi").select(*TABLE, F.posexplode(field).alias("at", "item")).withColumn("name", F.col("item")[name])
        on = [*TABLE, "name"]
        new, old = items(after), items(before)
        first = old.where("name is not null").groupBy(*on).agg(F.min_by("item", "at").alias("old"))
        return new.join(first.hint("merge"), on, "left"), old.join(new.select(*on).hint("merge"), on, "left_anti")

    columns, dropped = matched("columns", "column_name")
    indexes, lost = matched("indexes", "index_name")
    item, old = F.col("item"), F.col("old")
    drop = F.concat(alter, F.lit("DROP COLUMN "), quote_ident(item["column_name"]), F.lit(";"))
    parts = [
        steps(1, changed(item, old), columns), steps(2, F.array(drop), dropped), steps(3, key, both.withColumn("at", F.lit(0))),
        steps(4, index(item, old), indexes), steps(5, F.array(gone(item)), lost), steps(6, F.array(note(item, old)), columns),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*parts, both.select(*TABLE)])  # a row without a step for each table
    return rows.groupBy(*TABLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list("step")), lambda s: s["line"]), "\n").alias("script"))


def alter_sequence_script(before: DataFrame, after: DataFrame, dialect: str = "postgres") -> DataFrame:
    """(schema_name, sequence_name, script): the clauses that changed, '' for none."""
    key = ["schema_name", "sequence_name"]
    both = after.join(before.select(*key, *(F.col(c).alias(f"o_{c}") for c in ("increment_by", "min_value", "max_value", "cache_size", "cycle", "next_value"))), key)
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    diff = lambda c: text(c) != text(f"o_{c}")
    clause = lambda c, word: F.when(diff(c), F.concat(F.lit(word + " "), text(c)))
    cycle = F.when(F.col("cycle") != F.col("o_cycle"), F.when(F.col("cycle"), "CYCLE").otherwise("NOCYCLE" if dialect == "oracle" else "NO CYCLE"))
    if dialect == "oracle":
        cache = F.when(diff("cache_size"), F.when(F.col("cache_size") <= 1, "NOCACHE").otherwise(F.concat(F.lit("CACHE "), text("cache_size"))))
    else:
        cache = F.when(diff("cache_size"), F.concat(F.lit("CACHE "), F.greatest(F.lit(1), F.col("cache_size")).cast("string")))
    name = qualify("schema_name", "sequence_name")
    clauses = [clause("increment_by", "INCREMENT BY"), clause("min_value", "MINVALUE"), clause("max_value", "MAXVALUE"), cache, cycle]
    if dialect == "oracle":
        body = F.concat_ws(" ", *clauses)
        first = F.when(body != "", F.concat(F.lit("ALTER SEQUENCE "), name, F.lit(" "), body, F.lit(";")))
        return both.select(*key, F.concat_ws("\n", first, F.when(diff("next_value"), F.concat(F.lit("ALTER SEQUENCE "), name, F.lit(" RESTART START WITH "), text("next_value"), F.lit(";")))).alias("script"))
    body = F.concat_ws(" ", *clauses, clause("next_value", "RESTART WITH"))
    return both.select(*key, F.when(body == "", "").otherwise(F.concat(F.lit("ALTER SEQUENCE "), name, F.lit(" "), body, F.lit(";"))).alias("script"))


# ---------- snapshots ----------

def snapshot_columns(raw: DataFrame) -> DataFrame:
    """Canonical types and default texts of raw columns: identity and generated columns tell how they get their values."""
    default = F.when(F.col("identity").isNotNull(), F.concat(F.lit("GENERATED "), "identity", F.lit(" AS IDENTITY"))).when(F.col("generated").isNotNull(), F.concat(F.lit("GENERATED ALWAYS AS ("), "generated", F.lit(") STORED"))).otherwise(F.col("default_value"))
    base = F.regexp_replace(F.lower(F.trim("type")), r"(?:\[\])+$", "")
    dims = F.floor((F.length(F.trim("type")) - F.length(base)) / 2).cast("int")
    size = F.regexp_extract(base, r"\((\d+)", 1).try_cast("int")
    scale = F.regexp_extract(base, r",\s*(\d+)\)", 1).try_cast("int")
    bare = F.trim(F.regexp_replace(base, r"\([^)]*\)", ""))
    is_text = bare.contains("char")
    return raw.select("snapshot_id", "object_key", "column_name", "ordinal", "nullable", F.regexp_replace(bare, r"\s+with(out)? time zone$", "").alias("base_type"), F.when(is_text, size).alias("length"), F.when(~is_text, size).alias("precision"), scale.alias("scale"), bare.endswith("with time zone").alias("with_tz"), dims.alias("dims"), default.alias("default_value"), "comment")


def snapshot_constraints(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(constraints, dependencies): column pairs of arrays as ordered lists, and the referenced tables, a table itself apart."""
    pairs = raw.select("snapshot_id", "object_key", "constraint_name", "kind", "ref_table", "on_update", "on_delete", F.posexplode_outer(F.arrays_zip("columns", "ref_columns")).alias("at", "pair"))
    lists = F.filter(_list("at", F.struct(F.col("pair.columns").alias("c"), F.col("pair.ref_columns").alias("r"))), lambda p: p["c"].isNotNull())
    out = pairs.groupBy("snapshot_id", "object_key", "constraint_name", "kind", "ref_table", "on_update", "on_delete").agg(lists.alias("l"))
    constraints = out.select("snapshot_id", "object_key", "constraint_name", "kind", F.transform("l", lambda p: p["c"]).alias("columns"), "ref_table", F.filter(F.transform("l", lambda p: p["r"]), lambda r: r.isNotNull()).alias("ref_columns"), "on_update", "on_delete")
    deps = raw.where("ref_table is not null and ref_table <> object_key").select("snapshot_id", "object_key", F.col("ref_table").alias("depends_on")).distinct()
    return constraints, deps


def snapshot_indexes(raw: DataFrame, constraints: DataFrame) -> DataFrame:
    """One row an index, with its expressions in order and its predicate, constraint-backed ones apart."""
    own = raw.join(constraints.select("snapshot_id", F.col("constraint_name").alias("index_name")).distinct(), ["snapshot_id", "index_name"], "left_anti")
    text = F.concat("expression", F.when(F.col("descending"), " DESC").otherwise(""))
    return own.groupBy("snapshot_id", "object_key", "index_name", "is_unique", "predicate").agg(_list("position", text).alias("expressions"))

# ---------- Oracle's catalog ----------

def oracle_columns(raw: DataFrame, comments: DataFrame, identities: DataFrame) -> DataFrame:
    """Snapshot columns, as snapshot_columns gives them, with extensions (a map of what only Oracle has), of all_tab_cols rows, comments
    (comments) and identity columns (generation_type, identity_options), joined by snapshot_id, owner, table and column.

    Hidden columns count only if a user made them; they are invisible then. Types of an owner have its name before theirs."""
    at = ["snapshot_id", "owner", "table_name", "column_name"]
    seen = raw.where("hidden_column = 'NO' or user_generated = 'YES'")
    rows = seen.join(comments.select(*at, "comments"), at, "left").join(identities.select(*at, "generation_type", "identity_options"), at, "left")
    yes = lambda c: F.coalesce(F.col(c) == "YES", F.lit(False))
    kind, owned = F.upper("data_type"), F.col("data_type_owner").isNotNull()
    base = F.when(owned, F.concat_ws(".", "data_type_owner", "data_type")).when(kind.startswith("TIMESTAMP"), "TIMESTAMP").when(kind.startswith("INTERVAL DAY"), "INTERVAL DAY TO SECOND").when(kind.startswith("INTERVAL YEAR"), "INTERVAL YEAR TO MONTH").otherwise(F.col("data_type"))
    length = F.when(owned | kind.startswith("TIMESTAMP") | kind.startswith("INTERVAL DAY") | kind.startswith("INTERVAL YEAR"), None).when(kind.contains("CHAR"), F.col("char_length")).when(kind.isin("RAW", "UROWID"), F.col("data_length"))
    zone = F.when(~owned & kind.startswith("TIMESTAMP"), F.when(kind.contains("LOCAL TIME ZONE"), "WITH LOCAL TIME ZONE").when(kind.contains("WITH TIME ZONE"), "WITH TIME ZONE"))
    given = F.nullif(F.trim("data_default"), F.lit(""))
    how = F.coalesce(F.trim("generation_type"), F.lit("UNKNOWN"))
    default = F.when(yes("identity_column"), F.concat(F.lit("GENERATED "), how, F.lit(" AS IDENTITY"))).when(yes("virtual_column"), F.concat(F.lit("GENERATED ALWAYS AS ("), F.coalesce(given, F.lit("")), F.lit(") VIRTUAL"))).when(yes("default_on_null"), F.concat(F.lit("DEFAULT ON NULL "), given)).otherwise(given)
    flag = lambda c: F.when(c, "true")
    options = F.nullif(F.regexp_replace(F.trim("identity_options"), r"\s+", " "), F.lit(""))
    more = {"timeZone": zone, "typeOwner": F.col("data_type_owner"), "lengthSemantics": F.when(F.col("char_used").isNotNull(), F.when(F.col("char_used") == "C", "CHAR").otherwise("BYTE")), "typeModifier": F.col("data_type_mod"), "identity": F.when(yes("identity_column"), F.coalesce("generation_type", F.lit("UNKNOWN"))), "identityOptions": F.when(yes("identity_column"), options), "defaultOnNull": flag(yes("default_on_null")), "virtual": flag(yes("virtual_column")), "invisible": flag(yes("hidden_column"))}
    extensions = F.map_filter(F.create_map(*(x for n, v in more.items() for x in (F.lit(f"oracle.{n}"), v.cast("string")))), lambda _, v: v.isNotNull())
    with_tz = ~owned & kind.startswith("TIMESTAMP") & kind.contains("TIME ZONE")
    return rows.select("snapshot_id", F.col("table_name").alias("object_key"), "column_name", F.col("column_id").alias("ordinal"), (F.col("nullable") == "Y").alias("nullable"), base.alias("base_type"), length.alias("length"), F.col("data_precision").alias("precision"), F.col("data_scale").alias("scale"), with_tz.alias("with_tz"), F.lit(0).alias("dims"), default.alias("default_value"), F.col("comments").alias("comment"), extensions.alias("extensions"))


# Oracle's letters of constraints.
ORACLE_KINDS = {"P": "PRIMARY_KEY", "U": "UNIQUE", "R": "FOREIGN_KEY", "C": "CHECK"}


def oracle_constraints(rows: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(constraints, dependencies), as snapshot_constraints gives them, of all_constraints and all_cons_columns rows, with ref_owner, expression
    and generated. Letters other than P, U, R and C are left out; there is no action on update. A foreign key names the constraint it
    points to: its columns are matched by position. A referenced table of another owner is no dependency, nor is the own one."""
    name = ["snapshot_id", "owner", "constraint_name"]
    letter = F.col("constraint_type")
    kind = F.coalesce(*(F.when(letter == k, v) for k, v in ORACLE_KINDS.items()))
    known = rows.where(letter.isin(*ORACLE_KINDS)).withColumn("kind", kind)
    to = rows.select("snapshot_id", F.col("owner").alias("r_owner"), F.col("constraint_name").alias("r_constraint_name"), F.col("owner").alias("ref_owner"), F.col("table_name").alias("ref_table"))
    found = known.join(to, ["snapshot_id", "r_owner", "r_constraint_name"], "left")
    cells = columns.select(*name, "table_name", "position", "column_name").where("position is not null")
    at = [*name, "table_name"]
    other = cells.select("snapshot_id", F.col("owner").alias("ref_owner"), F.col("constraint_name").alias("r_constraint_name"), F.col("table_name").alias("ref_table"), "position", F.col("column_name").alias("ref_column"))
    pairs = found.select(*at, "ref_owner", "r_constraint_name", "ref_table").join(cells, at).join(other, ["snapshot_id", "ref_owner", "r_constraint_name", "ref_table", "position"], "left")
    lists = pairs.groupBy(*at).agg(_list("position", F.struct(F.col("column_name").alias("c"), F.col("ref_column").alias("r"))).alias("l"))
    none = F.expr("cast(array() as array<string>)")
    names = lambda side: F.coalesce(F.filter(F.transform("l", lambda p: p[side]), lambda c: c.isNotNull()), none)
    out = found.join(lists, at, "left").select("snapshot_id", F.col("table_name").alias("object_key"), "constraint_name", "kind", names("c").alias("columns"), "ref_owner", "ref_table", names("r").alias("ref_columns"), F.lit(None).cast("string").alias("on_update"), F.col("delete_rule").alias("on_delete"), F.nullif(F.trim("search_condition"), F.lit("")).alias("expression"), F.coalesce(F.col("generated") == "GENERATED NAME", F.lit(False)).alias("generated"))
    deps = found.where("ref_owner = owner and ref_table <> table_name").select("snapshot_id", F.col("table_name").alias("object_key"), F.col("ref_table").alias("depends_on")).distinct()
    return out, deps


def oracle_indexes(rows: DataFrame, columns: DataFrame, expressions: DataFrame, backing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(indexes, rejects) of all_indexes, all_ind_columns and all_ind_expressions rows: an expression stands for its column, DESC behind what
    descends. Indexes that back a constraint (snapshot_id, owner, index_name, table_owner, table_name) are kept and flagged as generated.
    rejects are those that no snapshot holds: of another type than normal ones, or with a column that has no name, place or direction."""
    key = ["snapshot_id", "owner", "index_name"]
    text = F.coalesce(F.nullif(F.trim("expression"), F.lit("")), F.col("column_name"))
    cells = columns.select(*key, "position", "column_name", "descend").join(expressions.select(*key, "position", "expression"), [*key, "position"], "left")
    broken = text.isNull() | F.col("position").isNull() | ~F.coalesce(F.col("descend").isin("ASC", "DESC"), F.lit(False))
    lists = cells.groupBy(*key).agg(_list("position", F.concat(text, F.when(F.col("descend") == "DESC", " DESC").otherwise(""))).alias("expressions"), F.max(broken).alias("broken"))
    made = backing.select(*key, "table_owner", "table_name", F.lit(True).alias("generated")).distinct()
    told = rows.join(lists, key).join(made, [*key, "table_owner", "table_name"], "left")
    fit = F.col("index_type").isin("NORMAL", "FUNCTION-BASED NORMAL") & ~F.col("broken")
    head = ["snapshot_id", F.col("table_name").alias("object_key"), "index_name"]
    good = told.where(fit).select(*head, (F.col("uniqueness") == "UNIQUE").alias("is_unique"), "expressions", F.lit(None).cast("string").alias("predicate"), F.coalesce("generated", F.lit(False)).alias("generated"))
    return good, told.where(~F.coalesce(fit, F.lit(False))).select(*head, "index_type")


def snapshot_types(labels: DataFrame) -> DataFrame:
    """(snapshot_id, type_name, definition): labels or attributes in order."""
    text = F.when(F.col("kind") == "enum", F.concat(F.lit("'"), F.replace("label", F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(F.concat("label", F.lit(" "), "type"))
    out = labels.groupBy("snapshot_id", "type_name", "kind").agg(F.array_join(_list("position", text), ", ").alias("body"))
    return out.select("snapshot_id", "type_name", F.concat(F.upper("kind"), F.lit(" ("), "body", F.lit(")")).alias("definition"))


def routine_signatures(arguments: DataFrame) -> DataFrame:
    """(snapshot_id, routine_name, signature): the types of the arguments that go in, in order; position 0 is the result."""
    rows = arguments.where("position > 0 and mode <> 'OUT'")
    text = F.concat(F.when(F.col("mode") == "IN", "").otherwise(F.concat("mode", F.lit(" "))), "type")
    found = rows.groupBy("snapshot_id", "routine_name").agg(F.array_join(_list("position", text), ",").alias("s"))
    return arguments.select("snapshot_id", "routine_name").distinct().join(found, ["snapshot_id", "routine_name"], "left").select("snapshot_id", "routine_name", F.concat(F.lit("("), F.coalesce("s", F.lit("")), F.lit(")")).alias("signature"))


def snapshot_dependencies(edges: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): distinct edges between known objects, self edges apart; unresolved has the types of objects with an
    edge to an object of the same schema that isn't known."""
    rows = edges.where("object_key <> depends_on").dropDuplicates(["snapshot_id", "object_key", "depends_on"])
    known = objects.select("snapshot_id", F.col("object_key").alias("depends_on"))
    good = rows.join(known, ["snapshot_id", "depends_on"], "left_semi").join(objects.select("snapshot_id", "object_key"), ["snapshot_id", "object_key"], "left_semi")
    bad = rows.where("in_schema").join(known, ["snapshot_id", "depends_on"], "left_anti").join(objects.select("snapshot_id", "object_key", "object_type"), ["snapshot_id", "object_key"])
    return good.select("snapshot_id", "object_key", "depends_on"), bad.select("snapshot_id", "object_type").distinct()


# Codes of what is missing, the worst first.
CODES = ["PERMISSION_DENIED", "METADATA_UNAVAILABLE", "DEFINITION_UNAVAILABLE", "DEPENDENCY_UNRESOLVED", "NOT_SUPPORTED"]


def snapshot_completeness(scopes: DataFrame) -> DataFrame:
    """(snapshot_id, object_type, code): the worst code of each type; any other code is an error."""
    rank = F.array_position(F.array(*map(F.lit, CODES)), F.col("code"))
    checked = F.when(rank > 0, F.col("code")).otherwise(F.raise_error(F.concat(F.lit("unknown code "), "code")))
    return scopes.where("code is not null").groupBy("snapshot_id", "object_type").agg(F.min_by(checked, rank).alias("code"))


def canonical(*fields: Column | str) -> Column:
    """Fields with their sizes in bytes before them, so that no two lists of fields give one text; null differs from ''."""
    out = []
    for f in fields:
        c = (F.col(f) if isinstance(f, str) else f).cast("string")
        out.append(F.when(c.isNull(), "-;").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c, F.lit(";"))))
    return F.concat(*out)


def fingerprint(objects: DataFrame) -> DataFrame:
    """(snapshot_id, fingerprint): SHA-256 over all objects (type_rank, object_key, body), whatever order they come in."""
    text = F.transform(F.array_sort(F.collect_list(F.struct("type_rank", "object_key", "body"))), lambda o: canonical(o["type_rank"], o["object_key"], o["body"]))
    return objects.groupBy("snapshot_id").agg(F.sha2(F.concat(F.lit("snapshot-v1;"), F.array_join(text, "")), 256).alias("fingerprint"))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")
