"""Statements of change plans from the structure of both sides: tables with their constraints and indexes, sequences, texts.

Structures are rows with comparison_id and side (source: what is wanted, target: what is there), so that plans of any size are joined,
not walked. What belongs to one table (its columns, constraints or indexes) is put together in one row, as its statement asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import qualify, quote_ident
from ..shared import kept

# What a foreign key may do, kinds whose objects can be dropped, and those whose text can be replaced in place.
ACTIONS = ["NO ACTION", "RESTRICT", "CASCADE", "SET NULL", "SET DEFAULT"]
DROPPED = ["TABLE", "SEQUENCE", "VIEW", "MATERIALIZED_VIEW", "FUNCTION", "PROCEDURE", "TYPE", "TRIGGER"]
REPLACED = ["VIEW", "FUNCTION", "PROCEDURE"]
# Paths of sequence properties and their words.
SEQUENCE_WORDS = {"startValue": "START WITH", "incrementBy": "INCREMENT BY", "minimumValue": "MINVALUE", "maximumValue": "MAXVALUE"}
SEQUENCE_FIELDS = {"startValue": "start_value", "incrementBy": "increment_by", "minimumValue": "min_value", "maximumValue": "max_value", "cycle": "cycle", "cacheSize": "cache_size"}

_KEY = ["comparison_id", "object_key"]


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _literal(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def _list(c: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(c, quote_ident), ", "), F.lit(")"))


def _rows(df: DataFrame, phase: Column | int, rank: Column, sql: Column, bad: Column | bool = False, destroys: Column | bool = False) -> DataFrame:
    """Statements in their order within a change: by phase, then rank; whether they can't be written, and whether something is lost by them."""
    p, b, lost = (x if isinstance(x, Column) else F.lit(x) for x in (phase, bad, destroys))
    return df.select("comparison_id", "id", p.alias("phase"), rank.cast("string").alias("rank"), sql.alias("sql"), F.coalesce(b, F.lit(False)).alias("bad"), F.coalesce(lost, F.lit(False)).alias("destroys"))


def column_clause(oracle: bool = False) -> Column:
    """A column's clause: its name, type, default or how it is generated, and whether it may be null."""
    default = F.trim("default_value")
    given = F.when(~_filled(F.col("default_value")), "").when(default.startswith("GENERATED ") | default.startswith("DEFAULT ON NULL "), F.concat(F.lit(" "), default)).otherwise(F.concat(F.lit(" DEFAULT "), default))
    # A virtual column's clause has no place for NULL in Oracle.
    null = F.when(default.endswith(" VIRTUAL"), "").otherwise(F.when(F.col("nullable"), " NULL").otherwise(" NOT NULL")) if oracle else F.when(F.col("nullable"), " NULL").otherwise(" NOT NULL")
    return F.concat(quote_ident("column_name"), F.lit(" "), "type", given, F.coalesce(null, F.lit(" NOT NULL")))


def constraint_clause(oracle: bool = False) -> tuple[Column, Column]:
    """(clause, bad): a constraint's clause from kind, columns, expression, ref_table, ref_columns, on_update and on_delete; bad tells
    one that lacks what its kind needs, or a foreign key with an unknown action. Oracle has no action on update."""
    name = F.when(F.coalesce("generated", F.lit(False)), "").otherwise(F.concat(F.lit("CONSTRAINT "), quote_ident("constraint_name"), F.lit(" ")))
    check = F.trim("expression")
    action = lambda word, c: F.when(_filled(F.col(c)), F.concat(F.lit(f" ON {word} "), F.trim(c))).otherwise("")
    known = lambda c: ~_filled(F.col(c)) | F.trim(c).isin(ACTIONS)
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    kind = F.col("kind")
    body = F.when(kind == "PRIMARY_KEY", F.concat(F.lit("PRIMARY KEY "), _list(F.col("columns")))).when(kind == "UNIQUE", F.concat(F.lit("UNIQUE "), _list(F.col("columns"))))
    body = body.when(kind == "CHECK", F.when(check.startswith("CHECK"), check).otherwise(F.concat(F.lit("CHECK ("), check, F.lit(")"))))
    body = body.when(kind == "FOREIGN_KEY", F.concat(F.lit("FOREIGN KEY "), _list(F.col("columns")), F.lit(" REFERENCES "), qualify("schema_name", "ref_table"), F.lit(" "), _list(F.col("ref_columns")), F.lit("") if oracle else action("UPDATE", "on_update"), action("DELETE", "on_delete")))
    sound = F.when(kind.isin("PRIMARY_KEY", "UNIQUE"), some("columns")).when(kind == "CHECK", _filled(F.col("expression"))).when(kind == "FOREIGN_KEY", some("columns") & some("ref_columns") & F.col("ref_table").isNotNull() & known("on_update") & known("on_delete"))
    return F.concat(name, body), ~F.coalesce(sound, F.lit(False))


def index_statement() -> tuple[Column, Column]:
    """(statement, bad) of an index from is_unique, expressions (SQL texts in order) and predicate."""
    where = F.when(_filled(F.col("predicate")), F.concat(F.lit(" WHERE "), F.trim("predicate"))).otherwise("")
    sql = F.concat(F.lit("CREATE "), F.when(F.col("is_unique"), "UNIQUE ").otherwise(""), F.lit("INDEX "), qualify("schema_name", "index_name"), F.lit(" ON "), qualify("schema_name", "object_key"), F.lit(" ("), F.array_join("expressions", ", "), F.lit(")"), where, F.lit(";"))
    empty = F.exists("expressions", lambda e: ~F.coalesce(F.trim(e) != "", F.lit(False)))
    return sql, (F.coalesce(F.size("expressions"), F.lit(0)) < 1) | empty


def _difference(changes: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Of the changes' rows, those that the other side hasn't likewise, with `twice`: whether a name occurs twice on a side."""
    own = changes.join(rows, _KEY)
    fields = [c for c in rows.columns if c not in (*_KEY, "side")]
    told = own.withColumn("__text", F.to_json(F.struct(*fields)))
    other = told.select("comparison_id", "id", F.when(F.col("side") == "source", "target").otherwise("source").alias("side"), "__text").distinct()
    left = told.join(other, ["comparison_id", "id", "side", "__text"], "left_anti").drop("__text")
    again = own.groupBy("comparison_id", "id", "side", name).agg(F.count("*").alias("n")).where("n > 1").select("comparison_id", "id", F.lit(True).alias("twice")).distinct()
    return left.join(again, ["comparison_id", "id"], "left")


def _tables(changes: DataFrame, columns: DataFrame, constraints: DataFrame, indexes: DataFrame, oracle: bool) -> list[DataFrame]:
    """What CREATE of a table gives: itself with its keys and checks, comments, then foreign keys and indexes."""
    new = changes.where("kind = 'CREATE' and object_type = 'TABLE'").select("comparison_id", "id", "schema_name", "object_key")
    wanted = lambda df: new.join(df.where("side = 'source'").drop("side"), _KEY)
    t = qualify("schema_name", "object_key")
    clause, bad = constraint_clause(oracle)
    cols, cons, idx = wanted(columns), wanted(constraints), wanted(indexes)
    inner = cols.select("comparison_id", "id", F.lit(0).alias("p"), F.col("ordinal").cast("long").alias("o"), F.col("column_name").alias("n"), column_clause(oracle).alias("c"), F.lit(False).alias("bad"))
    inner = inner.unionByName(cons.where("kind <> 'FOREIGN_KEY'").select("comparison_id", "id", F.lit(1).alias("p"), F.lit(0).cast("long").alias("o"), F.col("constraint_name").alias("n"), clause.alias("c"), bad.alias("bad")))
    body = inner.groupBy("comparison_id", "id").agg(F.array_sort(F.collect_list(F.struct("p", "o", "n", "c"))).alias("l"), F.max("bad").alias("broken"), F.min("p").alias("first"))
    whole = new.join(body, ["comparison_id", "id"])
    head = F.concat(F.lit("CREATE TABLE "), t, F.lit(" (\n    "), F.array_join(F.transform("l", lambda x: x["c"]), ",\n    "), F.lit("\n);"))
    note = F.concat(F.lit("COMMENT ON COLUMN "), t, F.lit("."), quote_ident("column_name"), F.lit(" IS "), _literal(F.col("comment")), F.lit(";"))
    create, unfit = index_statement()
    return [
        _rows(whole, 0, F.lit(""), head, F.col("broken") | (F.col("first") > 0)),
        _rows(cols.where("comment is not null"), 1, F.lpad(F.col("ordinal").cast("string"), 9, "0"), note),
        _rows(cons.where("kind = 'FOREIGN_KEY'"), 2, F.col("constraint_name"), F.concat(F.lit("ALTER TABLE "), t, F.lit(" ADD "), clause, F.lit(";")), bad),
        _rows(idx.where("not coalesce(generated, false)"), 3, F.col("index_name"), create, unfit),
    ]


def _columns(changes: DataFrame, columns: DataFrame, oracle: bool) -> list[DataFrame]:
    """Columns added, dropped or changed in one property; a side's column is looked up by the path's name."""
    named = changes.where("kind = 'ALTER' and object_type = 'TABLE'").withColumns({"column_name": F.regexp_extract("path", r"^columns\[(.+)\](?:\.\w+)?$", 1), "part": F.regexp_extract("path", r"^columns\[.+\]\.(\w+)$", 1)}).where("column_name <> ''")
    fields = ["type", "nullable", "default_value", "comment"]
    at = [*_KEY, "column_name"]
    other = columns.where("side = 'target'").select(*at, *(F.col(f).alias(f"t_{f}") for f in fields), F.lit(True).alias("in_target"))
    both = named.join(columns.where("side = 'source'").select(*at, *fields, F.lit(True).alias("in_source")), at, "left").join(other, at, "left")
    t, name, part = qualify("schema_name", "object_key"), quote_ident("column_name"), F.col("part")
    alter = F.concat(F.lit("ALTER TABLE "), t, F.lit(" "))
    added, dropped = F.col("in_source") & F.col("in_target").isNull(), F.col("in_target") & F.col("in_source").isNull()
    kept = F.col("in_source") & F.col("in_target")
    generated = F.coalesce(F.trim("default_value").startswith("GENERATED ") | F.trim("t_default_value").startswith("GENERATED "), F.trim("default_value").startswith("GENERATED "), F.trim("t_default_value").startswith("GENERATED "), F.lit(False))
    differs = lambda f: ~F.col(f).eqNullSafe(F.col(f"t_{f}"))
    clause = column_clause(oracle)
    if oracle:
        modify = lambda *what: F.concat(alter, F.lit("MODIFY ("), name, *what, F.lit(");"))
        forms = {"add": F.concat(alter, F.lit("ADD ("), clause, F.lit(");")), "type": modify(F.lit(" "), F.col("type")), "null": modify(F.when(F.col("nullable"), " NULL").otherwise(" NOT NULL")), "default": modify(F.lit(" DEFAULT "), F.when(_filled(F.col("default_value")), F.trim("default_value")).otherwise("NULL"))}
    else:
        col = F.concat(alter, F.lit("ALTER COLUMN "), name)
        forms = {"add": F.concat(alter, F.lit("ADD COLUMN "), clause, F.lit(";")), "type": F.concat(col, F.lit(" TYPE "), "type", F.lit(";")), "null": F.concat(col, F.when(F.col("nullable"), " DROP NOT NULL;").otherwise(" SET NOT NULL;")), "default": F.concat(col, F.when(_filled(F.col("default_value")), F.concat(F.lit(" SET DEFAULT "), F.trim("default_value"), F.lit(";"))).otherwise(" DROP DEFAULT;"))}
    cleared = F.lit("''" if oracle else "NULL")
    comment = F.concat(F.lit("COMMENT ON COLUMN "), t, F.lit("."), name, F.lit(" IS "), F.coalesce(_literal(F.col("comment")), cleared), F.lit(";"))
    sql = F.when((part == "") & added, forms["add"]).when((part == "") & dropped, F.concat(alter, F.lit("DROP COLUMN "), name, F.lit(";")))
    sql = sql.when((part == "dataType") & kept, forms["type"]).when((part == "nullable") & kept & differs("nullable"), forms["null"])
    sql = sql.when((part == "normalizedDefault") & kept & differs("default_value") & ~generated, forms["default"]).when((part == "comment") & kept & differs("comment"), comment)
    lost = dropped | part.isin("dataType", "normalizedDefault") | ((part == "nullable") & ~F.col("nullable"))
    return [_rows(both, 0, F.lit(""), sql, sql.isNull(), lost), _rows(both.where((part == "") & added & F.col("comment").isNotNull()), 1, F.lit(""), comment)]


def _lists(changes: DataFrame, constraints: DataFrame, indexes: DataFrame, oracle: bool) -> list[DataFrame]:
    """Constraints and indexes that differ: what only the target has goes, then what only the source has comes."""
    t = qualify("schema_name", "object_key")
    altered = lambda path: changes.where(F.expr("kind = 'ALTER' and object_type = 'TABLE'") & (F.col("path") == path)).select("comparison_id", "id", "schema_name", "object_key")
    clause, bad = constraint_clause(oracle)
    gone, twice = F.col("side") == "target", F.coalesce("twice", F.lit(False))
    cons = _difference(altered("constraints"), constraints, "constraint_name")
    alter = F.concat(F.lit("ALTER TABLE "), t)
    sql = F.when(gone, F.concat(alter, F.lit(" DROP CONSTRAINT "), quote_ident("constraint_name"), F.lit(";"))).otherwise(F.concat(alter, F.lit(" ADD "), clause, F.lit(";")))
    # Foreign keys come after the keys that they may point to.
    phase = F.when(gone, 0).when(F.col("kind") == "FOREIGN_KEY", 2).otherwise(1)
    out = [_rows(cons, phase, F.col("constraint_name"), sql, twice | (~gone & bad), gone)]
    create, unfit = index_statement()
    idx = _difference(altered("indexes"), indexes, "index_name").where("not coalesce(generated, false)")
    return [*out, _rows(idx, F.when(gone, 0).otherwise(1), F.col("index_name"), F.when(gone, F.concat(F.lit("DROP INDEX "), qualify("schema_name", "index_name"), F.lit(";"))).otherwise(create), twice | (~gone & unfit), gone)]


def _sequences(changes: DataFrame, sequences: DataFrame, oracle: bool) -> list[DataFrame]:
    own = changes.where("object_type = 'SEQUENCE' and kind in ('CREATE', 'ALTER')")
    fields = list(SEQUENCE_FIELDS.values())
    other = sequences.where("side = 'target'").select(*_KEY, *(F.col(f).alias(f"t_{f}") for f in fields), F.lit(True).alias("in_target"))
    both = own.join(sequences.where("side = 'source'").select(*_KEY, *fields, F.lit(True).alias("in_source")), _KEY, "left").join(other, _KEY, "left")
    number = lambda f: F.trim(F.col(f).cast("string"))
    whole = lambda f, none: F.when(F.col(f).isNull(), F.lit(none)).otherwise(number(f).rlike("^[+-]?[0-9]+$"))
    no = F.lit("NO" if oracle else "NO ")
    cycle = F.when(F.col("cycle"), "CYCLE").otherwise(F.concat(no, F.lit("CYCLE")))
    cache = F.when(F.col("cache_size") <= 1, "NOCACHE").otherwise(F.concat(F.lit("CACHE "), number("cache_size"))) if oracle else F.concat(F.lit("CACHE "), number("cache_size"))
    word = lambda p: F.concat(F.lit(SEQUENCE_WORDS[p] + " "), number(SEQUENCE_FIELDS[p]))
    name = qualify("schema_name", "object_key")
    given = [F.when(F.col(SEQUENCE_FIELDS[p]).isNotNull(), word(p)) for p in SEQUENCE_WORDS]
    create = F.concat(F.lit("CREATE SEQUENCE "), F.concat_ws(" ", name, *given, cycle, F.when(F.col("cache_size").isNotNull(), cache)), F.lit(";"))
    sound = whole("start_value", False) & whole("increment_by", False) & whole("min_value", True) & whole("max_value", True) & (F.col("cache_size").isNull() | (F.col("cache_size") > 0))
    path = F.col("path")
    option = F.when(path == "cycle", cycle).when(path == "cacheSize", F.when(F.col("cache_size") > 0, cache))
    for p, f in SEQUENCE_FIELDS.items():
        if p in SEQUENCE_WORDS:
            unset = F.concat(no, F.lit(SEQUENCE_WORDS[p])) if p in ("minimumValue", "maximumValue") else F.lit(None).cast("string")
            option = option.when(path == p, F.when(F.col(f).isNull(), unset).when(whole(f, False), word(p)))
    same = reduce(lambda a, b: a | b, ((path == p) & F.col(f).eqNullSafe(F.col(f"t_{f}")) for p, f in SEQUENCE_FIELDS.items()))
    alter = F.when(F.col("in_source") & F.col("in_target") & ~same, F.concat(F.lit("ALTER SEQUENCE "), name, F.lit(" "), option, F.lit(";")))
    sql = F.when(F.col("kind") == "CREATE", F.when(sound & F.col("in_source"), create)).otherwise(alter)
    return [_rows(both, 0, F.lit(""), sql, sql.isNull(), F.col("kind") == "ALTER")]


def _whole(changes: DataFrame) -> list[DataFrame]:
    """DROP of any object (routines by signature, triggers on their table), and objects that are created or replaced by their text."""
    name, kind = qualify("schema_name", "object_key"), F.replace(F.col("object_type"), F.lit("_"), F.lit(" "))
    tail = F.when(F.col("object_type").isin("FUNCTION", "PROCEDURE"), F.concat(F.lit("("), F.coalesce("signature", F.lit("")), F.lit(")"))).otherwise("")
    drop = F.when(F.col("object_type") == "TRIGGER", F.concat(F.lit("DROP TRIGGER "), quote_ident("object_key"), F.lit(" ON "), qualify("schema_name", "parent"), F.lit(";"))).when(F.col("object_type").isin(DROPPED), F.concat(F.lit("DROP "), kind, F.lit(" "), name, tail, F.lit(";")))
    gone = changes.where("kind = 'DROP'")
    texts = changes.where("kind in ('CREATE', 'REPLACE') and object_type not in ('TABLE', 'SEQUENCE')")
    replaced = F.when(F.col("object_type").isin(REPLACED), F.regexp_replace("text", r"(?i)^\s*CREATE\s+(?!OR\s)", "CREATE OR REPLACE "))
    sql = F.when(_filled(F.col("text")), F.concat(F.rtrim(F.when(F.col("kind") == "CREATE", F.col("text")).otherwise(replaced)), F.lit(";")))
    return [_rows(gone, 0, F.lit(""), drop, drop.isNull()), _rows(texts, 0, F.lit(""), sql, sql.isNull())]


def render_statements(changes: DataFrame, columns: DataFrame, constraints: DataFrame, indexes: DataFrame, sequences: DataFrame, dialect: str = "postgres") -> DataFrame:
    """(comparison_id, id, step, sql, destructive, error): a row for each statement of each change, numbered from 1 in the order in
    which they run; a change without statements has one row, with step and sql null and error MANUAL or UNSUPPORTED_SHAPE.

    changes (comparison_id, id, kind, object_type, schema_name, object_key, path, automation, text, signature, parent) is the plan, where
    schema_name is that of the target. Structures have comparison_id, side and object_key, and columns: column_name, ordinal, type,
    nullable, default_value, comment; constraints: constraint_name, kind, columns, expression, ref_table, ref_columns, on_update,
    on_delete, generated; indexes: index_name, is_unique, expressions, predicate, generated; sequences: start_value, increment_by, min_value,
    max_value, cycle, cache_size. A created table comes first, its comments, foreign keys and indexes behind it; altered lists drop before
    they add. If one statement of a change can't be written, none is. Ties of ids and repeated changes give repeated rows' statements once."""
    oracle = dialect == "oracle"
    plan = changes.select("comparison_id", "id", "kind", "object_type", "schema_name", "object_key", "path", "automation", "text", "signature", "parent").dropDuplicates(["comparison_id", "id"])
    # Each kind of statement reads the plan, so it is written once.
    plan = kept(plan, "plan")
    manual = (F.col("kind") == "MANUAL") | F.coalesce(F.col("automation") == "MANUAL_ONLY", F.lit(False))
    open_ = plan.where(~manual)
    lists = _lists(open_, constraints, indexes, oracle)
    made = reduce(DataFrame.unionByName, [*_tables(open_, columns, constraints, indexes, oracle), *_columns(open_, columns, oracle), *lists, *_sequences(open_, sequences, oracle), *_whole(open_)])
    told = made.groupBy("comparison_id", "id").agg(F.array_sort(F.collect_list(F.struct("phase", "rank", "sql"))).alias("l"), F.max("bad").alias("bad"), F.max("destroys").alias("destroys"))
    out = plan.join(told, ["comparison_id", "id"], "left")
    error = F.when(manual, "MANUAL").when(F.col("l").isNull() | F.col("bad"), "UNSUPPORTED_SHAPE")
    destructive = F.coalesce(F.col("automation") == "DESTRUCTIVE_OPT_IN", F.lit(False)) | F.col("kind").isin("DROP", "REPLACE") | F.coalesce("destroys", F.lit(False))
    steps = F.when(error.isNull(), F.transform("l", lambda x, i: F.struct((i + 1).alias("step"), x["sql"].alias("sql"))))
    return out.select("comparison_id", "id", F.explode_outer(steps).alias("s"), destructive.alias("destructive"), error.alias("error")).select("comparison_id", "id", "s.step", "s.sql", "destructive", "error")
