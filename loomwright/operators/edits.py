"""Guarded row edits: each edit names its row by old key values and counts only if exactly one row has them.

An edit is (edit_id, edit_seq, key struct of text values, values map of column to new text). Edits of a batch follow one another: each
sees the table as those before it left it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import graphs
from ..functions.scalars import coerce_error, coerce_text
from ..shared import kept, merged

#: Spark types and the names that the coercion rules have for them.
KINDS = {"tinyint": "tinyint", "smallint": "smallint", "int": "integer", "bigint": "bigint", "float": "float", "double": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "string": "varchar"}


def _kind(dtype: T.DataType) -> str:
    return "decimal" if isinstance(dtype, T.DecimalType) else KINDS.get(dtype.simpleString(), "other")


def derive_row_key(schema: T.StructType, primary_key: list[str] | None = None, is_view: bool = False) -> tuple[list[str], str | None]:
    """The columns that name a row: the primary key, else all columns that can be compared; or no columns and the reason."""
    if is_view:
        return [], "views are read-only"
    if primary_key:
        return primary_key, None
    plain = [f.name for f in schema.fields if not isinstance(f.dataType, (T.BinaryType, T.TimestampType, T.TimestampNTZType, T.ArrayType, T.MapType, T.StructType))]
    return (plain, None) if plain else ([], "no column can name a row")


def changed_values(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key columns, op, changed): per row of after the columns that differ from before and their new text. A row that
    before lacks is an INSERT of its filled columns."""
    columns = [c for c in after.columns if c not in key]
    old = before.select(*key, F.struct(*columns).alias("old"), F.lit(True).alias("known"))
    new = after.select(*key, F.struct(*columns).alias("new"))
    joined = new.join(old, key, "left")
    entries = [F.struct(F.lit(c).alias("key"), F.col(f"new.{c}").cast("string").alias("value"), F.when(F.col("known"), ~F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}"))).otherwise(F.col(f"new.{c}").isNotNull()).alias("hit")) for c in columns]
    hit = F.filter(F.array(*entries), lambda x: x["hit"])
    changed = F.map_from_entries(F.transform(hit, lambda x: F.struct(x["key"], x["value"])))
    return joined.select(*key, F.when(F.col("known"), "UPDATE").otherwise("INSERT").alias("op"), changed.alias("changed")).where(F.size("changed") > 0)


def changes_key(edits: DataFrame, key: list[str]) -> DataFrame:
    """edits with touches_key: whether a key column gets a new value."""
    return edits.withColumn("touches_key", F.exists(F.map_keys("values"), lambda c: c.isin(*key)))


def validate_edits(edits: DataFrame, schema: T.StructType) -> DataFrame:
    """(edit_id, column_name, kind, value, error) for each value that its column can't take, and for edits without values."""
    types = F.create_map(*(F.lit(x) for f in schema.fields for x in (f.name, _kind(f.dataType))))
    each = edits.select("edit_id", F.explode("values").alias("column_name", "value")).withColumn("kind", types[F.col("column_name")])
    bad = reduce(lambda a, k: F.when(F.col("kind") == k, coerce_error("value", k)).otherwise(a), {_kind(f.dataType) for f in schema.fields}, F.lit(False))
    wrong = each.where(F.col("kind").isNull() | bad).withColumn("error", F.when(F.col("kind").isNull(), "UNKNOWN_COLUMN").otherwise("BAD_VALUE"))
    none = edits.where(F.coalesce(F.size("values"), F.lit(0)) <= 0).select("edit_id", F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("kind"), F.lit("NO_VALUES").alias("error"))
    return wrong.unionByName(none).select("edit_id", "column_name", "kind", "value", "error")


def _typed(value: Column, dtype: T.DataType) -> Column:
    return coerce_text(value, _kind(dtype)).try_cast(dtype)


def apply_inserts(df: DataFrame, edits: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """df and a row for each edit; columns that it doesn't name take their default, or null."""
    rows = edits.select(*(F.when(F.map_contains_key("values", F.lit(f.name)), _typed(F.col("values")[f.name], f.dataType)).otherwise((defaults or {}).get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in df.schema.fields))
    return df.unionByName(rows)


#: The keys of so many edits are broadcast.
BROADCAST_EDITS = 200_000


def _matched(df: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """edits with matched, the number of rows that have the key's old values (null like null). The table is counted by key before it
    meets the edits, so that a key of very many rows is a few rows by then; where the edits are few, rows that none names are left out first."""
    names = [f"__{c}" for c in key]
    typed = [_typed(F.col(f"key.{c}"), df.schema[c].dataType) for c in key]
    asked = kept(edits.select(*(t.alias(n) for t, n in zip(typed, names, strict=True))).distinct(), "asked")
    rows = df.select(*(F.col(c).alias(f"__row_{c}") for c in key))
    on = reduce(lambda a, b: a & b, (F.col(f"__row_{c}").eqNullSafe(F.col(f"__{c}")) for c in key))
    if asked.count() <= BROADCAST_EDITS:
        rows = rows.join(F.broadcast(asked), on, "left_semi")
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("matched")).withColumnsRenamed({f"__row_{c}": f"__count_{c}" for c in key})
    counts = kept(counts.join(asked, reduce(lambda a, b: a & b, (F.col(f"__count_{c}").eqNullSafe(F.col(f"__{c}")) for c in key)), "left_semi"), "counts")
    on = reduce(lambda a, b: a & b, (t.eqNullSafe(F.col(f"__count_{c}")) for t, c in zip(typed, key, strict=True)))
    return edits.join(counts, on, "left").drop(*counts.columns[:-1]).withColumn("matched", F.coalesce("matched", F.lit(0)))


def _status() -> Column:
    return F.when(F.col("matched") == 1, "APPLIED").when(F.col("matched") == 0, "STALE").otherwise("AMBIGUOUS")


def outcomes(df: DataFrame, edits: DataFrame, key: list[str], op: str) -> DataFrame:
    """(edit_id, op, matched, status): APPLIED for exactly one row, STALE for none, AMBIGUOUS for more."""
    return _matched(df, edits, key).select("edit_id", F.lit(op).alias("op"), "matched", _status().alias("status"))


def apply_updates(df: DataFrame, edits: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df with the applied edits, outcomes), as replay() has them for updates alone. Where no edit sets a key column, rows keep their
    keys, and of several edits of a row edit_seq orders the values of each column."""
    edits = edits.withColumn("op", F.lit("UPDATE"))
    if not changes_key(edits, key).where("touches_key").isEmpty():
        return replay(df, edits, key)
    told = _checked(df, edits, key)
    good = _matched(df, told.where("error is null"), key)
    each = good.where(F.col("matched") == 1).select(*(_typed(F.col(f"key.{c}"), df.schema[c].dataType).alias(f"__{c}") for c in key), "edit_seq", F.explode("values").alias("name", "value"))
    last = each.groupBy(*(f"__{c}" for c in key), "name").agg(F.max_by(F.struct("value"), "edit_seq").alias("v"))
    sets = last.groupBy(*(f"__{c}" for c in key)).agg(F.map_from_entries(F.collect_list(F.struct("name", "v.value"))).alias("__set"))
    out = df.join(sets, reduce(lambda a, b: a & b, (df[c].eqNullSafe(sets[f"__{c}"]) for c in key)), "left")
    known = good.select("edit_id", "op", "matched", _status().alias("status"))
    return out.select(*_overlaid(df)), _with_messages(known.unionByName(_invalid(told)), told)


def _overlaid(df: DataFrame) -> list[Column]:
    """The columns of df, with what the map __set has for them."""
    return [F.when(F.map_contains_key("__set", F.lit(f.name)), _typed(F.col("__set")[f.name], f.dataType)).otherwise(df[f.name]).alias(f.name) for f in df.schema.fields]


def _checked(df: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """edits with error: what validate_edits says of their values, and BAD_KEY for a key text that its column can't take."""
    wrong = validate_edits(edits.where("op <> 'DELETE'"), df.schema)
    said = F.concat_ws(": ", "column_name", "error")
    wrong = kept(wrong.groupBy("edit_id").agg(F.array_join(F.array_sort(F.collect_set(said)), ", ").alias("__wrong")), "wrong")
    bad = reduce(lambda a, b: a | b, (F.col(f"key.{c}").isNotNull() & _typed(F.col(f"key.{c}"), df.schema[c].dataType).isNull() for c in key))
    told = edits.join(wrong, "edit_id", "left")
    return told.withColumn("error", F.coalesce("__wrong", F.when((F.col("op") != "INSERT") & bad, "BAD_KEY"))).drop("__wrong")


def _invalid(told: DataFrame) -> DataFrame:
    return told.where("error is not null").select("edit_id", "op", F.lit(0).cast("long").alias("matched"), F.lit("INVALID").alias("status"))


def _with_messages(known: DataFrame, told: DataFrame) -> DataFrame:
    """Outcomes with message: null for an applied edit, else why it wasn't."""
    errors = told.where("error is not null").select("edit_id", "error")
    message = F.coalesce("error", F.when(F.col("status") == "STALE", "no row has the old key values").when(F.col("status") == "AMBIGUOUS", F.format_string("%d rows have the old key values", "matched")))
    return known.join(errors, "edit_id", "left").select("edit_id", "op", "matched", "status", message.alias("message"))


def _name(values: list[Column]) -> Column:
    """One text for a row's key values: nulls are like one another and like no text."""
    return F.concat(*(F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("~")) for v in values))


def replay(df: DataFrame, edits: DataFrame, key: list[str], defaults: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(df after a batch, outcomes) for edits (edit_id unique, edit_seq, op: INSERT, UPDATE or DELETE, key, values), one after another by edit_seq,
    then edit_id. Outcomes: (edit_id, op, matched, status, message): APPLIED for exactly one row (or an insert), STALE for none, AMBIGUOUS for more, INVALID for values
    or keys that don't parse.

    Edits meet only where one renames a key to another's. So keys that renames link are a group, and the edits of a group are
    replayed in order as they stream by; what is held are its keys' counts and the rows it changes, not the table's rows."""
    told = kept(_checked(df, edits, key), "edits")
    types = [df.schema[c].dataType for c in key]
    old = [_typed(F.col(f"key.{c}"), t).cast("string") for c, t in zip(key, types, strict=True)]
    given = [(defaults or {}).get(c, F.lit(None)).cast(t).cast("string") for c, t in zip(key, types, strict=True)]
    insert = F.col("op") == "INSERT"
    new = [F.when(F.map_contains_key("values", F.lit(c)), _typed(F.col("values")[c], t).cast("string")).otherwise(F.when(insert, g).otherwise(o)) for c, t, o, g in zip(key, types, old, given, strict=True)]
    named = told.where("error is null").withColumns({"k": F.when(~insert, _name(old)), "to": F.when(F.col("op") != "DELETE", _name(new))})
    named = kept(named.select("edit_id", "edit_seq", "op", "k", F.coalesce("to", "k").alias("to"), "values"), "named")
    asked = kept(named.select(F.explode(F.array("k", "to")).alias("name")).where("name is not null").distinct(), "asked")
    rows = df.select(_name([df[c].cast("string") for c in key]).alias("name"))
    if asked.count() <= BROADCAST_EDITS:
        rows = rows.join(F.broadcast(asked), "name", "left_semi")
    counts = kept(rows.groupBy("name").agg(F.count("*").alias("n")).join(asked, "name", "left_semi"), "counts")
    links = named.where("k <> to").select(F.col("k").alias("a"), F.col("to").alias("b"))
    groups = asked.select("name", F.col("name").alias("team"))
    if not links.isEmpty():
        found = kept(graphs.components(links), "groups")
        groups = asked.join(merged(found), asked["name"] == found["node"], "left").select("name", F.coalesce("component", "name").alias("team"))
    groups = kept(groups.join(merged(counts), "name", "left").select("name", "team", F.coalesce("n", F.lit(0).cast("long")).alias("n")), "groups")
    to = groups.select(F.col("name").alias("to"), "team", F.col("n").alias("n_to"))
    have = groups.select(F.col("name").alias("k"), F.col("n").alias("n_k"))
    queue = named.join(merged(to), "to").join(merged(have), "k", "left").select("team", "edit_seq", "edit_id", "op", "k", "to", "values", "n_k", "n_to")
    schema = T.StructType([*(T.StructField(c, f) for c, f in (("edit_id", edits.schema["edit_id"].dataType), ("op", T.StringType()), ("matched", T.LongType()), ("status", T.StringType()), ("origin", T.StringType()), ("gone", T.BooleanType()))), T.StructField("values", T.MapType(T.StringType(), T.StringType()))])
    queue = queue.repartition("team").sortWithinPartitions("team", "edit_seq", "edit_id")
    done = kept(queue.mapInArrow(_replayed(schema), schema), "replayed")
    known = done.where("status is not null").select("edit_id", "op", "matched", "status")
    changed = kept(done.where("origin is not null").select("origin", "gone", F.col("values").alias("__set")), "changed")
    out = df.withColumn("__name", _name([df[c].cast("string") for c in key])).join(changed, F.col("__name") == F.col("origin"), "left")
    out = out.where(~F.coalesce("gone", F.lit(False))).select(*_overlaid(df))
    out = apply_inserts(out, done.where("status is null and origin is null").select("values"), defaults)
    return out, _with_messages(known.unionByName(_invalid(told)), told)


def _columnwise(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(team, edit_id, op, k, to, n_k, n_to, values) of each edit, made column by column: maps cell by cell take most of a replay's time."""
    cells = [batch.column(c).to_pylist() for c in ("team", "edit_id", "op", "k", "to", "n_k", "n_to")]
    maps = batch.column("values")
    at = maps.offsets.to_pylist()
    first = at[0] if at else 0
    names, texts = (c.slice(first, at[-1] - first if at else 0).to_pylist() for c in (maps.keys, maps.items))
    values = (dict(zip(names[i - first : j - first], texts[i - first : j - first], strict=True)) for i, j in zip(at, at[1:], strict=False))
    return zip(*cells, values, strict=True)


def _replayed(schema: T.StructType):
    """Streams edits, sorted by team, to their outcomes, and the changed rows of each team after its last edit: those with origin, the name
    of a row of the table, and inserted ones."""
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        team, keys, touched, out, types = None, {}, [], [], None

        def flush() -> pa.RecordBatch:
            nonlocal out
            cells, out = out, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in cells], t) for i, t in enumerate(types)], names)

        def end() -> None:
            for row in touched:
                if row["origin"] is not None or not row["gone"]:
                    out.append((None, None, None, None, row["origin"], row["gone"], list(row["values"].items())))

        for batch in batches:
            types = types or [batch.schema.field("edit_id").type, pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string())]
            for own, edit_id, op, k, to, n_k, n_to, values in _columnwise(batch):
                if own != team:
                    end()
                    team, keys, touched = own, {}, []
                for name, n in ((k, n_k), (to, n_to)):
                    # Rows that share a name can't be told apart, and none of them is ever changed.
                    if name is not None and name not in keys:
                        keys[name] = [n if n > 1 else 0, [{"origin": name, "gone": False, "values": {}, "touched": False}] if n == 1 else []]
                matched, status = 1, "APPLIED"
                if op == "INSERT":
                    row = {"origin": None, "gone": False, "values": values, "touched": True}
                    touched.append(row)
                    keys[to][1].append(row)
                else:
                    crowd, rows = keys[k]
                    matched = crowd + len(rows)
                    status = "APPLIED" if matched == 1 else "AMBIGUOUS" if matched else "STALE"
                    if matched == 1:
                        (row,) = rows
                        if not row["touched"]:
                            row["touched"] = True
                            touched.append(row)
                        if op == "DELETE":
                            row["gone"] = True
                            rows.clear()
                        else:
                            row["values"].update(values)
                            if to != k:
                                rows.clear()
                                keys[to][1].append(row)
                out.append((edit_id, op, matched, status, None, None, None))
                if len(out) >= 4096:
                    yield flush()
        end()
        if out:
            yield flush()

    return run


def apply_deletes(df: DataFrame, edits: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df without the rows of the applied edits, outcomes), as replay() has them."""
    return replay(df, _deletes(edits), key)


def _deletes(edits: DataFrame) -> DataFrame:
    return edits.drop("values").withColumns({"op": F.lit("DELETE"), "values": F.lit(None).cast("map<string,string>")})


def apply_ordered_deletes(df: DataFrame, edits: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Deletes in the order of edit_seq up to the first that fails: those before it are applied, those behind it SKIPPED. Edits that a
    boolean column is_new marks are of rows that were never stored: they delete nothing, stop nothing, and are NEW."""
    new = F.coalesce("is_new", F.lit(False)) if "is_new" in edits.columns else F.lit(False)
    own = _deletes(edits.where(~new))
    _, told = replay(df, own, key)
    good = own.join(told.drop("op"), "edit_id")
    first = good.where("status <> 'APPLIED'").agg(F.min("edit_seq").alias("first_bad"))
    good = kept(good.crossJoin(F.broadcast(first)), "deletes")  # one row
    behind = F.coalesce(F.col("edit_seq") > F.col("first_bad"), F.lit(False))
    gone = good.where((F.col("status") == "APPLIED") & ~behind).select(*(_typed(F.col(f"key.{c}"), df.schema[c].dataType).alias(f"__{c}") for c in key))
    on = reduce(lambda a, b: a & b, (df[c].eqNullSafe(gone[f"__{c}"]) for c in key))
    told = good.select("edit_id", F.lit("DELETE").alias("op"), "matched", F.when(behind, "SKIPPED").otherwise(F.col("status")).alias("status"), F.when(~behind, F.col("message")).alias("message"))
    never = edits.where(new).select("edit_id", F.lit("DELETE").alias("op"), F.lit(0).cast("long").alias("matched"), F.lit("NEW").alias("status"), F.lit(None).cast("string").alias("message"))
    return df.join(gone, on, "left_anti"), told.unionByName(never)
