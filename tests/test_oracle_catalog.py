"""Rules of Oracle's catalog: hidden columns, foreign keys of other owners, indexes that no snapshot holds, and scripts."""

from loomwright.plans import catalog

AT = "snapshot_id int, owner string, table_name string, column_name string"
RAW = f"{AT}, column_id int, data_type string, data_length int, char_length int, char_used string, data_precision int, data_scale int, data_type_owner string, data_type_mod string, nullable string, identity_column string, default_on_null string, virtual_column string, hidden_column string, user_generated string, data_default string"


def test_columns(spark):
    def row(name, kind, hidden="NO", user="YES", identity="NO", on_null="NO", virtual="NO", default=None, owner=None, used=None):
        return (1, "O", "T", name, 1, kind, 8, 4, used, None, None, owner, None, "N", identity, on_null, virtual, hidden, user, default)

    raw = spark.createDataFrame([row("a", "VARCHAR2", used="B"), row("b", "DATE", "YES", "NO"), row("c", "RAW", "YES", "YES"), row("d", "TIMESTAMP(3) WITH TIME ZONE", default=" "), row("e", "NUMBER", identity="YES", default="seq"), row("f", "NUMBER", on_null="YES"), row("g", "VARCHAR2", owner="X")], RAW)
    none = spark.createDataFrame([], f"{AT}, generation_type string, identity_options string")
    notes = spark.createDataFrame([(1, "O", "T", "a", "note"), (1, "P", "T", "d", "other owner's")], f"{AT}, comments string")
    got = {r.column_name: r for r in catalog.oracle_columns(raw, notes, none).collect()}
    assert set(got) == set("acdefg") and not got["a"].nullable
    assert (got["a"].length, got["a"].comment, got["a"].extensions) == (4, "note", {"oracle.lengthSemantics": "BYTE"})
    assert (got["c"].length, got["c"].extensions) == (8, {"oracle.invisible": "true"})
    assert (got["d"].base_type, got["d"].with_tz, got["d"].default_value, got["d"].comment) == ("TIMESTAMP", True, None, None)
    assert got["e"].default_value == "GENERATED UNKNOWN AS IDENTITY" and got["f"].default_value is None
    assert (got["g"].base_type, got["g"].length) == ("X.VARCHAR2", None)


def test_constraints(spark):
    rows = spark.createDataFrame([(1, "O", "T", "pk", "P", None, None, None, "USER NAME", None), (1, "O", "T", "self", "R", "O", "pk", "NO ACTION", "USER NAME", None), (1, "O", "U", "fk", "R", "O", "pk", "CASCADE", "GENERATED NAME", None), (1, "O", "U", "far", "R", "Z", "zk", None, "USER NAME", None), (1, "Z", "V", "zk", "P", None, None, None, "USER NAME", None), (1, "O", "U", "ro", "O", None, None, None, None, None), (1, "O", "U", "ck", "C", None, None, None, None, " a > 0 ")], "snapshot_id int, owner string, table_name string, constraint_name string, constraint_type string, r_owner string, r_constraint_name string, delete_rule string, generated string, search_condition string")
    cells = [("O", "T", "pk", 2, "b"), ("O", "T", "pk", 1, "a"), ("O", "U", "fk", 1, "x"), ("O", "U", "fk", 2, "y"), ("Z", "V", "zk", 1, "q"), ("O", "U", "far", 1, "x"), ("O", "U", "ck", None, "a")]
    columns = spark.createDataFrame([(1, *c) for c in cells], "snapshot_id int, owner string, table_name string, constraint_name string, position int, column_name string")
    good, deps = catalog.oracle_constraints(rows, columns)
    got = {r.constraint_name: r for r in good.where("object_key <> 'V'").collect()}
    assert set(got) == {"pk", "self", "fk", "far", "ck"}
    assert (got["fk"].columns, got["fk"].ref_table, got["fk"].ref_columns, got["fk"].on_delete, got["fk"].on_update, got["fk"].generated) == (["x", "y"], "T", ["a", "b"], "CASCADE", None, True)
    assert (got["far"].ref_owner, got["far"].ref_table, got["far"].ref_columns) == ("Z", "V", ["q"])
    assert (got["ck"].columns, got["ck"].expression) == ([], "a > 0")
    assert [(r.object_key, r.depends_on) for r in deps.collect()] == [("U", "T")]


def test_indexes(spark):
    rows = spark.createDataFrame([(1, "O", "O", "T", n, t, "UNIQUE") for n, t in [("a", "NORMAL"), ("b", "BITMAP"), ("c", "NORMAL"), ("d", "NORMAL")]], "snapshot_id int, owner string, table_owner string, table_name string, index_name string, index_type string, uniqueness string")
    columns = spark.createDataFrame([(1, "O", "a", 2, "y", "ASC"), (1, "O", "a", 1, "SYS_1", "DESC"), (1, "O", "b", 1, "x", "ASC"), (1, "O", "c", 1, "x", "UP"), (1, "O", "d", 1, None, "ASC")], "snapshot_id int, owner string, index_name string, position int, column_name string, descend string")
    expressions = spark.createDataFrame([(1, "O", "a", 1, "upper(x)")], "snapshot_id int, owner string, index_name string, position int, expression string")
    backing = spark.createDataFrame([(1, "O", "a", "O", "T"), (1, "O", "a", "O", "T")], "snapshot_id int, owner string, index_name string, table_owner string, table_name string")
    good, bad = catalog.oracle_indexes(rows, columns, expressions, backing)
    assert [(r.index_name, r.expressions, r.is_unique, r.generated) for r in good.collect()] == [("a", ["upper(x) DESC", "y"], True, True)]
    assert {r.index_name for r in bad.collect()} == {"b", "c", "d"}
