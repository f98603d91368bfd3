"""Dependencies from raw catalog rows, by number and by name."""

from loomwright.plans import dependencies as dep


def frames(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    placed = "snapshot_id int, oid long, namespace long, extra string"
    raw = {
        "namespaces": table([(1, 1, "app"), (1, 2, "other")], "snapshot_id int, oid long, schema_name string"),
        "pg_class": table([(1, 10, 1, "t"), (1, 11, 1, "v"), (1, 12, 2, "u"), (1, 13, 1, "unknown"), (1, None, 1, "x")], placed),
        "pg_proc": table([(1, 20, 1, "f")], placed),
        "pg_type": table([(1, 30, 1, "domain")], placed),
        "pg_trigger": table([(1, 40, 10)], "snapshot_id int, oid long, relation long"),
        "pg_attrdef": table([(1, 50, 10)], "snapshot_id int, oid long, relation long"),
        "pg_constraint": table([(1, 60, 10, None), (1, 61, None, 30), (1, 62, None, None)], "snapshot_id int, oid long, relation long, type long"),
    }
    objects = table([(1, "pg_class", 10, "TABLE", "t", None), (1, "pg_class", 11, "VIEW", "v", None), (1, "pg_class", 12, "TABLE", "u", None), (1, "pg_proc", 20, "FUNCTION", "f", None), (1, "pg_type", 30, "TYPE", "d", None), (1, "pg_trigger", 40, "TRIGGER", "g", None), (1, "pg_attrdef", 50, "TABLE", "t", None), (1, "pg_constraint", 60, "CHECK_CONSTRAINT", "c", "t")], "snapshot_id int, catalog string, oid long, object_type string, object_key string, parent_key string")
    return raw, objects


def resolve(spark, rows):
    raw, objects = frames(spark)
    depends = spark.createDataFrame(rows, "snapshot_id int, catalog string, oid long, ref_catalog string, ref_oid long")
    rewrites = spark.createDataFrame([(1, 70, 11)], "snapshot_id int, oid long, view long")
    schemas = spark.createDataFrame([(1, "app")], "snapshot_id int, schema_name string")
    good, bad = dep.numbered_dependencies(dep.numbered_edges(depends, rewrites), dep.numbered_entities(raw), objects, schemas)
    return {(r.object_key, r.depends_on) for r in good.collect()}, {r.object_type for r in bad.collect()}


def test_entities(spark):
    rows = {(r.catalog, r.oid): r.schema_name for r in dep.numbered_entities(frames(spark)[0]).collect()}
    assert rows["pg_trigger", 40] == rows["pg_attrdef", 50] == rows["pg_constraint", 60] == rows["pg_constraint", 61] == "app"
    assert rows["pg_class", 12] == "other" and ("pg_constraint", 62) not in rows


def test_numbered(spark):
    assert resolve(spark, [(1, "pg_trigger", 40, "pg_proc", 20), (1, "pg_trigger", 40, "pg_proc", 20)]) == ({("g", "f")}, set())
    assert resolve(spark, [(1, "pg_rewrite", 70, "pg_class", 10), (1, "pg_rewrite", 70, "pg_class", 11), (1, "pg_rewrite", 70, "pg_trigger", 40)]) == ({("v", "t")}, set())
    # A default's function is needed by its table, a constraint's by the constraint and its table.
    assert resolve(spark, [(1, "pg_attrdef", 50, "pg_proc", 20), (1, "pg_constraint", 60, "pg_type", 30)]) == ({("t", "f"), ("c", "d"), ("t", "d")}, set())
    # The constraint needs its own table; the table doesn't need itself.
    assert resolve(spark, [(1, "pg_constraint", 60, "pg_class", 10), (1, "pg_attrdef", 50, "pg_class", 10)]) == ({("c", "t")}, set())
    # Another schema's target says nothing, a missing one of this schema is told, an unknown source is nothing.
    assert resolve(spark, [(1, "pg_class", 11, "pg_class", 12), (1, "pg_class", 11, "pg_class", 13), (1, "pg_class", 13, "pg_class", 10)]) == (set(), {"VIEW"})
    assert resolve(spark, [(1, "pg_cast", 1, "pg_class", 10), (1, "pg_class", None, "pg_class", 10), (2, "pg_class", 11, "pg_class", 10)]) == (set(), set())
    assert resolve(spark, []) == (set(), set())


def test_named(spark):
    objects = spark.createDataFrame([(1, "A", t, n, o, k) for t, n, o, k in [("TABLE", "T", "TABLE", "t"), ("VIEW", "V", "VIEW", "v"), ("FUNCTION", "F", "FUNCTION", "f(int)"), ("FUNCTION", "F", "FUNCTION", "f(text)"), ("PACKAGE", "P", "PACKAGE_SPEC", "p"), ("PACKAGE BODY", "P", "PACKAGE_BODY", "pb"), ("TRIGGER", "G", "TRIGGER", "g"), ("TRIGGER", "H", "TRIGGER", "h")]], "snapshot_id int, owner string, type string, name string, object_type string, object_key string")
    rows = spark.createDataFrame([(1, "A", *r) for r in [("VIEW", "V", "A", "TABLE", "T"), ("FUNCTION", "F", "A", "TABLE", "T"), ("PACKAGE BODY", "P", "A", "FUNCTION", "F"), ("VIEW", "V", "SYS", "TABLE", "DUAL"), ("VIEW", "V", "A", "SYNONYM", "S"), ("NOTHING", "N", "A", "TABLE", "T")]], "snapshot_id int, owner string, type string, name string, ref_owner string, ref_type string, ref_name string")
    bodies = spark.createDataFrame([(1, "A", "PACKAGE BODY", "P", None, None, None), (1, "A", "TRIGGER", "G", "A", "TABLE", "T"), (1, "A", "TRIGGER", "H", "A", "TABLE", "GONE"), (1, "A", "VIEW", "V", None, None, None)], "snapshot_id int, owner string, type string, name string, base_owner string, base_type string, base_name string")
    schemas = spark.createDataFrame([(1, "A")], "snapshot_id int, schema_name string")
    good, bad = dep.named_dependencies(rows, objects, bodies, schemas)
    assert {(r.object_key, r.depends_on) for r in good.collect()} == {("v", "t"), ("f(int)", "t"), ("f(text)", "t"), ("pb", "p"), ("g", "t")}
    # An overloaded target isn't the only one, and a trigger's table may be gone.
    assert {r.object_type for r in bad.collect()} == {"PACKAGE_BODY", "TRIGGER"}
