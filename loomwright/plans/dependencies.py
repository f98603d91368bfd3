"""Dependencies between objects of schemas from raw catalog rows, for many catalog readings (snapshot_id) at once.

Catalogs that number their objects (PostgreSQL) say which number needs which; catalogs that name them (Oracle) say so by owner,
type and name. Both ends are looked up by joins on those keys, so a dependency row meets one row an end, whatever hangs on an
object. Rows with a null key meet nothing and give nothing; repeated rows count once; further columns are left out; empty tables
give empty results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Catalogs that number objects with dependencies, and those that a view's rewrite rule can point to.
CATALOGS = ["pg_class", "pg_proc", "pg_type", "pg_trigger", "pg_attrdef", "pg_constraint"]
REWRITTEN = ["pg_class", "pg_proc", "pg_type"]
# Named types that a missing target is told for.
NAMED_TYPES = ["TABLE", "VIEW", "MATERIALIZED VIEW", "SEQUENCE", "FUNCTION", "PROCEDURE", "TRIGGER", "PACKAGE", "PACKAGE BODY", "TYPE", "TYPE BODY"]

_END = ["snapshot_id", "catalog", "oid"]


def numbered_entities(raw: dict[str, DataFrame]) -> DataFrame:
    """(snapshot_id, catalog, oid, schema_name) of everything that can have or be a dependency.

    raw has `namespaces` (snapshot_id, oid, schema_name), `pg_class`, `pg_proc` and `pg_type` (snapshot_id, oid, namespace),
    `pg_trigger` and `pg_attrdef` (snapshot_id, oid, relation), and `pg_constraint` (snapshot_id, oid, relation, type): a constraint
    is in the schema of its table, or else in that of its domain type."""
    spaces = raw["namespaces"].select("snapshot_id", F.col("oid").alias("namespace"), "schema_name")
    placed = {c: raw[c].select("snapshot_id", "oid", "namespace").join(spaces, ["snapshot_id", "namespace"]).select("snapshot_id", "oid", "schema_name") for c in REWRITTEN}
    home = lambda c, end, name: placed[c].select("snapshot_id", F.col("oid").alias(end), F.col("schema_name").alias(name))
    for c in ("pg_trigger", "pg_attrdef"):
        placed[c] = raw[c].select("snapshot_id", "oid", "relation").join(home("pg_class", "relation", "schema_name"), ["snapshot_id", "relation"]).select("snapshot_id", "oid", "schema_name")
    both = raw["pg_constraint"].select("snapshot_id", "oid", "relation", "type").join(home("pg_class", "relation", "r"), ["snapshot_id", "relation"], "left").join(home("pg_type", "type", "t"), ["snapshot_id", "type"], "left")
    placed["pg_constraint"] = both.select("snapshot_id", "oid", F.coalesce("r", "t").alias("schema_name")).where("schema_name is not null")
    return reduce(DataFrame.unionByName, (placed[c].select("snapshot_id", F.lit(c).alias("catalog"), "oid", "schema_name") for c in CATALOGS))


def numbered_edges(depends: DataFrame, rewrites: DataFrame) -> DataFrame:
    """(snapshot_id, source_catalog, source_oid, target_catalog, target_oid) of depends (snapshot_id, catalog, oid, ref_catalog, ref_oid):
    rows between the six catalogs, and what the rewrite rules (snapshot_id, oid, view) need, which their views need. What needs
    itself is left out."""
    direct = depends.where(F.col("catalog").isin(CATALOGS) & F.col("ref_catalog").isin(CATALOGS))
    rules = rewrites.select("snapshot_id", "oid", "view")
    through = depends.where((F.col("catalog") == "pg_rewrite") & F.col("ref_catalog").isin(REWRITTEN)).join(rules, ["snapshot_id", "oid"])
    through = through.select("snapshot_id", F.lit("pg_class").alias("catalog"), F.col("view").alias("oid"), "ref_catalog", "ref_oid")
    out = direct.select("snapshot_id", "catalog", "oid", "ref_catalog", "ref_oid").unionByName(through)
    return out.where("not (catalog = ref_catalog and oid = ref_oid)").toDF("snapshot_id", "source_catalog", "source_oid", "target_catalog", "target_oid")


def numbered_dependencies(edges: DataFrame, entities: DataFrame, objects: DataFrame, schemas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dependencies, unresolved) of the schemas (snapshot_id, schema_name) read: dependencies (snapshot_id, schema_name, object_key,
    depends_on) and unresolved (snapshot_id, schema_name, object_type).

    objects (snapshot_id, catalog, oid, object_type, object_key, parent_key) are those known; several numbers may have one key. Both
    ends must be entities of the same schema; an edge that leaves it says nothing. A source that isn't known says nothing, a
    target that isn't known marks its source's type as unresolved. What has a parent (a table's constraint or index) hands its
    dependencies on to it as well."""
    ends = entities.select(*_END, "schema_name")
    end = lambda df, side: df.toDF("snapshot_id", f"{side}_catalog", f"{side}_oid", *(f"{side}_{c}" for c in df.columns[3:]))
    known = objects.select(*_END, "object_type", "object_key", "parent_key")
    sources = ends.join(schemas.select("snapshot_id", "schema_name"), ["snapshot_id", "schema_name"], "left_semi").select(*_END, "schema_name").join(known, _END)
    targets = ends.join(known.select(*_END, "object_key"), _END, "left").select(*_END, "schema_name", "object_key")
    found = edges.join(end(sources, "source"), ["snapshot_id", "source_catalog", "source_oid"]).join(end(targets, "target"), ["snapshot_id", "target_catalog", "target_oid"])
    found = found.where("source_schema_name = target_schema_name")
    rows = found.select("snapshot_id", F.col("source_schema_name").alias("schema_name"), F.col("source_object_type").alias("object_type"), F.col("source_object_key").alias("object_key"), F.col("source_parent_key").alias("parent_key"), F.col("target_object_key").alias("depends_on"))
    return _told(rows)


def _told(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolved and unresolved of rows (..., object_type, object_key, parent_key, depends_on), where a null depends_on wasn't found."""
    holders = F.explode(F.filter(F.array("object_key", "parent_key"), lambda k: k.isNotNull()))
    good = rows.where("depends_on is not null and object_key <> depends_on").select("snapshot_id", "schema_name", holders.alias("object_key"), "depends_on")
    bad = rows.where("depends_on is null").select("snapshot_id", "schema_name", "object_type")
    return good.where("object_key <> depends_on").distinct(), bad.distinct()


def named_dependencies(rows: DataFrame, objects: DataFrame, bodies: DataFrame, schemas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dependencies, unresolved), as numbered_dependencies gives them, of rows (snapshot_id, owner, type, name, ref_owner, ref_type,
    ref_name) that name both ends.

    objects (snapshot_id, owner, type, name, object_type, object_key) may have several keys under one name (overloaded routines): each
    of them is a source, but a target must be the only one. A target of another owner says nothing; one that isn't there, or isn't
    the only one, marks its sources' types if it is of a type that snapshots hold. bodies (snapshot_id, owner, type, name, base_owner,
    base_type, base_name) adds what catalogs don't list: a body needs its specification, a trigger the table or view it is on."""
    at = ["snapshot_id", "owner", "type", "name"]
    listed = rows.select(*at, "ref_owner", "ref_type", "ref_name").where(F.col("ref_owner") == F.col("owner"))
    spec = F.when(F.col("type") == "PACKAGE BODY", "PACKAGE").when(F.col("type") == "TYPE BODY", "TYPE")
    on_base = (F.col("type") == "TRIGGER") & F.col("base_type").isin("TABLE", "VIEW") & (F.col("base_owner") == F.col("owner"))
    implied = bodies.where(spec.isNotNull() | on_base).select(*at, F.col("owner").alias("ref_owner"), F.coalesce(spec, F.col("base_type")).alias("ref_type"), F.when(spec.isNotNull(), F.col("name")).otherwise(F.col("base_name")).alias("ref_name"))
    edges = listed.unionByName(implied).distinct()
    own = objects.join(schemas.select("snapshot_id", F.col("schema_name").alias("owner")), ["snapshot_id", "owner"], "left_semi")
    sources = own.select(*at, "object_type", "object_key")
    # One row a name, so a name's overloads aren't gathered: the only key, or none.
    targets = own.groupBy(*at).agg(F.min("object_key").alias("least"), F.max("object_key").alias("most")).select("snapshot_id", F.col("owner").alias("ref_owner"), F.col("type").alias("ref_type"), F.col("name").alias("ref_name"), F.when(F.col("least") == F.col("most"), F.col("least")).alias("depends_on"))
    found = edges.join(sources, at).join(targets, ["snapshot_id", "ref_owner", "ref_type", "ref_name"], "left")
    found = found.where(F.col("depends_on").isNotNull() | F.col("ref_type").isin(NAMED_TYPES))
    return _told(found.select("snapshot_id", F.col("owner").alias("schema_name"), "object_type", "object_key", F.lit(None).cast("string").alias("parent_key"), "depends_on"))
