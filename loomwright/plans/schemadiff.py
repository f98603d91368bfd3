"""Comparison of schema snapshots, many at once: rows carry comparison_id and side (source or target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.owners import without_owner_column
from .catalog import canonical

OBJECT = ["comparison_id", "object_type", "object_key"]


def validate_snapshots(objects: DataFrame) -> DataFrame:
    """(comparison_id, violation): sides of different database types, null keys, and keys that occur twice on a side."""
    kinds = objects.groupBy("comparison_id").agg(F.count_distinct("db_type").alias("n")).where("n > 1").select("comparison_id", F.lit("DB_TYPE").alias("violation"))
    nulls = objects.where("object_key is null or object_type is null").select("comparison_id", F.lit("NULL_KEY").alias("violation"))
    twice = objects.where("object_key is not null").groupBy(*OBJECT, "side").agg(F.count("*").alias("n")).where("n > 1").select("comparison_id", F.lit("DUPLICATE_KEY").alias("violation"))
    return kinds.union(nulls).union(twice).distinct()


def project_owner(objects: DataFrame, mode: str = "postgres") -> DataFrame:
    """objects with keys and definitions that leave the own schema out, so that a.t and b.t compare equal; see owners.without_owner. A
    definition of low confidence, or one that can't be told apart from its owner, becomes a digest with its owner, which equals no
    other. error tells foreign owners and colliding keys."""
    own = F.col("owner") == F.col("schema_name")
    bare = without_owner_column(F.col("definition"), F.col("schema_name"), mode)
    digest = F.concat(F.lit("sha256:"), F.sha2(canonical("owner", "definition"), 256))
    told = objects.withColumn("__bare", bare)
    unsure = (F.col("confidence") == "LOW") | (F.col("definition").isNotNull() & F.col("__bare").isNull())
    text = F.when(unsure, digest).otherwise(F.col("__bare"))
    out = told.withColumn("object_key", F.when(own, F.col("object_name")).otherwise(F.concat("owner", F.lit("."), "object_name"))).withColumn("definition", text).drop("__bare")
    same = out.groupBy("comparison_id", "side", "object_type", "object_key").agg(F.count("*").alias("__n"))
    out = out.join(same, ["comparison_id", "side", "object_type", "object_key"])
    return out.withColumn("error", F.when(~own, "FOREIGN_OWNER").when(F.col("__n") > 1, "COLLISION")).drop("__n")


def object_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """(comparison_id, object_type, object_key, kind) over the keys of both sides; body is compared, null like null."""
    s = source.select(*OBJECT, F.col("body").alias("s"), F.lit(True).alias("in_s"))
    t = target.select(*OBJECT, F.col("body").alias("t"), F.lit(True).alias("in_t"))
    kind = F.when(F.col("in_t").isNull(), "MISSING_IN_TARGET").when(F.col("in_s").isNull(), "EXTRA_IN_TARGET").when(F.col("s").eqNullSafe(F.col("t")), "EQUIVALENT").otherwise("MODIFIED")
    return s.join(t, OBJECT, "full_outer").select(*OBJECT, kind.alias("kind"))


def mask_unavailable(diff: DataFrame, completeness: DataFrame) -> DataFrame:
    """diff with kind UNSUPPORTED for types that either side (comparison_id, object_type) couldn't read."""
    gone = completeness.select("comparison_id", "object_type", F.lit(True).alias("__gone")).distinct()
    return diff.join(gone, ["comparison_id", "object_type"], "left").withColumn("kind", F.when(F.col("__gone"), "UNSUPPORTED").otherwise(F.col("kind"))).drop("__gone")


def _properties(joined: DataFrame, key: list[str], prefix: Column, names: list[str]) -> DataFrame:
    """(key, path, source_value, target_value) of the named columns s_* and t_* that differ."""
    each = F.array(*(F.struct(F.concat(prefix, F.lit(n)).alias("path"), F.col(f"s_{n}").cast("string").alias("source_value"), F.col(f"t_{n}").cast("string").alias("target_value")) for n in names))
    return joined.select(*key, F.explode(F.filter(each, lambda p: ~p["source_value"].eqNullSafe(p["target_value"]))).alias("p")).select(*key, "p.*")


def column_property_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """(comparison_id, object_key, path, source_value, target_value): columns that only one side has, and the properties in
    which columns of both differ. A table with a column name twice on a side gets one row with the path columns."""
    key = ["comparison_id", "object_key"]
    props = ["dataType", "nullable", "normalizedDefault", "ordinal", "comment"]
    repeated = lambda df: df.groupBy(*key, "column_name").agg(F.count("*").alias("n")).where("n > 1").select(*key)
    twice = repeated(source).union(repeated(target)).distinct()
    named = lambda df, p: df.join(twice, key, "left_anti").select(*key, "column_name", *(F.col(c).alias(f"{p}_{c}") for c in props), F.lit(True).alias(f"in_{p}"))
    tables = source.select(*key).distinct().join(target.select(*key).distinct(), key)
    joined = named(source, "s").join(named(target, "t"), [*key, "column_name"], "full_outer").join(tables, key, "left_semi")
    path = F.concat(F.lit("columns["), "column_name", F.lit("]"))
    whole = joined.where("in_s is null or in_t is null").select(*key, path.alias("path"), F.when(F.col("in_s"), F.col("s_dataType")).alias("source_value"), F.when(F.col("in_t"), F.col("t_dataType")).alias("target_value"))
    parts = _properties(joined.where("in_s and in_t"), key, F.concat(path, F.lit(".")), props)
    unsure = twice.select(*key, F.lit("columns").alias("path"), F.lit(None).cast("string").alias("source_value"), F.lit(None).cast("string").alias("target_value"))
    return whole.unionByName(parts).unionByName(unsure)


def multiset_diff(source: DataFrame, target: DataFrame, path: str) -> DataFrame:
    """(comparison_id, object_key, path, n_source, n_target): objects whose multisets of entries (body) differ, and how many of
    the entries that differ each side has more. Names that a database made up are not part of body."""
    count = lambda df, n: df.groupBy("comparison_id", "object_key", "body").agg(F.count("*").alias(n))
    both = count(source, "a").join(count(target, "b"), ["comparison_id", "object_key", "body"], "full_outer").na.fill(0, ["a", "b"])
    out = both.where("a <> b").groupBy("comparison_id", "object_key").agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("n_source"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("n_target"))
    return out.select("comparison_id", "object_key", F.lit(path).alias("path"), "n_source", "n_target")


def sequence_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """(comparison_id, object_key, path, source_value, target_value) of sequences of both sides. Extensions are maps and compare
    by their sorted entries, dependencies by their sorted keys."""
    key, plain = ["comparison_id", "object_key"], ["startValue", "incrementBy", "minimumValue", "maximumValue", "cycle", "cacheSize"]
    text = lambda df, p: df.select(*key, *(F.col(c).alias(f"{p}_{c}") for c in plain), F.to_json(F.array_sort(F.map_entries("extensions"))).alias(f"{p}_extensions"), F.array_join(F.array_sort("dependencies"), ",").alias(f"{p}_dependencies"))
    return _properties(text(source, "s").join(text(target, "t"), key), key, F.lit(""), [*plain, "extensions", "dependencies"])


def definition_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """(comparison_id, object_key, source_digest, target_digest, reliable): definitions that differ, or that can't be told apart
    as one side's confidence isn't high."""
    key = ["comparison_id", "object_key"]
    side = lambda df, p: df.select(*key, F.col("definition").alias(f"{p}d"), (F.col("confidence") == "HIGH").alias(f"{p}h"))
    both = side(source, "s").join(side(target, "t"), key)
    reliable = F.col("sh") & F.col("th")
    digest = lambda c: F.concat(F.lit("sha256:"), F.sha2(c, 256))
    return both.where(~F.col("sd").eqNullSafe(F.col("td")) | ~reliable).select(*key, digest("sd").alias("source_digest"), digest("td").alias("target_digest"), reliable.alias("reliable"))


def risk_automation(diff: DataFrame, properties: DataFrame) -> DataFrame:
    """diff (comparison_id, object_type, object_key, kind, confidence, reliable) with risk and automation. properties has path,
    and safe_add for a whole nullable column without default that the source has more."""
    told = properties.groupBy("comparison_id", "object_key").agg(F.count("*").alias("__n"), F.count(F.when(F.col("safe_add"), 1)).alias("__safe"))
    out = diff.join(told, ["comparison_id", "object_key"], "left")
    low = F.col("confidence") == "LOW"
    lone = (F.col("__n") == 1) & (F.col("__safe") == 1)
    k = F.col("kind")
    risk = F.when(k == "EQUIVALENT", "LOW").when(k == "UNSUPPORTED", "HIGH").when(low, "HIGH").when(k == "MISSING_IN_TARGET", "LOW").when(k == "EXTRA_IN_TARGET", "CRITICAL").when(F.col("reliable") & F.coalesce(lone, F.lit(False)), "LOW").otherwise("HIGH")
    auto = F.when(k == "EQUIVALENT", "SAFE_AUTOMATIC").when((k == "UNSUPPORTED") | low, "MANUAL_ONLY").when(k == "MISSING_IN_TARGET", "SAFE_AUTOMATIC").when(k == "EXTRA_IN_TARGET", "DESTRUCTIVE_OPT_IN").when(~F.col("reliable"), "MANUAL_ONLY").when(F.coalesce(lone, F.lit(False)), "SAFE_AUTOMATIC").otherwise("DESTRUCTIVE_OPT_IN")
    return out.withColumns({"risk": risk, "automation": auto}).drop("__n", "__safe")


def rename_suggestions(missing: DataFrame, extra: DataFrame) -> DataFrame:
    """(comparison_id, object_type, old_key, new_key, score): a missing and an extra object of one structure, where neither has
    another partner. Structures meet by their hash; only hashes that each side has once give a row."""
    by = ["comparison_id", "object_type", "signature", "h"]
    once = lambda df, n: df.withColumn("h", F.sha2("structure", 256)).groupBy(*by).agg(F.count("*").alias("n"), F.min("object_key").alias(n)).where("n = 1").drop("n")
    return once(missing, "new_key").join(once(extra, "old_key"), by).select("comparison_id", "object_type", "old_key", "new_key", F.lit(1.0).alias("score"))
