"""Keyspaces: key trees, sizes, and values of key-value databases."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def glob_regex(pattern: str | None) -> str:
    """An anchored regular expression for a glob of * ? [..] and backslash; blank matches all."""
    pattern = pattern if pattern and pattern.strip() else "*"
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif end > 0:
            inner = pattern[i + 1 : end]
            out += "[" + ("^" if inner[0] == "^" else "") + inner.lstrip("^").replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]"
            i = end
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


def match_keys(df: DataFrame, pattern: str | None) -> DataFrame:
    return df.where(F.col("key").rlike(glob_regex(pattern)))


def key_tree(df: DataFrame, separator: str = ":") -> DataFrame:
    """(path, depth, segment, full_key, key_count): a node for each prefix of the distinct keys, and a root with all of
    them. A key can have others below it; empty segments count; without a separator each key is a node below the root.

    Hot prefixes are counted before the shuffle, as any aggregate is."""
    keys = df.where(F.col("key").isNotNull()).select("key").distinct()
    parts = F.split("key", "\\Q" + separator + "\\E", -1) if separator else F.array("key")
    nodes = keys.select("key", parts.alias("parts")).select("key", "parts", F.explode(F.expr("sequence(0, size(parts))")).alias("depth"))
    nodes = nodes.select(F.slice("parts", F.lit(1), F.col("depth")).alias("path"), "depth", F.when(F.col("depth") == F.size("parts"), F.col("key")).alias("full_key"))
    out = nodes.groupBy("path", "depth").agg(F.max("full_key").alias("full_key"), F.count("*").alias("key_count"))
    return out.select("path", "depth", F.when(F.col("depth") > 0, F.element_at("path", -1)).otherwise("").alias("segment"), "full_key", "key_count")


def keyspace_sizes(info: DataFrame, databases: int = 16) -> DataFrame:
    """(db, n_keys) for each database; info lines are dbN:keys=M,... and others are skipped."""
    line = F.regexp_extract("line", r"^db(\d+):keys=(\d+)(?:,|$)", 0)
    found = info.where(line != "").select(F.regexp_extract("line", r"^db(\d+):", 1).try_cast("int").alias("db"), F.regexp_extract("line", r"keys=(\d+)", 1).try_cast("long").alias("n"))
    all_dbs = info.sparkSession.range(databases).select(F.col("id").cast("int").alias("db"))
    return all_dbs.join(found.groupBy("db").agg(F.max("n").alias("n")), "db", "left").select("db", F.coalesce("n", F.lit(0)).alias("n_keys"))


def fold_pairs(df: DataFrame, scored: bool = False) -> DataFrame:
    """df with pairs, of (field, value) or (member, score), from the flat array items; an odd one gives no pairs and an error."""
    n = F.size("items")
    second = lambda i: F.get("items", i + 1).try_cast("double") if scored else F.get("items", i + 1)
    names = ("member", "score") if scored else ("field", "value")
    pairs = F.transform(F.expr("filter(sequence(0, greatest(size(items) - 1, 0)), i -> i % 2 = 0 and size(items) > 0)"), lambda i: F.struct(F.get("items", i).alias(names[0]), second(i).alias(names[1])))
    return df.withColumn("error", F.when(n % 2 != 0, "ODD_LENGTH")).withColumn("pairs", F.when(n % 2 == 0, pairs))


def list_page(df: DataFrame, offset: int, size: int = 200) -> DataFrame:
    """(key, idx, item, length, has_next): a slice of each list."""
    rows = df.select("key", F.size("items").alias("length"), F.posexplode(F.slice("items", offset + 1, size)).alias("i", "item"))
    return rows.select("key", (F.col("i") + offset).alias("idx"), "item", "length", (F.col("length") > offset + size).alias("has_next"))


def value_preview(df: DataFrame, most: int = 1 << 20, shown: int = 4096) -> DataFrame:
    """(key, length, value, is_preview): values of over `most` bytes are cut to the first `shown`."""
    size = F.octet_length("value")
    return df.select("key", size.alias("length"), F.when(size > most, F.substring("value", 1, shown)).otherwise(F.col("value")).alias("value"), (size > most).alias("is_preview"))


def ttl_state(df: DataFrame) -> DataFrame:
    """df with state: persistent for -1, missing for -2, else expiring."""
    return df.withColumn("state", F.when(F.col("ttl") == -1, "persistent").when(F.col("ttl") >= 0, "expiring").otherwise("missing"))
