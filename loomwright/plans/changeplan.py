"""Change plans from schema differences: changes, their order, selections and outcomes, for many comparisons at once.

Graphs are walked by repeated joins; each round is written to the shared folder, so that lineages stay short and lost
executors cost one round."""

from __future__ import annotations

import heapq
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import graphs
from ..functions.scalars import canonical_hash, qualify, quote_ident
from ..operators.browse import number_rows
from ..shared import kept, merged

# Ranks of object types in a plan.
RANKS = {"TYPE": 0, "SEQUENCE": 1, "TABLE": 2, "PRIMARY_KEY": 3, "UNIQUE_CONSTRAINT": 3, "CHECK_CONSTRAINT": 3, "INDEX": 4, "FOREIGN_KEY": 5, "VIEW": 6, "MATERIALIZED_VIEW": 6, "FUNCTION": 7, "PROCEDURE": 7, "PACKAGE_SPEC": 7, "PACKAGE_BODY": 7, "TRIGGER": 8}
ROUNDS = 64
_ID = ["comparison_id", "id"]


def _kept(df: DataFrame) -> DataFrame:
    return kept(df, "plan")


def expand_changes(diff: DataFrame, properties: DataFrame) -> DataFrame:
    """(comparison_id, object_type, object_key, path, kind, risk, automation) from diff (kind, confidence, automation) and its
    properties (path, isolatable, safe_add). Definitions change as a whole: their properties are one REPLACE or MANUAL."""
    key = ["comparison_id", "object_type", "object_key"]
    row = lambda kind, risk, auto: F.struct(F.lit(kind).alias("kind"), F.lit(risk).alias("risk"), F.lit(auto).alias("automation"))
    manual = row("MANUAL", "HIGH", "MANUAL_ONLY")
    low = F.col("confidence") == "LOW"
    whole = diff.where("kind in ('UNSUPPORTED', 'MISSING_IN_TARGET', 'EXTRA_IN_TARGET')")
    change = F.when((F.col("kind") == "UNSUPPORTED") | low, manual).when(F.col("kind") == "MISSING_IN_TARGET", row("CREATE", "LOW", "SAFE_AUTOMATIC")).otherwise(row("DROP", "CRITICAL", "DESTRUCTIVE_OPT_IN"))
    out = whole.select(*key, F.lit("$object").alias("path"), change.alias("c"))
    modified = diff.where("kind = 'MODIFIED'").select(*key, "confidence", F.col("automation").alias("auto"), "is_definition")
    each = modified.join(properties.select("comparison_id", "object_key", "path", "isolatable", "safe_add"), ["comparison_id", "object_key"], "left")
    stuck = low | (F.col("auto") == "MANUAL_ONLY") | ~F.coalesce("isolatable", F.lit(False))
    alter = F.when(stuck, manual).when(F.col("safe_add"), row("ALTER", "LOW", "SAFE_AUTOMATIC")).otherwise(row("ALTER", "HIGH", "DESTRUCTIVE_OPT_IN"))
    plain = each.where("not is_definition or path is null").select(*key, F.coalesce("path", F.lit("$object")).alias("path"), alter.alias("c"))
    texts = each.where("is_definition and path is not null").groupBy(*key).agg(F.max(stuck).alias("stuck"), F.coalesce(F.max(F.when(F.col("path") == "normalizedDefinition", F.col("path"))), F.min("path")).alias("path"))
    replaced = texts.select(*key, "path", F.when(F.col("stuck"), manual).otherwise(row("REPLACE", "HIGH", "DESTRUCTIVE_OPT_IN")).alias("c"))
    return out.unionByName(plain).unionByName(replaced).select(*key, "path", "c.*")


def change_ids(changes: DataFrame) -> DataFrame:
    """changes with id; a comparison that has one twice is an error."""
    name = F.coalesce(F.col("original"), F.col("object_key")) if "original" in changes.columns else F.col("object_key")
    quoted = F.col("quoted").cast("string") if "quoted" in changes.columns else F.lit("false")
    signature = F.col("signature") if "signature" in changes.columns else F.lit("")
    out = changes.withColumn("id", F.concat(F.lit("chg:"), canonical_hash("change-v1", "kind", "object_type", name, F.col("object_key"), quoted, signature, F.col("path"))))
    twice = out.groupBy(*_ID).agg(F.count("*").alias("__n"))
    out = out.join(merged(twice), _ID)
    return out.withColumn("id", F.when(F.col("__n") == 1, F.col("id")).otherwise(F.raise_error(F.lit("duplicate change id")))).drop("__n")


def wire_dependencies(changes: DataFrame, deps: DataFrame) -> DataFrame:
    """(comparison_id, id, needs): edges between changes from object dependencies (comparison_id, object_key, depends_on). A
    change needs those of the objects it depends on; of two drops, the object depended on goes last."""
    a = changes.select("comparison_id", "object_key", F.col("id").alias("a"), (F.col("kind") == "DROP").alias("ad"))
    b = changes.select("comparison_id", F.col("object_key").alias("depends_on"), F.col("id").alias("b"), (F.col("kind") == "DROP").alias("bd"))
    pairs = deps.distinct().join(merged(a), ["comparison_id", "object_key"]).join(merged(b), ["comparison_id", "depends_on"]).where("ad = bd")
    return pairs.select("comparison_id", F.when(F.col("ad"), F.col("b")).otherwise(F.col("a")).alias("id"), F.when(F.col("ad"), F.col("a")).otherwise(F.col("b")).alias("needs")).distinct()


def unreleasable_drops(changes: DataFrame, target_deps: DataFrame, source_deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manual, edges): drops that a surviving object of the target still needs (comparison_id, id), and edges from the drops
    whose need ends: the source has no such dependency, and an executable change of the object's dependencies releases it."""
    drops = changes.where("kind = 'DROP'").select("comparison_id", F.col("object_key").alias("depends_on"), "id")
    alive = target_deps.join(changes.where("kind = 'DROP'").select("comparison_id", "object_key"), ["comparison_id", "object_key"], "left_anti")
    needed = alive.join(drops, ["comparison_id", "depends_on"])
    release = changes.where("path = 'dependencies' and kind not in ('DROP', 'MANUAL') and automation <> 'MANUAL_ONLY'").select("comparison_id", "object_key", F.col("id").alias("needs"))
    still = source_deps.select("comparison_id", "object_key", "depends_on", F.lit(True).alias("still")).distinct()
    told = needed.join(still, ["comparison_id", "object_key", "depends_on"], "left").join(release, ["comparison_id", "object_key"], "left")
    bad = F.col("still").isNotNull() | F.col("needs").isNull()
    return told.where(bad).select(*_ID).distinct(), told.where(~bad).select(*_ID, "needs").distinct()


def _node(column: str) -> Column:
    """One name for a change of a comparison."""
    return F.concat_ws("\0", F.col("comparison_id").cast("string"), F.col(column).cast("string"))


def needing(edges: DataFrame, roots: DataFrame, rounds: int | None = None) -> DataFrame:
    """(comparison_id, id) of the changes that need one of roots (comparison_id, id), at any distance: a walk from the roots, in
    as many rounds as the longest path has edges; more than `rounds`, if given, are an error. Each round writes its front alone."""
    edges = _kept(edges.select(*_ID, "needs").distinct())
    front = _kept(roots.select(*_ID).distinct())
    seen = front.limit(0)
    for n in itertools.count(1):
        nexts = edges.join(merged(front.select("comparison_id", F.col("id").alias("needs"))), ["comparison_id", "needs"], "left_semi").select(*_ID).distinct()
        front = _kept(nexts.join(merged(seen), _ID, "left_anti"))
        if front.isEmpty():
            return seen
        if n == rounds:
            raise RuntimeError(f"the walk did not settle in {rounds} rounds")
        seen = seen.union(front) if n % 16 else _kept(seen.union(front))  # keeps the plan short


def cyclic(edges: DataFrame) -> DataFrame:
    """(comparison_id, id) of the changes that need themselves, at any distance; see graphs.cycle_nodes."""
    named = _kept(edges.select(*_ID, _node("id").alias("a"), _node("needs").alias("b")).distinct())
    nodes = graphs.cycle_nodes(named.select("a", "b"))
    return named.select(*_ID, F.col("a").alias("node")).distinct().join(merged(nodes), "node", "left_semi").select(*_ID)


def ordering_edges(edges: DataFrame) -> DataFrame:
    """edges without those between two changes that are in cycles: what comes after a cycle is ordered behind all of its members."""
    hit = _kept(cyclic(edges).withColumn("__a", F.lit(True)))
    told = edges.join(merged(hit), _ID, "left").join(merged(hit.select("comparison_id", F.col("id").alias("needs"), F.col("__a").alias("__b"))), ["comparison_id", "needs"], "left")
    return told.where("__a is null or __b is null").select(*_ID, "needs")


def to_manual(changes: DataFrame, ids: DataFrame) -> DataFrame:
    """changes with those of ids as MANUAL, of risk HIGH at least, under a new id; old_id keeps the old one."""
    hit = ids.select(*_ID, F.lit(True).alias("__hit")).distinct()
    out = changes.join(merged(hit), _ID, "left").withColumn("old_id", F.col("id"))
    h = F.col("__hit")
    out = out.withColumns({"kind": F.when(h, "MANUAL").otherwise(F.col("kind")), "risk": F.when(h & (F.col("risk") != "CRITICAL"), "HIGH").otherwise(F.col("risk")), "automation": F.when(h, "MANUAL_ONLY").otherwise(F.col("automation"))})
    return change_ids(out.drop("__hit", "id"))


def cycles_to_manual(changes: DataFrame, edges: DataFrame) -> DataFrame:
    return to_manual(changes, cyclic(edges))


def order_changes(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """changes with position from 1 on: what a change needs comes first; of the ready ones non-drops, then by rank (reversed for
    drops; unknown types last), key and id. What is in a cycle of edges, or needs one, comes last, by the same key. Needs that aren't
    among the changes are ignored.

    A heap orders each connected component of the edges in a task of its own; changes without edges need none. The order of one heap over a
    whole comparison merges the components' orders: it is the order by the greatest key so far in the component (keys are unique),
    then by place there. So positions come from a range sort, and no task holds a comparison."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))[F.col("object_type")], F.lit(len(RANKS)))
    drop = F.col("kind") == "DROP"
    key = ["grp", "rank", "object_key", "id"]
    keyed = _kept(changes.select("comparison_id", drop.cast("int").alias("grp"), F.when(drop, -rank).otherwise(rank).alias("rank"), "object_key", "id", _node("id").alias("node")))
    own = edges.select(_node("id").alias("a"), _node("needs").alias("b")).where("a <> b").distinct()
    own = own.join(merged(keyed.select(F.col("node").alias("a"))), "a", "left_semi").join(merged(keyed.select(F.col("node").alias("b"))), "b", "left_semi")
    own = _kept(own.select("a", "b"))
    parts = _kept(graphs.components(own))
    needs = own.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("needs"))
    linked = keyed.join(merged(parts), "node").join(merged(_kept(needs)), "node", "left")
    fields = {f.name: f.dataType for f in keyed.schema.fields}
    schema = T.StructType([T.StructField("node", T.StringType()), T.StructField("stuck", T.IntegerType()), T.StructField("place", T.LongType()), *(T.StructField(f"top_{c}", fields[c]) for c in key)])

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        known = {r.node: (r.grp, r.rank, r.object_key, r.id) for r in pdf.itertuples()}
        waits = {r.node: len(r.needs) if r.needs is not None else 0 for r in pdf.itertuples()}
        after: dict[str, list[str]] = {}
        for r in pdf.itertuples():
            for n in r.needs if r.needs is not None else ():
                after.setdefault(n, []).append(r.node)
        ready, out, top = [(known[n], n) for n, w in waits.items() if not w], [], None
        heapq.heapify(ready)
        while ready:
            k, node = heapq.heappop(ready)
            top = k if top is None else max(top, k)
            out.append((node, 0, len(out), *top))
            for n in after.get(node, ()):
                waits[n] -= 1
                if not waits[n]:
                    heapq.heappush(ready, (known[n], n))
        out += [(n, 1, 0, *known[n]) for n, w in waits.items() if w]
        return pd.DataFrame(out, columns=schema.fieldNames())

    placed = linked.groupBy("component").applyInPandas(order, schema)
    alone = keyed.join(merged(parts), "node", "left_anti").select("node", F.lit(0).alias("stuck"), F.lit(0).cast("long").alias("place"), *(F.col(c).alias(f"top_{c}") for c in key))
    rows = keyed.select("comparison_id", "id", "node").join(merged(placed.union(alone)), "node")
    sorts = [(c, True) for c in ("comparison_id", "stuck", *(f"top_{c}" for c in key), "place")]
    numbered = _kept(number_rows(rows, sorts).select(*_ID, "row_no"))
    first = _kept(numbered.groupBy("comparison_id").agg(F.min("row_no").alias("first")))
    numbered = numbered.join(merged(first), "comparison_id").select(*_ID, (F.col("row_no") - F.col("first") + 1).cast("int").alias("position"))
    return changes.join(merged(numbered), _ID)


def select_changes(changes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(comparison_id, id, state): SELECTED or BLOCKED for each wanted change; a manual one is left out, and one whose needs aren't
    all selected is blocked, over and over: a walk from those that need what isn't wanted."""
    able = changes.where("kind <> 'MANUAL' and automation <> 'MANUAL_ONLY'").select(*_ID)
    ok = _kept(wanted.select(*_ID).distinct().join(merged(able), _ID, "left_semi"))
    own = _kept(edges.select(*_ID, "needs").join(merged(ok), _ID, "left_semi"))
    roots = _kept(own.join(merged(ok.select("comparison_id", F.col("id").alias("needs"))), ["comparison_id", "needs"], "left_anti").select(*_ID).distinct())
    blocked = roots.union(needing(own, roots, ROUNDS * ROUNDS)).distinct().withColumn("s", F.lit(True))
    return ok.join(merged(blocked), _ID, "left").select(*_ID, F.when(F.col("s"), "BLOCKED").otherwise("SELECTED").alias("state"))


def selection_digest(selected: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(comparison_id, digest) over both fingerprints, the number of changes and their sorted ids."""
    ids = selected.groupBy("comparison_id").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    out = fingerprints.join(ids, "comparison_id", "left").withColumn("ids", F.coalesce("ids", F.expr("cast(array() as array<string>)")))
    return out.select("comparison_id", canonical_hash("selection-v1", "source_fingerprint", "target_fingerprint", F.size("ids").cast("string"), F.array_join("ids", "\n")).alias("digest"))


def filter_changes(changes: DataFrame, types: list[str] | None = None, risks: list[str] | None = None, automation: list[str] | None = None, state: str = "ALL", search: str | None = None) -> DataFrame:
    """The changes of the types, risks and automation levels (none given: all), by state (changes has selected), whose type or key holds
    the search text in any case."""
    for column, values in (("object_type", types), ("risk", risks), ("automation", automation)):
        if values:
            changes = changes.where(F.col(column).isin(*values))
    if state != "ALL":
        changes = changes.where(F.col("selected") if state == "SELECTED" else ~F.col("selected"))
    if search and search.strip():
        s = search.strip().lower()
        changes = changes.where(F.lower("object_key").contains(s) | F.lower("object_type").contains(s))
    return changes


def group_by_type(changes: DataFrame) -> DataFrame:
    """(comparison_id, object_type, n_changes, first_position), groups as they come in the plan."""
    return changes.groupBy("comparison_id", "object_type").agg(F.count("*").alias("n_changes"), F.min("position").alias("first_position"))


def drift_gate(expected: DataFrame, fresh: DataFrame) -> DataFrame:
    """(comparison_id, gate): READY, BLOCKED_INCOMPLETE or BLOCKED_DRIFT for a target read anew before its plan runs."""
    f = fresh.select("comparison_id", F.col("db_type").alias("fd"), F.col("schema_name").alias("fs"), F.col("fingerprint").alias("ff"), "complete")
    out = expected.join(f, "comparison_id", "left")
    same = (F.col("db_type") == F.col("fd")) & (F.col("schema_name") == F.col("fs")) & (F.col("fingerprint") == F.col("ff"))
    return out.select("comparison_id", F.when(~F.coalesce("complete", F.lit(False)), "BLOCKED_INCOMPLETE").when(~F.coalesce(same, F.lit(False)), "BLOCKED_DRIFT").otherwise("READY").alias("gate"))


def label_outcomes(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """steps (comparison_id, id, position, state) with state told for those behind the first that failed: SKIPPED_DEPENDENCY for those
    that need it, at any distance, unless it was cancelled, else SKIPPED_FAIL_FAST."""
    first = steps.where("state <> 'SUCCEEDED'").groupBy("comparison_id").agg(F.min_by(F.struct("position", "id", "state"), "position").alias("f"))
    hit = needing(edges, first.select("comparison_id", F.col("f.id").alias("id"))).withColumn("hit", F.lit(True))
    out = steps.join(first, "comparison_id", "left").join(merged(hit), _ID, "left")
    behind = F.col("position") > F.col("f.position")
    cancelled = F.col("f.state").isin("CANCELLED", "UNKNOWN_AFTER_CANCEL")
    return out.select(*_ID, "position", F.when(behind & F.col("hit") & ~cancelled, "SKIPPED_DEPENDENCY").when(behind, "SKIPPED_FAIL_FAST").otherwise(F.col("state")).alias("state"))


def render_changes(changes: DataFrame) -> DataFrame:
    """(comparison_id, id, sql, destructive) of changes (kind, object_type, schema_name, object_key, path, new_value, text): DROP of any
    object, and columns added, dropped, retyped, their nullability, defaults and comments. text is a column's or object's own
    clause. A manual change has no statement; its error says so."""
    t = qualify("schema_name", "object_key")
    column = F.regexp_extract("path", r"^columns\[([^\]]+)\]", 1)
    part = F.regexp_extract("path", r"^columns\[[^\]]+\]\.(\w+)$", 1)
    name, alter = quote_ident(column), F.concat(F.lit("ALTER TABLE "), t, F.lit(" "))
    col = F.concat(alter, F.lit("ALTER COLUMN "), name)
    kind = F.replace(F.col("object_type"), F.lit("_"), F.lit(" "))
    text: Column = F.when(F.col("kind") == "DROP", F.concat(F.lit("DROP "), kind, F.lit(" "), t, F.lit(";"))).when(F.col("kind") == "CREATE", F.concat("text", F.lit(";")))
    text = text.when((column != "") & (part == "") & F.col("text").isNotNull(), F.concat(alter, F.lit("ADD COLUMN "), name, F.lit(" "), "text", F.lit(";"))).when((column != "") & (part == ""), F.concat(alter, F.lit("DROP COLUMN "), name, F.lit(";")))
    text = text.when(part == "dataType", F.concat(col, F.lit(" TYPE "), "new_value", F.lit(";"))).when(part == "nullable", F.concat(col, F.when(F.col("new_value") == "true", " DROP NOT NULL;").otherwise(" SET NOT NULL;")))
    text = text.when(part == "normalizedDefault", F.concat(col, F.when(F.col("new_value").isNull(), " DROP DEFAULT;").otherwise(F.concat(F.lit(" SET DEFAULT "), "new_value", F.lit(";")))))
    text = text.when(part == "comment", F.concat(F.lit("COMMENT ON COLUMN "), t, F.lit("."), name, F.lit(" IS "), F.coalesce(F.concat(F.lit("'"), F.replace("new_value", F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")), F.lit(";")))
    bad = (F.col("kind") == "MANUAL") | (F.col("automation") == "MANUAL_ONLY")
    destructive = (F.col("automation") == "DESTRUCTIVE_OPT_IN") | F.col("kind").isin("DROP", "REPLACE") | part.isin("dataType", "normalizedDefault") | ((part == "nullable") & (F.col("new_value") != "true")) | ((column != "") & (part == "") & F.col("text").isNull())
    return changes.select("comparison_id", "id", F.when(~bad, text).alias("sql"), F.coalesce(destructive, F.lit(False)).alias("destructive"), F.when(bad, "MANUAL").when(text.isNull(), "NOT_RENDERED").alias("error"))
