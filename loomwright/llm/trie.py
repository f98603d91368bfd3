"""Prefix trie of conversations, with subtree sums by the Euler tour technique.

A node is a distinct sequence of first turns, known by its depth and 128 bits of hash, and named by its smallest member and its depth. Each
node has an enter arc and an exit arc; the successor of an arc follows from children and siblings alone. The tour is ranked as a list,
with a leaf's one and a node's saving as weights, so that each arc gets its place and the prefix sums there; what lies between a
node's two arcs is its subtree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .scans import HERE, exclusive_scan, list_rank, prefix_sums

#: Nodes that a task contracts at once, about 200 bytes each.
NODES = 1 << 20


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, x, y, points, before) per row of conversations (conv_id, turn, role, text) with a conv_id: 128 bits of hash of role and text, the
    text's code points, and how many turns of the conversation come before. The order is by turn (null first), then role, then text; null role
    and text are empty. Texts are shuffled once."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.xxhash64(F.lit(1), role, text).alias("x"), F.xxhash64(F.lit(2), role, text).alias("y"), F.length(text).cast("long").alias("points"))
    # Bounds of ranges are drawn from short keys; a range is sorted by whole texts.
    turn = F.asc_nulls_first("turn")
    return exclusive_scan(rows, ["conv_id"], [turn, "role", F.left("text", F.lit(64))], ["x", "y", "points"], within=[turn, "role", "text"])


def shared_starts(turns: DataFrame, most: int = 6, stride: int = 100) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared starts: turns (as of numbered_turns) of each conversation c after the first h = crc32(decimal c) % most, behind the
    first h turns of conversation c - c % stride (all if it has fewer, none if there is none). Returns (conv_id, total, and others) per
    conversation and (conv_id, depth from 1 on, x, y, points, ends) per turn."""
    h, base = F.crc32(F.col("conv_id").cast("string")) % most, F.col("conv_id") - F.col("conv_id") % stride
    heads = materialize(turns.where((F.col("before") < most - 1) & (F.col("conv_id") == base)), "heads")
    counted = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": h, "base": base}), "convs")
    known = materialize(heads.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("b")), "bases")
    shared = F.least("h", F.coalesce("b", F.lit(0)))
    convs = materialize(counted.join(known, "base", "left").select("conv_id", "base", "h", shared.alias("shared"), (shared + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "convs")
    first = convs.join(heads.select(F.col("conv_id").alias("base"), "x", "y", "points", "before"), "base").where("before < h")
    first = first.select("conv_id", (F.col("before") + 1).alias("depth"), "x", "y", "points", "total")
    own = turns.where(F.col("before") >= h).join(convs, "conv_id")
    own = own.select("conv_id", (F.col("before") - F.col("h") + F.col("shared") + 1).alias("depth"), "x", "y", "points", "total")
    return convs, first.union(own).withColumn("ends", (F.col("depth") == F.col("total")).cast("long")).drop("total")


def _local_lists(nodes: DataFrame, ranges: int) -> DataFrame:
    """The arcs (kind 0: enter, 1: exit) of nodes, each with its list in its range of nodes (part and place of the first arc), and the sums up to it there; the
    last arc of such a list has the arc that it goes on to."""
    kept = ["parent_conv_id", "n_convs", "n_children"]
    names = ["conv_id", "depth", "kind", *kept, "own_leaf", "list", "n", "leaves", "saved", "head", "tail", "to_conv", "to_depth", "to_kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        at = lambda c, none: whole[c].fill_null(none).to_numpy()
        conv, depth, m = at("conv_id", 0), at("depth", 0), len(whole)
        has_child, has_next, has_parent = (whole[c].is_valid().to_numpy() for c in ("last_child", "sibling", "parent_conv_id"))
        leaf, saved = (~has_child).astype(np.int64), at("own_saved", 0)

        def by_arc(enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
            return np.stack([enter, leave], 1).ravel()

        to_conv = by_arc(np.where(has_child, at("last_child", 0), conv), np.where(has_next, at("sibling", 0), at("parent_conv_id", 0)))
        to_depth = by_arc(np.where(has_child, depth + 1, depth), np.where(has_next, depth, depth - 1))
        to_kind = by_arc(np.where(has_child, 0, 1), np.where(has_next, 0, 1))
        goes_on = by_arc(np.ones(m, bool), has_next | has_parent)
        # The nodes of a name are a path, so their depths here are consecutive.
        low, high = np.searchsorted(conv, to_conv, "left"), np.searchsorted(conv, to_conv, "right")
        place = low + to_depth - depth[np.minimum(low, m - 1)]
        here = goes_on & (place >= low) & (place < high)
        after = np.where(here, 2 * place + to_kind, -1)
        zeros = np.zeros(m, np.int64)
        (n, leaves, save), first = prefix_sums(after, [np.ones(2 * m, np.int64), by_arc(leaf, zeros), by_arc(saved, zeros)])
        part = TaskContext.get().partitionId()
        values = {
            "conv_id": np.repeat(conv, 2), "depth": np.repeat(depth, 2), "kind": np.tile([0, 1], m),
            "own_leaf": np.repeat(leaf, 2), "list": (part << 32) + first, "n": n, "leaves": leaves, "saved": save,
            "head": (first == np.arange(2 * m)).astype(np.int64), "tail": (after < 0).astype(np.int64),
            "to_conv": to_conv, "to_depth": to_depth,
        }
        arrays = {c: pa.array(v, pa.int64()) for c, v in values.items()}
        arrays["to_kind"] = pa.array(to_kind, pa.int64(), mask=~goes_on)
        twice = pa.array(np.repeat(np.arange(m), 2))
        arrays |= {c: whole[c].combine_chunks().take(twice) for c in kept}
        for start in range(0, 2 * m, 1 << 16):
            yield pa.RecordBatch.from_arrays([arrays[c].slice(start, 1 << 16) for c in names], names)

    sorted_ = nodes.repartitionByRange(ranges, "conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    return sorted_.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _subtrees(nodes: DataFrame, here: int) -> DataFrame:
    """nodes (conv_id, depth, parent_conv_id, sibling, last_child, n_convs, n_children, own_saved) with the sums of their subtrees.

    Ranges of nodes by name hold whole paths, so most arcs are joined to lists of their range first; only those lists are ranked."""
    spark = nodes.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // NODES))
    arcs = materialize(_local_lists(nodes, ranges), "arcs")
    heads = arcs.where("head = 1").select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), F.col("kind").alias("to_kind"), F.col("list").alias("next"))
    lists = arcs.where("tail = 1").select("list", "to_conv", "to_depth", "to_kind", "n", "leaves", "saved").join(heads, ["to_conv", "to_depth", "to_kind"], "left")
    ranks = list_rank(materialize(lists.select(F.col("list").alias("id"), "next", "n", "leaves", "saved"), "lists"), ["n", "leaves", "saved"], here)
    placed = arcs.join(ranks.withColumnRenamed("id", "list"), "list")
    enter, leave = (lambda c, k=k: F.max(F.when(F.col("kind") == k, F.col(c) + F.col(f"before_{c}"))) for k in (0, 1))
    first = lambda c: F.max(c).alias(c)
    sums = placed.groupBy("conv_id", "depth").agg(
        first("parent_conv_id"), first("n_convs"), first("n_children"), enter("n").alias("enter"), leave("n").alias("leave"),
        (leave("leaves") - enter("leaves") + F.max("own_leaf")).alias("n_leaves"), (leave("saved") - F.max(F.when(F.col("kind") == 0, F.col("saved") + F.col("before_saved")))).alias("below"),
    )
    own = nodes.select("conv_id", "depth", "own_saved")
    return sums.join(own, ["conv_id", "depth"]).withColumn("saved_tokens", F.col("below") + F.col("own_saved")).drop("below", "own_saved")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) for each node of ends (conv_id, depth, member): the hash of its members, ascending and comma-joined.

    Members are sorted in ranges and joined to pieces of text there. A hash takes its input in order, so the pieces of one node go through one task, as
    a stream of which it holds one piece at a time."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            conv, depth = batch.column("conv_id").to_numpy(), batch.column("depth").to_numpy()
            cuts = np.flatnonzero((conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])) + 1
            starts = np.concatenate([[0], cuts])
            texts = pc.cast(batch.column("member"), pa.string()).to_pylist()
            pieces = [",".join(texts[a:b]).encode() for a, b in zip(starts.tolist(), [*cuts.tolist(), n], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(conv[starts]), pa.array(depth[starts]), pa.array(np.full(len(starts), part)), pa.array(np.arange(seq, seq + len(starts))), pa.array(pieces, pa.binary())], ["conv_id", "depth", "part", "seq", "piece"])
            seq += len(starts)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for *now, piece in zip(batch.column("conv_id").to_pylist(), batch.column("depth").to_pylist(), batch.column("piece"), strict=True):
                if now == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                state.update(memoryview(piece.as_buffer()))
            if len(out) >= 1 << 12:
                yield rows(out)
                out = []
        if key is not None:
            yield rows([*out, (*key, state.hexdigest())])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        a, b, c = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], ["conv_id", "depth", "ends_sha256"])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "depth", "member"]
    pieces = materialize(ends.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(join, "conv_id long, depth long, part long, seq long, piece binary"), "pieces")
    return pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part", "seq").select("conv_id", "depth", "piece").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, here: int = HERE) -> DataFrame:
    """One row for each node of the trie over convs (conv_id, total turns) and turns (conv_id, depth from 1 to total without gaps, x, y: 128 bits that tell
    role and text, points: what the turn saves, ends: 1 in the last turn, else 0): conv_id, smallest member; depth; parent_conv_id, null at the root; n_convs;
    n_children; enter and leave, the places of its arcs in the tour; n_leaves; saved_tokens; ends_sha256.

    conv_id is unique in convs and without nulls. A conversation without turns is a member of the root, and equal conversations share all
    nodes; no conversation and no node is gathered, however many turns, members or children it has. No conversations: no rows."""
    own = turns.withColumns({"u": F.xxhash64("depth", "x", "y"), "v": F.xxhash64("y", "x", "depth")})
    paths = exclusive_scan(own, ["conv_id"], ["depth"], ["depth", "u", "v", "points", "ends"], xor=("u", "v"))
    key = {"kx": F.col("before_u").bitwiseXOR(F.col("u")), "ky": F.col("before_v").bitwiseXOR(F.col("v"))}
    paths = paths.withColumns(key).withColumnsRenamed({"before_u": "px", "before_v": "py"})
    nodes = paths.groupBy("depth", "kx", "ky").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("points").alias("points"), F.max("px").alias("px"), F.max("py").alias("py"))
    root = convs.agg(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("kx"), F.lit(0).cast("long").alias("ky"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("points"), F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py"))
    nodes = materialize(nodes.union(root.where("n_convs > 0")), "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("kx").alias("px"), F.col("ky").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    saved = ((F.col("n_convs") - 1) * F.col("points")).alias("own_saved")
    child = nodes.where("depth > 0").join(parents, ["depth", "px", "py"]).select("depth", "parent_conv_id", "conv_id", "n_convs", saved)
    tree = exclusive_scan(child, ["depth", "parent_conv_id"], ["conv_id"], ["conv_id", "n_convs", "own_saved"], last=("conv_id",)).withColumnRenamed("previous_conv_id", "sibling").drop("before")
    kids = tree.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"), F.max("conv_id").alias("last_child"))
    top = nodes.where("depth = 0").select("depth", F.lit(None).cast("long").alias("parent_conv_id"), "conv_id", "n_convs", saved, F.lit(None).cast("long").alias("sibling"))
    whole = tree.select("depth", "parent_conv_id", "conv_id", "n_convs", "own_saved", "sibling").union(top).join(kids, ["depth", "conv_id"], "left")
    whole = materialize(whole.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "tree")
    ends = paths.where("ends = 1").select("depth", "kx", "ky", F.col("conv_id").alias("member")).union(convs.where("total = 0").select(*(F.lit(0).cast("long").alias(c) for c in ("depth", "kx", "ky")), "conv_id"))
    ends = ends.join(nodes.select("depth", "kx", "ky", "conv_id"), ["depth", "kx", "ky"]).select("conv_id", "depth", "member")
    found = _subtrees(whole, here).join(_end_digests(ends), ["conv_id", "depth"], "left")
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def conversation_trie(conversations: DataFrame, here: int = HERE) -> DataFrame:
    """prefix_trie of conversations (conv_id, turn, role, text; further columns are left out) rebuilt on shared starts. Null conv_ids are
    left out; repeated rows are turns of their own; whole texts of any length are hashed in place and shuffled once, to be ordered."""
    convs, turns = shared_starts(numbered_turns(conversations))
    return prefix_trie(convs.select("conv_id", "total"), turns, here)
