"""Prefix operations over sorted tables, and list ranking: both without a task that holds a segment or a list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: A contracted list of so many elements is ranked in one task (40 bytes each).
HERE = 1 << 18


def exclusive_scan(df: DataFrame, segment: list[str], order: list, passed: list[str], xor: tuple[str, ...] = (), last: tuple[str, ...] = (), ranges: int | None = None, within: list | None = None) -> DataFrame:
    """For each row of df, over the rows before it in its segment by `order`: before, their count; before_X, the exclusive or of each
    column X of xor; previous_Y, the value of each column Y of last in the row just before (null in the first). All columns named are
    longs without nulls; passed ones are kept.

    Rows are sorted in ranges (of segment and order; `within` may sort a range finer), each range is scanned as it is written, and its
    first and last segment go into two rows of their own. From those, as many as ranges, follows what a segment brings over from earlier ranges."""
    spark = df.sparkSession
    kept = [*segment, *passed]
    values = list(dict.fromkeys([*xor, *last]))
    outs = ["before", *(f"before_{c}" for c in xor), *(f"previous_{c}" for c in last)]
    needed = list(dict.fromkeys([*kept, *values]))
    names = [*kept, *outs, "__kind", "__part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, first = TaskContext.get().partitionId(), None, None
        state = [0] * len(outs)

        def row(segment_key: tuple, states: list[int], kind: int) -> pa.RecordBatch:
            cells = {**dict.fromkeys(names, 0), **dict(zip(segment, segment_key, strict=True)), **dict(zip(outs, states, strict=True)), "__kind": kind, "__part": part}
            return pa.RecordBatch.from_arrays([pa.array([cells[c]], pa.int64()) for c in names], names)

        for batch in batches:
            n = len(batch)
            if not n:
                continue
            cols = {c: batch.column(c).to_numpy() for c in needed}
            change = np.zeros(n, bool)
            for c in segment:
                change[1:] |= cols[c][1:] != cols[c][:-1]
            now = tuple(int(cols[c][0]) for c in segment)
            if first is None:
                first = now
                yield row(first, state, 1)
            change[0] = now != key
            if change[0]:
                state = [0] * len(outs)
            starts = np.maximum.accumulate(np.where(change, np.arange(n), 0))
            head = np.cumsum(change) == 0
            out = [np.arange(n) - starts + head * state[0]]
            ends = [int(out[0][-1]) + 1]
            for c, s in zip(xor, state[1:], strict=False):
                through = np.concatenate([[0], np.bitwise_xor.accumulate(cols[c])])
                base = np.where(head, np.int64(s), 0)
                out.append(through[:-1] ^ through[starts] ^ base)
                ends.append(int(out[-1][-1] ^ cols[c][-1]))
            for c, s in zip(last, state[1 + len(xor) :], strict=False):
                before = np.concatenate([[s], cols[c][:-1]])
                out.append(np.where(change, 0, before))
                ends.append(int(cols[c][-1]))
            state, key = ends, tuple(int(cols[c][-1]) for c in segment)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in [*(cols[c] for c in kept), *out, np.zeros(n, np.int64), np.full(n, part)]], names)
        if first is not None:
            yield row(key, state, 2)

    wanted = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(wanted, *segment, *order).sortWithinPartitions(*segment, *(within or order)).select(*needed)
    scanned = materialize(sorted_.mapInArrow(run, ", ".join(f"`{c}` long" for c in names)), "scanned")
    ends = scanned.where("__kind > 0").select("__part", "__kind", *segment, *outs).collect()  # two rows for each range
    brought, key, state = [], None, None
    for head, tail in _pairs(ends):
        own, after = tuple(head[c] for c in segment), tuple(tail[c] for c in segment)
        if own == key:
            brought.append((head["__part"], *own, *state))
            state = _joined(state, [tail[c] for c in outs], len(xor)) if after == own else [tail[c] for c in outs]
        else:
            state = [tail[c] for c in outs]
        key = after
    rows = scanned.where("__kind = 0")
    if brought:
        types = T.StructType([T.StructField(c, T.LongType()) for c in ["__part", *segment, *(f"__{c}" for c in outs)]])
        rows = rows.join(F.broadcast(spark.createDataFrame(brought, types)), ["__part", *segment], "left")
        more = {c: F.col(c).bitwiseXOR(F.coalesce(f"__{c}", F.lit(0))) for c in outs[1 : 1 + len(xor)]}
        more |= {c: F.when((F.col("before") == 0) & F.col(f"__{c}").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)) for c in outs[1 + len(xor) :]}
        rows = rows.withColumns(more | {"before": F.col("before") + F.coalesce("__before", F.lit(0))})
    nulls = {c: F.when(F.col("before") > 0, F.col(c)) for c in outs[1 + len(xor) :]}
    return rows.withColumns(nulls).select(*kept, *outs)


def _pairs(ends: list) -> list[tuple]:
    by = {(r["__part"], r["__kind"]): r for r in ends}
    return [(by[p, 1], by[p, 2]) for p in sorted({r["__part"] for r in ends})]


def _joined(a: list[int], b: list[int], xors: int) -> list[int]:
    return [a[0] + b[0], *(x ^ y for x, y in zip(a[1 : 1 + xors], b[1 : 1 + xors], strict=True)), *b[1 + xors :]]


def list_rank(links: DataFrame, weights: list[str], here: int = HERE) -> DataFrame:
    """(id, before_W for each weight W): the sums of the weights of all elements before each in its list. links: id, next (null at a
    list's end; else the id of a row) and the weights, all longs.

    Lists are contracted round by round: an element whose coin is tails joins the element before it if that has heads, so that about a
    quarter goes each time. What is left is ranked in one task when it has `here` elements or fewer, a fixed bound; then the elements that went are ranked
    from those that took them in, the last round first. All tables together are linear in the list."""
    total = [f"__{w}" for w in weights]
    current, gone, round_ = links.select("id", "next", *weights), [], 0
    # Single elements have nothing to be ranked by.
    while (left := current.agg(F.count("*").alias("n"), F.count("next").alias("links")).first()).n > here and left.links:
        coin = lambda c, r=round_: F.xxhash64(F.lit(r), F.col(c)).bitwiseAND(1)
        takers = current.where((coin("id") == 1) & (coin("next") == 0)).select(F.col("id").alias("__by"), F.col("next").alias("__id"), *(F.col(w).alias(t) for w, t in zip(weights, total, strict=True)))
        rest = current.where((coin("id") == 1) & F.coalesce(coin("next") == 1, F.lit(True)) | F.col("next").isNull() & (coin("id") == 1))
        met = materialize(current.where(coin("id") == 0).join(takers, F.col("id") == F.col("__id"), "left").drop("__id"), "met")
        taken = met.where("__by is not null")
        gone.append(taken.select("id", F.col("__by").alias("by"), *total))
        merged = taken.select(F.col("__by").alias("id"), "next", *((F.col(w) + F.col(t)).alias(w) for w, t in zip(weights, total, strict=True)))
        current = materialize(rest.union(merged).union(met.where("__by is null").select("id", "next", *weights)), "contracted")
        round_ += 1

    befores = [f"before_{w}" for w in weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            whole = pa.Table.from_batches(held).sort_by("id")
            ids, after = whole["id"].to_numpy(), whole["next"].fill_null(-1).to_numpy()
            at = np.minimum(np.searchsorted(ids, after), len(ids) - 1)
            sums = prefix_sums(np.where(whole["next"].is_valid().to_numpy() & (ids[at] == after), at, -1), [whole[w].to_numpy() for w in weights])[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(s - whole[w].to_numpy()) for s, w in zip(sums, weights, strict=True))], ["id", *befores])

    if left.links:
        ranks = current.coalesce(1).mapInArrow(run, ", ".join(f"`{c}` long" for c in ["id", *befores]))
    else:
        ranks = current.select("id", *(F.lit(0).cast("long").alias(b) for b in befores))
    for taken in reversed(gone):
        ranks = materialize(ranks, "ranks")
        rank = ranks.withColumnRenamed("id", "by")
        ranks = ranks.union(taken.join(rank, "by").select("id", *((F.col(b) + F.col(t)).alias(b) for b, t in zip(befores, total, strict=True))))
    return materialize(ranks, "ranks")


def prefix_sums(after: np.ndarray, weights: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Of lists given by the place of each element's next one (-1: none): sums of the weights up to each element, itself included, and the place of its
    list's first element; by doubling."""
    n = len(after)
    before = np.full(n + 1, n, np.int64)
    some = np.flatnonzero(after >= 0)
    before[after[some]] = some
    sums, first = [np.concatenate([w, [0]]).astype(np.int64) for w in weights], np.where(before == n, np.arange(n + 1), before)
    while (before < n).any():
        sums = [s + s[before] for s in sums]
        before = before[before]
        first = first[first]
    return [s[:n] for s in sums], first[:n]
