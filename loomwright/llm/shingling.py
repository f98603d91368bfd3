"""Sets of word shingles, and exact Jaccard similarity among the members of candidate groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import condensed, connected_components, materialize, payload
from .features import LOWER, words
from .tokens import SliceHasher, mixed

SHINGLE = 5


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words of each run of words, and the runs' bounds in them."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(int(ends[-1])) + np.repeat(bounds[:-1] - ends[:-1], counts)
    h = np.zeros(len(at), np.uint64)
    for i in range(size):
        h = mixed(h + hashes[at + i])
    return h, ends


def text_shingles(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text; a text of fewer words than a shingle has is one, of its words' hashes."""
    data, offsets = payload(batch.column("text"))
    lowered = LOWER[data]
    starts, ends, owner = words(lowered, offsets)
    hashes = SliceHasher(lowered)(starts, ends)
    bounds = np.searchsorted(owner, np.arange(len(batch) + 1))
    h, edges = shingles(hashes, bounds)
    out = []
    for i in range(len(batch)):
        own = h[edges[i] : edges[i + 1]]
        if not len(own):
            whole = np.zeros(1, np.uint64)
            for x in hashes[bounds[i] : bounds[i + 1]]:
                whole = mixed(whole + x)
            own = whole
        out.append(np.unique(own))
    return out


def _similar(front: list[np.ndarray], others: list[np.ndarray], least: float) -> np.ndarray:
    """For each of others, the first of front that is similar to it, or -1."""
    out = np.full(len(others), -1)
    if not others:
        return out
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for i, x in enumerate(front):
        todo = (out < 0) & (np.minimum(sizes, len(x)) >= least * np.maximum(sizes, len(x)))
        if not todo.any():
            continue
        at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
        common = np.add.reduceat(x[at] == flat, starts)
        # common / (sizes + len(x) - common) >= least, without a division
        out[todo & (common >= least * (sizes + len(x) - common) - 1e-9)] = i
    return out


#: Sets that share one of their rarest shingles with so many others are searched, not paired.
PAIRED = 32


def _prefixes(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, token, narrow) of the shingles by which similar sets meet. With each set's shingles ordered from the rarest on,
    two sets of Jaccard similarity `least` share one of the first n - ceil(least n) + 1 of the larger set that is among the
    first n - ceil(2 least n / (1 + least)) + 1 of the smaller (prefix filter); narrow marks the latter."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((token, count[token], owner))
    owner, token = owner[order], token[order]
    place, size = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes[owner]
    wide = place < size - np.ceil(least * size - 1e-9) + 1
    narrow = place < size - np.ceil(2 * least / (1 + least) * size - 1e-9) + 1
    keep = wide & (count[token] > 1)
    return owner[keep], token[keep], narrow[keep]


def _verified(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    """Which pairs of sets are similar."""
    out = np.zeros(len(a), bool)
    sizes = np.array([len(x) for x in sets])
    near = np.flatnonzero(np.minimum(sizes[a], sizes[b]) >= least * np.maximum(sizes[a], sizes[b]))
    for i in range(0, len(near), 4096):
        some = near[i : i + 4096]
        both = np.concatenate([np.repeat(np.arange(len(some)), sizes[a[some]]), np.repeat(np.arange(len(some)), sizes[b[some]])])
        flat = np.concatenate([*(sets[k] for k in a[some].tolist()), *(sets[k] for k in b[some].tolist())])
        order = np.lexsort((flat, both))
        both, flat = both[order], flat[order]
        common = np.bincount(both[1:][(both[1:] == both[:-1]) & (flat[1:] == flat[:-1])], minlength=len(some))
        out[some] = common >= least * (sizes[a[some]] + sizes[b[some]] - common) - 1e-9
    return out


def _linked(ids: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Links that connect what all similar pairs connect, by the sets' prefixes."""
    if len(ids) < 2:
        return [], []
    owner, token, narrow = _prefixes(sets, least)
    order = np.lexsort((owner, token))
    owner, token, narrow = owner[order], token[order], narrow[order]
    opens = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    many = np.diff(np.append(opens, len(token)))
    large = np.flatnonzero(many > PAIRED)
    if (np.add.reduceat(narrow.astype(np.int64), opens)[large] * many[large]).sum() > len(ids) ** 2 if len(large) else False:
        # So many share their rarest shingles that all pairs are less work.
        firsts, seconds = [], []
        _search(list(range(len(ids))), [True] * len(ids), ids, sets, least, firsts, seconds)
        return firsts, seconds
    small = np.repeat(many <= PAIRED, many)
    x, y = [], []
    for d in range(1, PAIRED):  # the d-th next of the same shingle
        hit = np.flatnonzero((token[d:] == token[:-d]) & small[d:] & (narrow[d:] | narrow[:-d]))
        if not len(hit):
            break
        x.append(owner[hit])
        y.append(owner[hit + d])
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if x:
        pairs = np.unique(np.concatenate(x) * len(ids) + np.concatenate(y))
        a, b = pairs // len(ids), pairs % len(ids)
        same = _verified(a, b, sets, least)
        a, b = a[same], b[same]
    firsts, seconds = ids[a].tolist(), ids[b].tolist()
    for g in large.tolist():
        part = slice(opens[g], opens[g] + many[g])
        _search(owner[part].tolist(), narrow[part].tolist(), ids, sets, least, firsts, seconds)
    return firsts, seconds


def _search(members: list[int], narrow: list[bool], ids: np.ndarray, sets: list[np.ndarray], least: float, a: list[int], b: list[int]) -> None:
    """Adds links among many sets of one shingle: a search from each narrow one that is not yet reached."""
    short = dict(zip(members, narrow, strict=True))
    left = [*(m for m in members if short[m]), *(m for m in members if not short[m])]
    while len(left) > 1 and short[left[0]]:
        front, left = left[:1], left[1:]
        while front and left:
            near = _similar([sets[i] for i in front[:16]], [sets[i] for i in left], least).tolist()
            hit = [i for i, n in zip(left, near, strict=True) if n >= 0]
            a += [int(ids[front[n]]) for n in near if n >= 0]
            b += [int(ids[i]) for i in hit]
            left = [i for i, n in zip(left, near, strict=True) if n < 0]
            front = front[16:] + hit


def similar_members(members: DataFrame, sets: DataFrame, least: float, chunk: int) -> DataFrame:
    """(a, b): links that connect what all pairs of members of a group connect whose sets have a Jaccard similarity of
    `least` or more. members: (x, band), a member and its group; sets: (x, set), 64-bit hashes in order.

    Each member is compared with the least of its groups first, once for however many groups have that one. That connects
    most groups; only those with members that are still apart are compared in full. So the work on a group of n near copies
    grows with n."""
    return condensed(members.sparkSession, lambda: _similar_links(members, sets, least, chunk), "similar")


def _similar_links(members: DataFrame, sets: DataFrame, least: float, chunk: int) -> DataFrame:
    members = materialize(members.select("x", "band").distinct(), "members")
    least_of = materialize(members.groupBy("band").agg(F.min("x").alias("rep"), F.count("*").alias("n")).where("n > 1"), "least")
    pairs = materialize(members.join(least_of, "band").where("x <> rep").select("x", "rep").distinct(), "pairs")
    close = materialize(_near_one(pairs, sets, least, chunk), "near")
    nodes = connected_components(close)
    placed = members.join(nodes, members["x"] == nodes["node"], "left").select("x", "band", F.coalesce("component", "x").alias("c"))
    apart = placed.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low < high").select("band", "n")
    rest = materialize(members.join(materialize(apart, "apart"), "band"), "rest")
    return close.union(_in_full(rest, sets, least, chunk)).distinct()


def _near_one(pairs: DataFrame, sets: DataFrame, least: float, chunk: int) -> DataFrame:
    """(a, b): the pairs (x, rep) whose sets are similar. A rep's many partners are dealt to chunks, each with the rep's set once."""
    sizes = materialize(pairs.groupBy("rep").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), "sizes")
    dealt = pairs.join(sizes, "rep").select("x", "rep", F.pmod(F.xxhash64("x"), F.col("chunks")).cast("int").alias("part"))
    firsts = sizes.select(F.col("rep").alias("x"), "rep", F.explode(F.expr("sequence(0, chunks - 1)")).alias("part"))
    rows = firsts.withColumn("behind", F.lit(0)).union(dealt.withColumn("behind", F.lit(1))).join(sets, "x")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, front = None, None
        for batch in batches:
            a, b, held = [], [], []
            data, bounds = payload(batch.column("set"))
            data, bounds = data.view(np.uint64), bounds // 8

            def settle() -> None:
                for (x, _), hit in zip(held, _similar([front], [s for _, s in held], least).tolist(), strict=True):
                    if hit == 0:
                        a.append(name[0])
                        b.append(x)
                held.clear()

            keys = zip(batch.column("rep").to_pylist(), batch.column("part").to_pylist(), batch.column("x").to_pylist(), batch.column("behind").to_pylist(), strict=True)
            for i, (rep, part, x, behind) in enumerate(keys):
                if (rep, part) != name:
                    settle()
                    name, front = (rep, part), None
                if not behind:
                    front = data[bounds[i] : bounds[i + 1]].copy()
                elif front is not None:
                    held.append((x, data[bounds[i] : bounds[i + 1]]))
            settle()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("rep", "part").sortWithinPartitions("rep", "part", "behind").select("rep", "part", "x", "behind", "set").mapInArrow(compare, "a long, b long")


def _in_full(members: DataFrame, sets: DataFrame, least: float, chunk: int) -> DataFrame:
    """(a, b) of all members (x, band, n), n the group's size. A large group is dealt to chunks, and each pair of chunks is
    compared in a task's group of its own."""
    parts = members.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).withColumn("own", F.pmod(F.xxhash64("x"), F.col("chunks")).cast("int"))
    parts = parts.select("x", "band", "own", F.explode(F.expr("sequence(0, chunks - 1)")).alias("other"))
    group = ["band", "i", "j"]
    parts = parts.select("x", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(sets, "x")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, held = None, [], []
        for batch in batches:
            a, b = [], []
            keys = zip(*(batch.column(c).to_pylist() for c in group), strict=True)
            for key, x, s in zip(keys, batch.column("x").to_pylist(), batch.column("set").to_pylist(), strict=True):
                if key != name:
                    more = _linked(np.array(ids, np.int64), held, least)
                    a += more[0]
                    b += more[1]
                    name, ids, held = key, [], []
                ids.append(x)
                held.append(np.frombuffer(s, np.uint64))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a, b = _linked(np.array(ids, np.int64), held, least)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return parts.repartition(*group).sortWithinPartitions(*group, "x").mapInArrow(compare, "a long, b long")
