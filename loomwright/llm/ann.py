"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives a vector a string of 64 bits, the sides of random hyperplanes it lies on, and keeps the strings of a block of
vectors as a sorted array with the vectors' places. A query descends each tree by binary search to the strings that share
the longest prefix with its own, and then ascends in all trees at once, a bit at a time: the strings that share x bits are
a run of the array, and what a run adds to the one before is compared exactly. A query stops ascending where the
strings seen so far hold a vector as near as its k-th best with the recall asked for: at cosine s a bit agrees with chance
p = 1 - acos(s)/pi, so some tree agrees on x bits with chance 1 - (1 - p**x)**trees. The k-th best found is no nearer
than the true one, so the recall is at least that. Vectors are dealt to blocks once; queries go to every block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TREES, BITS = 24, 64
RECALL = 0.97
#: About so many vectors are in a block, whose forest a task holds in memory.
BLOCK = 8192
#: So many queries of a block are answered at once.
QUERIES = 256
#: Pairs that are compared at once.
PAIRS = 1 << 16
#: Equal vectors are dealt so many ways before their ids are cut to the smallest.
SALTS = 64


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    """(rows, size) in double precision, shorter ones filled up with zeros."""
    data = np.zeros((len(column), size))
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    data[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy(zero_copy_only=False)
    return data


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, size)


def distinct_vectors(vectors: DataFrame, size: int, keep: int) -> DataFrame:
    """(rep, v, ids): each distinct vector as bytes, with its `keep` smallest ids; rep is the smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("embedding"), size) + 0.0  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "v"])

    rows = vectors.mapInArrow(run, "vec_id long, v binary").withColumn("salt", F.pmod("vec_id", F.lit(SALTS)))
    rank = F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))
    few = rows.distinct().withColumn("rank", rank).where(F.col("rank") <= keep)
    ids = few.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, keep).alias("ids"))
    return ids.select(F.element_at("ids", 1).alias("rep"), "v", "ids")


class Forest:
    """Sorted arrays of hash strings over the rows of x, one for each tree."""

    def __init__(self, x: np.ndarray, trees: int, recall: float):
        self.x, self.norm, self.trees, self.recall = x, np.linalg.norm(x, axis=1), trees, recall
        self.planes = np.random.default_rng(17).standard_normal((x.shape[1], trees * BITS)).astype(np.float32)
        bits = self.strings(x)
        self.places = np.argsort(bits, axis=0, kind="stable")
        self.sorted = [bits[self.places[:, t], t] for t in range(trees)]

    def strings(self, v: np.ndarray) -> np.ndarray:
        """(rows, trees): the bit strings as numbers."""
        out, weight = np.empty((len(v), self.trees), np.uint64), np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        for at in range(0, len(v), 512):
            sides = (v[at : at + 512].astype(np.float32) @ self.planes > 0).reshape(-1, self.trees, BITS)
            out[at : at + 512] = (sides * weight).sum(2, dtype=np.uint64)
        return out

    def longest(self, bits: np.ndarray) -> np.ndarray:
        """The bits that each query has in common with its nearest string of any tree."""
        out = np.zeros(len(bits), np.int64)
        for t, strings in enumerate(self.sorted):
            at = np.searchsorted(strings, bits[:, t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(strings) - 1)):
                # The highest differing bit, found by halves.
                differs, common = strings[near] ^ bits[:, t], np.zeros(len(bits), np.int64)
                none = differs == 0
                for width in (32, 16, 8, 4, 2, 1):
                    clear = differs >> np.uint64(BITS - width) == 0
                    common += np.where(clear, width, 0)
                    differs = np.where(clear, differs << np.uint64(width), differs)
                out = np.maximum(out, np.where(none, BITS, common))
        return out

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, cosine): the candidates met that may be among a query's k + 1 nearest, ties included."""
        bits, n = self.strings(q), len(self.x)
        norm, level = np.linalg.norm(q, axis=1), self.longest(bits)
        low, high = (np.zeros((self.trees, len(q)), np.int64) for _ in range(2))
        seen, compared, kth = np.zeros((len(q), n), bool), np.zeros((len(q), n), bool), np.full(len(q), -np.inf)
        found, live, fresh = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.arange(len(q)), True
        while len(live):
            # The runs of the strings that share `level` bits, and what they add to the runs of one bit more.
            keep = np.where(level[live] > 0, ~np.uint64(0) << (np.uint64(BITS) - np.maximum(level[live], 1).astype(np.uint64)), np.uint64(0))
            for t, strings in enumerate(self.sorted):
                prefix = bits[live, t] & keep
                a, z = np.searchsorted(strings, prefix), np.searchsorted(strings, prefix | ~keep, "right")
                b, y = (low[t, live], high[t, live]) if not fresh else (a, a)
                for start, end in ((a, b), (y, z)):
                    size = np.maximum(end - start, 0)
                    ends = np.cumsum(size)
                    where = self.places[np.arange(int(ends[-1])) + np.repeat(start - (ends - size), size), t]
                    seen[np.repeat(live, size), where] = True
                low[t, live], high[t, live] = a, z
            fresh = False
            asks, place = np.nonzero(seen[live] & ~compared[live])
            asks = live[asks]
            compared[asks, place] = True
            score = np.empty(len(asks))
            for at in range(0, len(asks), PAIRS):
                some = slice(at, at + PAIRS)
                score[some] = np.einsum("ij,ij->i", q[asks[some]], self.x[place[some]]) / (norm[asks[some]] * self.norm[place[some]])
            near = score >= kth[asks]
            found = tuple(np.concatenate(x) for x in zip(found, (asks[near], place[near], score[near]), strict=True))
            order = np.lexsort((-found[2], found[0]))
            found = tuple(x[order] for x in found)
            first = np.searchsorted(found[0], np.arange(len(q)))
            count = np.diff(np.append(first, len(found[0])))
            enough = count > k
            kth[enough] = found[2][first[enough] + k]
            stays = found[2] >= kth[found[0]]
            found = tuple(x[stays] for x in found)
            p = np.clip(1 - np.arccos(np.clip(kth[live], -1, 1)) / np.pi, 0, 1)
            hold = np.where(np.isfinite(kth[live]), 1 - (1 - p ** level[live]) ** self.trees, 0.0)
            on = (hold < self.recall) & (level[live] > 0)
            live = live[on]
            level[live] -= 1
        return found


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id of queries the k vectors of `vectors` (vec_id, embedding) with
    the largest cosine found, in double precision, nearest first, ties to smaller ids; a vector never finds its own row.

    Queries are ids of vectors. Null ids, and vectors that are null, empty, zero or hold null or non-finite components,
    take no part. Shorter vectors are filled up with zeros. With fewer candidates than k, all are returned. Repeated
    rows count once, further columns are left out, and empty tables give no rows."""
    spark = vectors.sparkSession
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda c: c != 0))
    size = good.agg(F.max(F.size("embedding"))).first()[0]
    empty = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], empty)
    table = materialize(distinct_vectors(good, size, k + 1), "vectors")

    # The classes of equal vectors that hold a query, and the queries of each.
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column("embedding"), size) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in v], pa.binary())], ["query_id", "v"])

    asked = good.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").mapInArrow(identify, "query_id long, v binary").distinct()
    asked = materialize(asked.join(table.select("v", "rep"), "v").select("query_id", "rep"), "queries")
    blocks = max(1, round(table.count() / block))
    held = table.select(F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "rep", "v")
    asking = table.join(asked.select("rep").distinct(), "rep").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "rep", "v")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, forest, reps = None, [], None, None
        for batch in batches:
            numbers, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1]), [True]]))
            for a, z in zip(edges.tolist(), edges[1:].tolist(), strict=False):
                some, ids = _matrix(batch.column("v").slice(a, z - a), size), batch.column("rep").slice(a, z - a).to_numpy()
                if numbers[a] != name:
                    name, parts, forest = numbers[a], [], None
                if not asks[a]:
                    parts.append((ids, some))
                    continue
                if not parts:  # no vector of its own
                    continue
                if forest is None:
                    reps, own = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.argsort(reps)
                    reps, forest, parts = reps[order], Forest(own[order], trees, recall), parts[:1]
                for at in range(0, len(ids), QUERIES):
                    q, place, score = forest.search(some[at : at + QUERIES], k)
                    order = np.lexsort((reps[place], -score, q))
                    q, place, score = q[order], place[order], score[order]
                    keep = np.arange(len(q)) - np.searchsorted(q, q) <= k
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + QUERIES][q[keep]]), pa.array(reps[place[keep]]), pa.array(score[keep])], ["a", "b", "score"])

    rows = held.union(asking).repartition(blocks, "block").sortWithinPartitions("block", "asks", "rep")
    pairs = rows.mapInArrow(answer, "a long, b long, score double")
    ahead = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    # A class can hold the query itself, so one class more than k is kept, and k + 1 ids of each.
    pairs = pairs.withColumn("place", F.row_number().over(ahead)).where(F.col("place") <= k + 1)
    pairs = materialize(pairs.join(table.select(F.col("rep").alias("b"), F.explode("ids").alias("vec_id")), "b").select(F.col("a").alias("rep"), "vec_id", "score"), "pairs")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = asked.join(pairs, "rep").where("vec_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
