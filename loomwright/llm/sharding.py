"""Shuffled shards by a Feistel permutation with cycle walking over global row numbers.

Row number i of n goes to position p(i), where p permutes 0 .. n-1; shard is p mod shards and slot p div shards. So counts
differ by one at most, slots have no gaps, and both follow from (n, seed, shards) and the number alone, in either direction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.browse import number_rows
from .common import materialize

ROUNDS = 8


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Permutation:
    """Of 0 .. n-1. The Feistel network works on the least power of two that holds n (its halves differ by a bit at most), and a
    value beyond n - 1 goes through it again until it falls below n: under two passes on average."""

    n: int
    seed: int = 13

    def _halves(self) -> tuple[np.uint64, np.uint64]:
        bits = max(2, (self.n - 1).bit_length())
        return np.uint64(bits // 2), np.uint64(bits - bits // 2)

    def _pass(self, x: np.ndarray, rounds: range) -> np.ndarray:
        low, high = self._halves()
        masks = ((np.uint64(1) << high) - np.uint64(1), (np.uint64(1) << low) - np.uint64(1))
        sides = [x >> low, x & masks[1]]
        keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed % (1 << 64)))
        for i in rounds:
            to = i % 2
            sides[to] = sides[to] ^ (_mix(sides[1 - to] + keys[i]) & masks[to])
        return (sides[0] << low) | sides[1]

    def _walk(self, numbers: np.ndarray, rounds: range) -> np.ndarray:
        x = np.asarray(numbers).astype(np.uint64)
        if len(x) and int(x.max()) >= self.n:
            raise ValueError(f"numbers must be under {self.n}")
        x = self._pass(x, rounds)
        while len(beyond := np.flatnonzero(x >= np.uint64(self.n))):
            x[beyond] = self._pass(x[beyond], rounds)
        return x.astype(np.int64)

    def position(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, range(ROUNDS))

    def number(self, positions: np.ndarray) -> np.ndarray:
        """The inverse of position."""
        return self._walk(positions, range(ROUNDS - 1, -1, -1))


def locate(permutation: Permutation, numbers: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers, without any table."""
    at = permutation.position(numbers)
    return at % shards, at // shards


def number_at(permutation: Permutation, shard: int, slots: np.ndarray, shards: int) -> np.ndarray:
    """The row numbers that a shard holds in the given slots, without any table."""
    return permutation.number(np.asarray(slots) * shards + shard)


def _placed(numbered: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    """numbered (row_number from 0 on and further columns) with shard and slot."""
    permutation = Permutation(n, seed)
    at: Callable = F.pandas_udf(lambda numbers: pd.Series(permutation.position(numbers.to_numpy())), "long")
    placed = numbered.withColumn("__at", at("row_number"))
    return placed.withColumns({"shard": (F.col("__at") % shards).cast("int"), "slot": F.floor(F.col("__at") / shards)}).drop("__at")


def assign_shards(docs: DataFrame, shards: int = 16, seed: int = 13) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, shard, slot) per row of docs (doc_id, text; others are left out).

    Rows are numbered from 0 on by doc_id (null last), then by CRC-32 and XXH64 of the text; equal rows are numbered in any
    order, which their result doesn't show. So the numbers don't hang on files or partitions. size is the text's UTF-8
    bytes and one (null: like an empty text). Texts of any length are read once in place and never shuffled; copies of a text are
    no group here and go where their numbers send them; an empty table gives no rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("__hash"))
    # Written first: the id that splits equal rows is drawn once.
    own = materialize(own.withColumn("__copy", F.monotonically_increasing_id()), "sizes")
    numbered = number_rows(own, [(c, True) for c in ("doc_id", "text_crc32", "__hash", "__copy")], -1, "row_number").drop("__hash", "__copy")
    return _placed(numbered, own.count(), shards, seed)


def write_shards(docs: DataFrame, folder: str, shards: int = 16, seed: int = 13, rows_a_file: int = 1 << 20) -> DataFrame:
    """Writes docs (doc_id, text and further columns, which may not be called shard, slot or row_number) as Parquet under folder/shard=S, each
    file a stretch of slots in order, and returns the table read back. Numbers, ties and nulls as in assign_shards."""
    clash = {"shard", "slot", "row_number", "__hash"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns of docs clash with those of the shards: {sorted(clash)}")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"__crc": F.crc32(text), "__hash": F.xxhash64(text)})
    numbered = number_rows(keyed, [("doc_id", True), ("__crc", True), ("__hash", True)], -1, "row_number").drop("__crc", "__hash")
    n = numbered.count()
    placed = _placed(numbered, n, shards, seed)
    files = max(shards, -(-n // rows_a_file))
    placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.schema(placed.schema).parquet(folder)
