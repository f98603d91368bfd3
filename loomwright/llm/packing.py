"""Mixture-controlled packing: every window of 2048 tokens takes from each source's queue its target share.

Deficit round-robin gives queue q, after k windows, floor(k * quantum) tokens in all: what a window rounds
off is the deficit that the next one pays. That sum depends on k alone, so a task that knows where a document
stands in its queue knows the document's windows without seeing the others: deficits carry over windows and
partitions alike, and no token is shuffled. What rounding leaves free in a window goes to the largest queue."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, materialize, payload, small_batches
from .tokens import PieceTokenizer

WINDOW = 2048
#: So many of the largest sources, and any that a weight names, have queues of their own; the others share one more.
QUEUES = 32
#: Offsets of up to so many (partition, queue) pairs are broadcast (16 bytes or so each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000


@dataclass
class Segment:
    """Windows first .. first + count - 1. base: tokens that each queue has given before. take: what each gives in
    the only window, or None where quanta in proportion to weights hold."""

    first: int
    count: int
    base: list[int]
    weights: list[int]
    take: list[int] | None = None

    def given(self, k: np.ndarray) -> np.ndarray:
        """(queues, len(k)): tokens that each queue gives in the first k windows of this segment."""
        if self.take is not None:
            return np.array(self.take)[:, None] * k
        total = sum(self.weights)
        exact = int(k[-1]) * WINDOW * total < 1 << 62
        out = np.array(self.weights, np.int64 if exact else object)[:, None] * (k if exact else k.astype(object)) * WINDOW // total
        big = self.weights.index(max(self.weights))
        out[big] = 0
        out[big] = k * WINDOW - out.sum(0)
        return out.astype(np.int64)

    def window_of(self, queue: int, x: int) -> int:
        """The window of this segment that holds the queue's token x (counted from base)."""
        if self.take is not None:
            return 0
        total, weight = sum(self.weights), self.weights[queue]
        k = ((x + 1) * total + WINDOW * weight - 1) // (WINDOW * weight) - 1
        if weight == max(self.weights):  # the filling queue is ahead by up to a token for each other queue
            k = max(0, k - len(self.weights) * total // (WINDOW * weight) - 1)
            ks = np.arange(k, min(self.count, k + 2 * (len(self.weights) * total // (WINDOW * weight)) + 4) + 1)
            k += int(np.searchsorted(self.given(ks)[queue], x, "right")) - 1
        return k


def schedule(tokens: list[int], weights: list[int] | None = None, window: int = WINDOW) -> list[Segment]:
    """Segments that use up the queues' tokens. weights: the target proportions, by default the tokens themselves.
    When a queue runs dry the others keep their proportions; the last tokens, too few for a window, fill windows
    of powers of two. A queue without weight waits until the others are empty."""
    left, out, base, first = list(tokens), [], [0] * len(tokens), 0
    while (rest := sum(left)) > 0:
        held = [w if r else 0 for w, r in zip(weights or tokens, left, strict=True)]
        held = held if sum(held) else left[:]
        n = 0
        if rest >= window:
            low, high, probe = 0, rest // window, Segment(0, 0, base, held)
            while low < high:  # the most windows that no queue is too short for
                mid = (low + high + 1) // 2
                low, high = (mid, high) if all(g <= r for g, r in zip(probe.given(np.array([mid]))[:, 0].tolist(), left, strict=True)) else (low, mid - 1)
            n = low
        if n:
            take, segment = Segment(0, n, base, held).given(np.array([n]))[:, 0].tolist(), Segment(first, n, base, held)
        else:
            size = min(window, 1 << (rest.bit_length() - 1))
            take = [min(r, size * w // sum(held)) for w, r in zip(held, left, strict=True)]
            for q in sorted(range(len(left)), key=lambda q: (-(left[q] - take[q]), q)):  # the longest queues fill the rest
                take[q] += min(left[q] - take[q], size - sum(take))
            n, segment = 1, Segment(first, 1, base, held, take)
        out.append(segment)
        base = [b + t for b, t in zip(base, take, strict=True)]
        left = [r - t for r, t in zip(left, take, strict=True)]
        first += n
    return out


def pieces(segments: list[Segment], queue: int, start: int, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Cuts tokens start .. start + length - 1 of a queue: arrays (first token, length, sequence, offset in it)."""
    bases = [s.base[queue] for s in segments]
    at, end = start, start + length
    while at < end:
        i = bisect_right(bases, at) - 1  # the last with this base: those before it take nothing from the queue
        segment, stop = segments[i], min(end, bases[i + 1] if i + 1 < len(segments) else end)
        k0, k1 = segment.window_of(queue, at - bases[i]), segment.window_of(queue, stop - 1 - bases[i])
        k = np.arange(k0, k1 + 2)
        given = segment.given(k)
        edges = np.clip(given[queue] + bases[i], at, stop)
        inside = np.diff(given, axis=1)[:queue].sum(0) + edges[:-1] - bases[i] - given[queue, :-1]
        keep = np.diff(edges) > 0
        yield edges[:-1][keep], np.diff(edges)[keep], segment.first + k[:-1][keep], inside[keep]
        at = stop


def tokenize(docs: DataFrame, tokenizer: PieceTokenizer) -> DataFrame:
    """(doc_id, queue, part, start, n, ids): each document's ids (16 bits each where they fit, else 32), and how many
    tokens of its source come before it in its partition of the table written."""
    small_batches(docs.sparkSession)
    wide = tokenizer.wide

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: dict[str, int] = {}
        for whole in batches:
            for batch in by_bytes(whole, "text", 512 << 10):
                ids, ends = tokenizer.encode(*payload(batch.column("text")))
                n, starts = np.diff(ends, prepend=0), []
                for source, size in zip(batch.column("source").to_pylist(), n.tolist(), strict=True):
                    starts.append(before.get(source, 0))
                    before[source] = starts[-1] + size
                width = 4 if wide else 2
                offsets = pa.py_buffer(np.concatenate([[0], ends * width]).astype(np.int32))
                blob = pa.Array.from_buffers(pa.binary(), len(batch), [None, offsets, pa.py_buffer(ids.astype("<u4" if wide else "<u2"))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("part"), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), blob], ["doc_id", "source", "part", "start", "n", "ids"])

    source = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), source.alias("source"), F.spark_partition_id().alias("part"))
    return materialize(rows.mapInArrow(encode, "doc_id long, source string, part int, start long, n long, ids binary"), "tokens")


def pack(docs: DataFrame, tokenizer: PieceTokenizer, weights: dict[str, float] | None = None, with_ids: bool = True) -> DataFrame:
    """Packs docs (doc_id, text, source) into sequences of 2048 tokens; each document ends with the tokenizer's end id.

    weights: target share of each source, by default its share of all tokens. Every source with a weight and the largest
    others (32 in all, or as many as have weights) have queues of their own, the rest share one; where weights are
    given, sources without one wait until the others are used up. Rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids (unsigned
    32-bit numbers, little-endian; null unless with_ids).
    A null text is empty, a null source is a source, repeated rows are packed each, and a null doc_id stays null. Only
    the tokens that don't fill a window are in shorter sequences, of powers of two. An empty table gives no rows."""
    spark = docs.sparkSession
    table = tokenize(docs, tokenizer)
    sums = table.groupBy("part", "source").agg(F.sum("n").alias("n"))
    named = {"null" if k is None else f"={k}": w for k, w in (weights or {}).items()}
    own = F.col("source").isin(list(named)) if named else F.lit(False)
    ranked = sums.groupBy("source").agg(F.sum("n").alias("n")).withColumn("own", own).orderBy(F.desc("own"), F.desc("n"), "source")
    top = [r.source for r in ranked.limit(max(QUEUES, len(named))).collect()]
    queue = F.when(F.col("source").isin(top), F.array_position(F.array(*map(F.lit, top)), F.col("source")).cast("int") - 1).otherwise(len(top)) if top else F.lit(0)
    sums = materialize(sums.withColumn("queue", queue), "sums")
    found = {r.queue: r.n for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    tokens = [found.get(q, 0) for q in range(len(top) + (len(top) in found))]
    shares = None
    if weights is not None:
        shares = [round(named.get(s, 0) * (1 << 20)) for s in top] + [0] * (len(tokens) - len(top))
    segments = schedule(tokens, shares)
    # Tokens of a queue before a partition, and before a source of the shared queue within its partition.
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("queue", "part").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("queue", "part").agg(F.sum("n").alias("n")).select("queue", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inner = sums.select("part", "source", "queue", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("within"))
    offsets = inner.join(parts, ["queue", "part"]).select("part", "source", "queue", (F.col("ahead") + F.col("within")).alias("base"))
    if sums.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    wide = tokenizer.wide

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 4 if wide else 2
        for whole in batches:
            for batch in by_bytes(whole, "ids", 256 << 10):
                data, ends = payload(batch.column("ids"))
                ids = data.view("<u4" if wide else "<u2").astype("<u4")
                ends //= width
                rows = []
                queues, starts, sizes = (batch.column(c).to_pylist() for c in ("queue", "at", "n"))
                for i, (q, at, n) in enumerate(zip(queues, starts, sizes, strict=True)):
                    for first, length, sequence, offset in pieces(segments, q, at, n):
                        rows.append(np.stack([np.full(len(first), i), first - at, length, sequence, offset]))
                if not rows:
                    continue
                at, start, length, sequence, offset = np.concatenate(rows, axis=1)
                # Pieces follow one another in the ids of the slice, so one buffer holds them all.
                begin = 4 * (start + ends[at])
                raw = memoryview(ids).cast("B")
                crcs = np.fromiter((zlib.crc32(raw[a:z]) for a, z in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)), np.int64, len(begin))
                blobs = pa.nulls(len(at), pa.binary())
                if with_ids:
                    blobs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(begin, 4 * len(ids)).astype(np.int32)), pa.py_buffer(ids)])
                places = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(places), pa.array(start), pa.array(length), pa.array(crcs), batch.column("n").take(places), pa.array(sequence), pa.array(offset), batch.column("source").take(places), blobs],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"],
                )

    small_batches(spark)
    rows = table.join(offsets, ["part", "source"]).select("doc_id", "source", "queue", (F.col("base") + F.col("start")).alias("at"), "n", "ids")
    out = rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary")
    return out.withColumn("source", F.when(F.col("source") != "null", F.expr("substring(source, 2)")))
