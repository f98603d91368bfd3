"""Periodic runs of words by internal pattern matching.

A run of period q that is long enough holds a dyadic block (length b a power of two, at a multiple of b) together with its
shift by q. So each block asks for its occurrences in the window of distances that its level stands for: its occurrences in
the text are an interval of the suffix array, and a wavelet tree over that array gives the next one from any place on. Occurrences
that overlap by half or more form an arithmetic progression, which is passed over in one step; it and lone occurrences give the
candidate periods, and longest common extensions to both sides decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, payload, small_batches

#: The least block of words; shorter ones aren't needed, for runs have LEAST words or more.
BLOCK, LEAST = 4, 12

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class WaveletTree:
    """Of an array of numbers (in the form of a bit matrix): the least value from x on in any interval, for many intervals at once."""

    def __init__(self, values: np.ndarray, top: int):
        self.size, self.bits = len(values), max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(one, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(self.size - int(self.ones[-1][-1]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def _below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of the intervals are less than x."""
        n, lo, hi = np.zeros(len(lo), np.int64), lo.copy(), hi.copy()
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            a, b = self.ones[level][lo].astype(np.int64), self.ones[level][hi].astype(np.int64)
            one = ((x >> bit) & 1).astype(bool)
            n += np.where(one, (hi - b) - (lo - a), 0)
            lo, hi = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, hi - b)
        return n

    def _kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k (from 0) of each interval."""
        found, lo, hi, k = np.zeros(len(lo), np.int64), lo.copy(), hi.copy(), k.copy()
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            a, b = self.ones[level][lo].astype(np.int64), self.ones[level][hi].astype(np.int64)
            zeros = (hi - b) - (lo - a)
            one = k >= zeros
            found |= one.astype(np.int64) << bit
            k = np.where(one, k - zeros, k)
            lo, hi = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, hi - b)
        return found

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value that is x or more among places lo .. hi - 1, or -1."""
        out = np.full(len(lo), -1, np.int64)
        x = np.clip(x, 0, (1 << self.bits) - 1)
        k = self._below(lo, hi, x)
        some = np.flatnonzero(lo + k < hi)
        value = self._kth(lo[some], hi[some], k[some])
        out[some] = np.where(value >= x[some], value, -1)
        return out


class Factors:
    """Names of all stretches of 2**k words of some texts laid end to end, and their suffix array. Equal stretches of a text have equal
    names; those of different texts, and those that reach beyond their text's end, have none in common."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        """words: the words' numbers; text: the number of the text each belongs to, ascending."""
        n = len(words)
        _, first = np.unique(text * (int(words.max(initial=0)) + 1) + words, return_inverse=True)
        last = np.searchsorted(text, text, "right")  # the end of each word's text
        # A name is the place of its first suffix in the order by so many words.
        order = np.argsort(first, kind="stable")
        self.names, self.counts = [], []
        name, count = self._named(first[order], order, n)
        self.names.append(name)
        self.counts.append(count)
        self.order, width, open_ = order, 1, count > 1
        while open_.any():
            # Only suffixes whose name isn't theirs alone are told apart further.
            at = self.order[open_[self.order]]
            beyond = at + width
            next_ = np.where(beyond < last[at], name[np.minimum(beyond, n - 1)] + np.int64(1), 0)
            # A stretch that ends with its text is like no other: the shorter of two comes first, by the length.
            key = name[at].astype(np.int64) * (n + 1) + next_
            by = np.argsort(key, kind="stable")
            places = np.flatnonzero(open_[self.order])
            self.order[places] = at[by]
            key = key[by]
            start = np.concatenate([[True], key[1:] != key[:-1]])
            heads = np.flatnonzero(start)
            sizes = np.diff(np.concatenate([heads, [len(key)]]))
            name, count = name.copy(), count.copy()
            name[at[by]] = np.repeat(places[heads], sizes)
            count[at[by]] = np.repeat(sizes, sizes)
            self.names.append(name)
            self.counts.append(count)
            width, open_ = width * 2, count > 1

    @staticmethod
    def _named(keys: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        name, count = np.zeros(n, np.int32), np.zeros(n, np.int32)
        if n:
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.concatenate([heads, [n]]))
            name[order], count[order] = np.repeat(heads, sizes), np.repeat(sizes, sizes)
        return name, count

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal (i < j)."""
        i, j, n = i.copy(), j.copy(), len(self.names[0])
        began = j.copy()
        for k in range(len(self.names) - 1, -1, -1):
            # A stretch may match twice at a level whose double has no equal names.
            for _ in range(2 if k == len(self.names) - 1 else 1):
                same = (j < n) & (self.names[k][np.minimum(i, n - 1)] == self.names[k][np.minimum(j, n - 1)])
                i, j = i + (same << k), j + (same << k)
        return j - began

    def extend_back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j are equal (i < j)."""
        i, j = i.copy(), j.copy()
        began = j.copy()
        for k in range(len(self.names) - 1, -1, -1):
            for _ in range(2 if k == len(self.names) - 1 else 1):
                a, b = i - (1 << k), j - (1 << k)
                same = (a >= 0) & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])
                i, j = i - (same.astype(np.int64) << k), j - (same.astype(np.int64) << k)
        return began - j


def _candidates(factors: Factors, tree: WaveletTree, place: np.ndarray, i: np.ndarray, k: int, low: np.ndarray | int, high: np.ndarray | int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, q): blocks of 2**k words at i and distances q from low to high at which a run may hold block and shift.
    place: how many suffixes in the tree come before each place of the suffix array."""
    b = 1 << k
    name = factors.names[k][i].astype(np.int64)
    lo, hi = place[name], place[name + factors.counts[k][i]]
    x, limit = i + low, i + high
    while len(i):
        o = tree.successor(lo, hi, x)
        some = np.flatnonzero((o >= 0) & (o <= limit))
        i, lo, hi, x, limit, o = i[some], lo[some], hi[some], x[some], limit[some], o[some]
        if not len(i):
            return
        yield i, o - i
        following = tree.successor(lo, hi, o + 1)
        x = o + 1
        # Two occurrences that overlap by half: the block has their distance p as its least period.
        many = np.flatnonzero((following >= 0) & (following - o <= b // 2))
        if not len(many):
            continue
        at, to, p = i[many], o[many], following[many] - o[many]
        start, end = at - factors.extend_back(at, at + p), at + p + factors.extend(at, at + p)
        start2, end2 = to - factors.extend_back(to, to + p), to + p + factors.extend(to, to + p)
        x[many] = end2 - b + 1
        other = np.flatnonzero(start != start2)
        at, to, p, start, end, start2, end2 = (v[other] for v in (at, to, p, start, end, start2, end2))
        # A run that goes beyond a stretch of period p repeats its border; one inside two such stretches that meet has any
        # period of the progression up to half of both.
        yield at, start2 - start
        yield at, end2 - end
        most = np.minimum(np.minimum(end - start, end2 - start2), (end2 - start) // 2)
        most = np.where(end >= start2, np.minimum(most, (limit[many] - i[many])[other]), 0)
        first = (to - at) - ((to - at) // p) * p
        first = np.where(first == 0, p, first)
        counts = np.maximum(0, (most - first) // p + 1)
        owner = np.repeat(np.arange(len(at)), counts)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield at[owner], first[owner] + step * p[owner]


def runs(words: np.ndarray, text: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, least period) of the maximal runs of at least `least` words (12 or more) and two periods, in order of start, then
    period. words: numbers; text: the number of the text each word belongs to, ascending; runs never cross texts."""
    none = (np.zeros(0, np.int64),) * 3
    if least < LEAST:
        raise ValueError(f"runs of under {LEAST} words aren't found")
    factors = Factors(words, text)
    level = BLOCK.bit_length() - 1
    if len(factors.names) <= level:
        return none
    repeated = factors.counts[level] > 1
    in_tree = repeated[factors.order]
    if not in_tree.any():
        return none
    place = np.concatenate([[0], np.cumsum(in_tree)]).astype(np.int64)
    tree = WaveletTree(factors.order[in_tree].astype(np.int64), len(words))
    begin = np.searchsorted(text, text, "left")
    longest = int((np.searchsorted(text, text, "right") - begin).max(initial=0))
    found = []
    while len(factors.names) > level:
        b = 1 << level
        if level > BLOCK.bit_length() - 1 and 2 * (2 * b - 1) > longest:
            break
        # Least blocks stand at every second word, so that a run of twelve holds one and its shift by up to six words.
        stride = 2 if b == BLOCK else b
        at = np.flatnonzero((factors.counts[level] > 1) & ((np.arange(len(words)) - begin) % stride == 0))
        low = 1 if b == BLOCK else 2 * b - 1
        pairs = list(_candidates(factors, tree, place, at, level, low, 4 * b - 2))
        if pairs:
            i, q = (np.concatenate(x) for x in zip(*pairs, strict=True))
            good = np.flatnonzero((q > 0) & (i + q < len(words)))
            i, q = i[good], q[good]
            i, q = i[new := _distinct(i, q)], q[new]
            start, end = i - factors.extend_back(i, i + q), i + q + factors.extend(i, i + q)
            long = np.flatnonzero(end - start >= np.maximum(least, 2 * q))
            found.append((start[long], end[long], q[long]))
        level += 1
    if not found:
        return none
    start, end, q = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((q, end, start))
    start, end, q = start[by], end[by], q[by]
    # A multiple of a run's period spans the same words: the least is the run's.
    first = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(start)]
    start, end, q = start[first], end[first], q[first]
    by = np.lexsort((q, start))
    return start[by], end[by], q[by]


def _distinct(i: np.ndarray, q: np.ndarray) -> np.ndarray:
    by = np.lexsort((q, i))
    return by[np.concatenate([[True], (i[by][1:] != i[by][:-1]) | (q[by][1:] != q[by][:-1])])[: len(by)]]


def _split(raw: bytes, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts of a buffer (cut at space and bytes 9 to 13), and how many each text has."""
    bounds = offsets.tolist()
    words, sizes = [], []
    for a, b in zip(bounds, bounds[1:], strict=False):
        own = raw[a:b].split()
        words += own
        sizes.append(len(own))
    return words, np.array(sizes, np.int64)


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed) per row of docs (doc_id, text; further columns are left out).

    runs: the maximal runs of words (start as word number, length, least period) of at least `least` words and two periods, by start,
    then period. collapsed: the text's words without those that some run holds after its first period, joined by one space. Null, blank
    and short texts have no runs; repeated rows and ties of doc_id are each judged on their own; an empty table gives no rows.

    Texts are judged whole, each in the task that reads it: those of a megabyte share the arrays, a longer text has its own, of about
    40 bytes a word and 8 more for each doubling of its longest repeat."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", 1 << 20):
                data, offsets = payload(batch.column("text"))
                words, sizes = _split(data.tobytes(), offsets)
                text = np.repeat(np.arange(len(batch)), sizes)
                codes = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64) if words else np.zeros(0, np.int64)
                start, end, q = runs(codes, text, least)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, start + q, 1)
                np.add.at(change, end, -1)
                stays = np.cumsum(change)[:-1] == 0
                ends = np.cumsum(sizes)
                collapsed, at, kept = [], 0, stays.tolist()
                for to in ends.tolist():
                    collapsed.append(b" ".join([w for w, k in zip(words[at:to], kept[at:to], strict=True) if k]))
                    at = to
                owner = text[start] if len(start) else np.zeros(0, np.int64)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(batch)))]).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(start - (ends - sizes)[owner]), pa.array(end - start), pa.array(q)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(cuts), rows), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """docs with a period planted into every tenth text or so, by a hash h = crc32 of the decimal doc_id: where h % 10 is 0, words from
    number a = g % n on (g = h div 10, n words) repeat the p = 1 + (n - a) div (3 + g % 8) words from a on. Its words are joined by
    one space; other texts, those without words and those of a null doc_id are left alone."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    named = docs.withColumn("__words", F.when(chosen, words))
    n = F.size("__words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    repeated = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("__words", F.when(i < a, i).otherwise(a + (i - a) % p)))
    return named.withColumn("text", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))).drop("__words")
