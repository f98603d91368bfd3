"""Removal of long byte strings that an earlier document holds, by suffix sorting in shards.

Every window of `length` bytes is assigned to the least hash of its 24-byte strings, so that equal windows have equal
ones wherever they stand; stretches of windows with one least hash are the unit that is dealt out. Equal stretches are
settled by their hashes alone. Of the rest, stretches that share a least hash with other documents, the bytes are
gathered in shards, where windows that no other document has are left out and equal runs of the others are settled, byte for byte. The suffixes of
what differs are sorted by external induction, whose tuples go to the shared folder: windows are equal where the common prefix reaches `length`."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, fresh_path, materialize, payload, ranges, small_batches
from .induced import Disk, suffixes_descending
from .tokens import SliceHasher, mixed

LENGTH, GRAM = 50, 24
#: Bytes of text for which one shard is planned.
SHARD_BYTES = 12 << 20
LEAST_SHARDS = 32
#: Stretches of a least hash that so many others share are dealt window by window, by the windows' own hashes.
HOT = 4096
#: Bytes of suffix tuples that the task of a shard keeps in memory; the others go to files in the shared folder.
TUPLE_BYTES = 32 << 20
#: Bytes of text whose stretches are dealt out at once: each such part sends some to every shard.
DEALT = 8 << 20
#: Bytes of a shard that are hashed at once.
HASHED = 1 << 19
_LOW = np.uint64((1 << 48) - 1)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text index, start, number of windows (255 at most), least hash and content hash of each stretch of each text."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hasher = SliceHasher(data, 13)
    at = np.arange(len(data) - gram + 1)
    h = (hasher.sums[gram:] - hasher.sums[:-gram]) * hasher.back[: len(at)]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least, width, want = h, 1, length - gram + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - want + width], least[want - width :])
    # Windows that lie within one text.
    valid = np.zeros(len(data) + 1, np.int32)
    sizes = np.diff(offsets)
    long = sizes >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - length + 1, -1)
    inside = np.cumsum(valid)[: len(least)] > 0
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    opening = np.zeros(len(data) + 1, bool)
    opening[offsets] = True
    starts = np.flatnonzero(inside & (change | opening[: len(least)]))
    stops = np.zeros(len(least) + 1, bool)
    stops[starts] = True
    stops[1:-1] |= inside[:-1] & ~inside[1:]
    stops[-1] |= inside[-1]
    ends = np.flatnonzero(stops)
    count = ends[np.searchsorted(ends, starts, "right")] - starts
    parts = -(-count // 255)
    first = np.cumsum(parts) - parts
    step = np.arange(int(parts.sum())) - np.repeat(first, parts)
    start = np.repeat(starts, parts) + 255 * step
    count = np.minimum(np.repeat(count, parts) - 255 * step, 255)
    owner = np.searchsorted(offsets, start, "right") - 1
    return owner, start - offsets[owner], count, least[start], hasher(start, start + count + length - 1)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans (touching ones are one run)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(reach) - 1)]


def _settle(ids: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (h, c, id), whether each row of it opens a group (h, c), and whether its id is above its group's least."""
    order = np.lexsort((ids, c, h))
    h, c, ids = h[order], c[order], ids[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, bool)
    least = ids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(h) else ids
    return order, fresh, ids > least


def _repeats(ids: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which rows have the (h, c) of a row with a smaller id. Both hashes are compared; where the key they are sorted by clashes, some aren't found."""
    order = np.argsort(h ^ mixed(c))
    fresh = np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (c[order[1:]] != c[order[:-1]])])
    own = ids[order]
    out = np.zeros(len(ids), bool)
    out[order] = own > np.repeat(np.minimum.reduceat(own, at := np.flatnonzero(fresh)), np.diff(np.append(at, len(own))))
    return out


def _by_doc(ids: np.ndarray, hashes: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(id, hash, rows of values as 32-bit numbers) of each document."""
    order = np.lexsort((hashes, ids))
    ids, hashes, table = ids[order], hashes[order], np.stack(values, 1).astype("<i4")[order]
    edges = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]), [True]])) if len(ids) else np.zeros(1, np.int64)
    for a, z in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        yield int(ids[a]), int(hashes[a]), table[a:z].tobytes()


def _merged_by_doc(ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(id, hash, maximal runs as 32-bit numbers) of each document's spans."""
    for i, x, spans in _by_doc(ids, hashes, starts, ends):
        a, z = merged(*np.frombuffer(spans, "<i4").reshape(-1, 2).T)
        yield i, x, np.stack([a, z], 1).astype("<i4").tobytes()


def _slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of slices of data in the order of their starts; about HASHED bytes are in work at a time."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, low + HASHED)))
        out[at:to] = SliceHasher(data[low : int(ends[at:to].max())])(starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def shared_runs(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, end) of the runs of windows in pieces of data, which follow one another, that pieces of several ids have. Windows are
    told apart by 64 bits of hash: a run may hold others, too, but none that is shared is left out."""
    begins = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - length + 1, 0)
    at = ranges(begins, count)
    h = _slice_hashes(data, at, at + length)
    order = np.argsort(h)
    h = h[order]
    opens = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    own = np.repeat(ids, count)[order]
    several = (np.maximum.reduceat(own, opens) > np.minimum.reduceat(own, opens)) if len(h) else np.zeros(0, bool)
    kept = np.sort(order[np.repeat(several, np.diff(np.append(opens, len(h))))])
    piece, at = np.repeat(np.arange(len(sizes)), count)[kept], at[kept]
    fresh = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])]) if len(at) else np.zeros(0, bool)
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(at) - 1) if len(at) else np.zeros(0, np.int64)
    return piece[fresh], at[fresh], at[last] + length


def copies(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which runs have the bytes of a run with a smaller id. They are found by hash and compared byte for byte."""
    order = np.lexsort((ids, c := _slice_hashes(data, starts, ends)))
    fresh = np.concatenate([[True], c[order[1:]] != c[order[:-1]]]) if len(order) else np.zeros(0, bool)
    first = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(order) else order
    later = ids[order] > ids[first]
    mine, first = order[later], first[later]
    size = ends[mine] - starts[mine]
    mine, first, size = (x[size == ends[first] - starts[first]] for x in (mine, first, size))
    differs = data[ranges(starts[mine], size)] != data[ranges(starts[first], size)]
    out = np.zeros(len(ids), bool)
    out[mine] = np.bincount(np.repeat(np.arange(len(mine)), size)[differs], minlength=len(mine)) == 0
    return out


def settled_windows(held: dict[bytes, list[tuple[int, int, int]]]) -> tuple[list[tuple[int, int, int, bytes]], list[tuple[int, int, int]]]:
    """Of each window, held by (id, hash, start): those of the least id, which stand for all, with the window, and the others, which they remove."""
    sent, gone = [], []
    for window, at in held.items():
        least = min(at)[0]
        sent += [(*x, window) for x in at if x[0] == least]
        gone += [x for x in at if x[0] > least]
    return sent, gone


def _packed(rows: list[tuple[int, int, int, bytes]]) -> bytes:
    """Rows (id, hash, kind, numbers) as bytes."""
    ids, hashes, kinds, data = zip(*rows, strict=True)
    return b"".join([np.array([len(rows)], "<i4").tobytes(), np.array(ids, "<i8").tobytes(), np.array(hashes, "<i8").tobytes(), np.array(kinds, np.uint8).tobytes(), np.array([len(x) for x in data], "<i4").tobytes(), *data])


def _unpacked(blob: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    n = int(np.frombuffer(blob, "<i4", 1)[0])
    sizes = np.frombuffer(blob, "<i4", n, 4 + 17 * n)
    at = 4 + 21 * n
    for i, x, kind, size in zip(np.frombuffer(blob, "<i8", n, 4).tolist(), np.frombuffer(blob, "<i8", n, 4 + 8 * n).tolist(), np.frombuffer(blob, np.uint8, n, 4 + 16 * n).tolist(), sizes.tolist(), strict=True):
        yield i, x, kind, blob[at : at + size]
        at += size


def _in_buckets(ids: np.ndarray, hashes: np.ndarray, values: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, its documents and their rows of values as bytes): a document's rows are together, in no order."""
    if not len(ids):
        return
    name = mixed(ids.astype(np.uint64) ^ mixed(hashes.astype(np.uint64)))
    bucket = name % np.uint64(buckets)
    order = np.argsort((bucket << np.uint64(40)) | (name >> np.uint64(24)))
    ids, hashes, bucket, values = ids[order], hashes[order], bucket[order].astype(np.int64), values[order].astype("<i4")
    opens = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])]))
    ids, hashes, count = ids[opens].astype("<i8"), hashes[opens].astype("<i8"), np.diff(np.append(opens, len(values))).astype("<i4")
    edges = np.flatnonzero(np.diff(bucket[opens], prepend=-1))
    rows = np.append(opens, len(values))
    for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(opens)], strict=True):
        yield int(bucket[opens[a]]), b"".join([np.array([z - a], "<i4").tobytes(), ids[a:z].tobytes(), hashes[a:z].tobytes(), count[a:z].tobytes(), values[rows[a] : rows[z]].tobytes()])


def _of_buckets(blobs: list[bytes], width: int, spans: bool) -> Iterator[tuple[int, int, bytes]]:
    """(id, hash, rows of values) of each document of a bucket's blobs; spans: the rows are (start, end) and become maximal runs."""
    ids, hashes, count, values = [], [], [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, "<i4", 1)[0])
        for kept, kind, at in ((ids, "<i8", 4), (hashes, "<i8", 4 + 8 * n), (count, "<i4", 4 + 16 * n)):
            kept.append(np.frombuffer(blob, kind, n, at))
        values.append(np.frombuffer(blob, "<i4", -1, 4 + 20 * n))
    ids, hashes, count, values = (np.concatenate(x) for x in (ids, hashes, count, values))
    order = np.lexsort((hashes, ids))
    values = values.reshape(-1, width)[ranges((np.cumsum(count) - count)[order], count[order])]
    ids, hashes, count = ids[order], hashes[order], count[order]
    opens = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])]))
    rows = np.append(0, np.cumsum(np.add.reduceat(count, opens, dtype=np.int64)))
    if spans:
        own = np.repeat(np.arange(len(opens)) << 32, np.diff(rows))  # no run goes from one document to the next
        a, z = merged(own + values[:, 0], own + values[:, 1])
        rows = np.searchsorted(a >> 32, np.arange(len(opens) + 1))
        values = (np.stack([a, z], 1) & 0xFFFFFFFF).astype("<i4")
    for i, x, a, z in zip(ids[opens].tolist(), hashes[opens].tolist(), rows.tolist(), rows[1:].tolist(), strict=False):
        yield i, x, values[a:z].tobytes()


def _six(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _groups(found: Iterator[tuple[np.ndarray, np.ndarray]], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, which of them open a group): suffixes in parts that hold groups whole, those that share `length` bytes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for position, prefix in found:
        opens = prefix < length
        last = int(np.flatnonzero(opens)[-1]) if opens.any() else 0
        if last:
            held.append((position[:last], opens[:last]))
        if opens[last] and held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
        held.append((position[last:], opens[last:]))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, hash, spans): for documents (id, hash, body), ids not null, told apart by id and hash, the bytes that windows of an earlier document cover, as pairs of
    32-bit numbers (start, end), unmerged, in several rows."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(LEAST_SHARDS, size // SHARD_BYTES)
    most, budget, folder = HOT, TUPLE_BYTES, fresh_path(docs.sparkSession, "suffixes")

    def dealt_out(found: list[tuple[np.ndarray, ...]], names: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        # In the order of rows and starts.
        place, start, count, h, c = (np.concatenate(x) for x in zip(*found, strict=True))
        names = np.concatenate(names)
        if not len(place):
            return
        gone = _repeats(names[place, 0], h, c)
        rows = [(i % parts, i, x, spans, None) for i, x, spans in _by_doc(*names[place[gone]].T, start[gone], start[gone] + count[gone] + length - 1)]
        # One document of the part stands for each content; its stretches go to the shard of their least hash.
        place, start, count, h, c = (x[~gone] for x in (place, start, count, h, c))
        shard = (h % np.uint64(parts)).astype(np.min_scalar_type(parts))
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[p] : edges[p + 1]]
            opens = np.diff(place[at], prepend=-1) > 0
            own = place[at][opens]
            # Documents and starts come in order: their differences pack well.
            where = zstandard.compress(np.diff(np.cumsum(opens) - 1, prepend=0).astype("<u2").tobytes() + np.diff(start[at], prepend=0).astype("<i4").tobytes() + count[at].astype(np.uint8).tobytes(), 1)
            blob = b"".join([np.array([len(own), len(at), len(where)], "<i4").tobytes(), names[own].astype("<i8").tobytes(), where, _six(h[at]), _six(c[at])])
            rows.append((p, None, None, None, blob))
        part, ident, text, spans, blob = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(ident, pa.int64()), pa.array(text, pa.int64()), pa.array(spans, pa.binary()), pa.array(blob, pa.binary())], ["part", "id", "hash", "spans", "blob"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, names, rows, size = [], [], 0, 0
        for whole in batches:
            for batch in by_bytes(whole, "body", 2 << 20):
                data, offsets = payload(batch.column("body"))
                owner, *told = stretches(data, offsets, length)
                found.append((owner + rows, *told))
                names.append(np.stack([batch.column("id").to_numpy(), batch.column("hash").to_numpy()], 1))
                rows, size = rows + len(batch), size + len(data) + names[-1].nbytes
                if size >= DEALT:
                    yield from dealt_out(found, names)
                    found, names, rows, size = [], [], 0, 0
        if found:
            yield from dealt_out(found, names)

    def settle(rows: pa.Table) -> pa.Table:
        """Keeps settled spans, settles equal stretches of different batches, and tells which stretches need their bytes."""
        tables: list[tuple] = []
        for blob in rows.column("blob").drop_null().to_pylist():
            m, n, packed = np.frombuffer(blob, "<i4", 3).tolist()
            at = 12 + 16 * m
            where = zstandard.decompress(blob[at : at + packed])
            at += packed
            names = np.frombuffer(blob, "<i8", 2 * m, 12).reshape(-1, 2)[np.cumsum(np.frombuffer(where, "<u2", n))]
            tables.append((names[:, 0], names[:, 1], np.cumsum(np.frombuffer(where, "<i4", n, 2 * n)), np.frombuffer(where, np.uint8, n, 6 * n), _from_six(blob[at : at + 6 * n]), _from_six(blob[at + 6 * n :])))
        told, asked = [], []  # ids, hashes and numbers
        done = rows.filter(rows.column("spans").is_valid())
        if len(done):
            spans = done.column("spans").to_pylist()
            count = np.array([len(x) for x in spans]) // 8
            told.append((*(np.repeat(done.column(k).to_numpy(), count) for k in ("id", "hash")), np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2)))
        if tables:
            ids, hashes, start, count, h, c = (np.concatenate(x) for x in zip(*tables, strict=True))
            del tables
            order, fresh, gone = _settle(ids, h, c)
            ids, hashes, start, count, h = ids[order], hashes[order], start[order], count[order].astype(np.int64), h[order]
            told.append((ids[gone], hashes[gone], np.stack([start[gone], start[gone] + count[gone] + length - 1], 1)))
            # Least hashes with several contents, not all in one document.
            opens = np.concatenate([[True], h[1:] != h[:-1]])
            group = np.cumsum(opens) - 1
            contents = np.bincount(group, fresh)
            low, high = np.minimum.reduceat(ids, np.flatnonzero(opens)), np.full(int(group[-1]) + 1, np.iinfo(np.int64).min)
            np.maximum.at(high, group[~gone], ids[~gone])
            open_ = ((contents > 1) & (high > low))[group] & ~gone
            hot = np.bincount(group, ~gone)[group] > most
            shard = np.where(hot, -1, (h // np.uint64(parts) % np.uint64(parts)).astype(np.int64))
            asked.append((ids[open_], hashes[open_], np.stack([start[open_], count[open_], shard[open_]], 1)))
        # A document has rows from many shards; they meet in its bucket.
        out = [(kind, *x) for kind, found in enumerate((told, asked)) if found for x in _in_buckets(*(np.concatenate(x) for x in zip(*found, strict=True)), parts)]
        kinds, buckets, blobs = zip(*out, strict=True) if out else [()] * 3
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "kind": pa.array(kinds, pa.int32()), "data": pa.array(blobs, pa.binary())})

    def meet(rows: pa.Table) -> pa.Table:
        """One row a document: its spans, merged, and the stretches whose bytes are asked for."""
        found: dict[tuple[int, int], list] = {}
        for kind in range(2):
            blobs = rows.filter(pc.equal(rows.column("kind"), kind)).column("data").to_pylist()
            if blobs:
                for i, x, told in _of_buckets(blobs, 2 + kind, kind == 0):
                    found.setdefault((i, x), [None, None])[kind] = told
        ids, hashes = zip(*found, strict=True) if found else ([], [])
        return pa.table({"id": pa.array(ids, pa.int64()), "hash": pa.array(hashes, pa.int64()), "spans": pa.array([x[0] for x in found.values()], pa.binary()), "asked": pa.array([x[1] for x in found.values()], pa.binary())})

    dealt = docs.mapInArrow(deal, "part int, id long, hash long, spans binary, blob binary")
    settled = dealt.groupBy("part").applyInArrow(settle, "bucket int, kind int, data binary").groupBy("bucket").applyInArrow(meet, "id long, hash long, spans binary, asked binary")
    settled = materialize(settled, "settled")
    asked = settled.where("asked is not null").select("id", "hash", "asked")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "body", 4 << 20):
                by_shard: dict[int, list] = {}
                hot: dict[bytes, list] = {}
                for i, x, body, wanted in zip(*(batch.column(k).to_pylist() for k in ("id", "hash", "body", "asked")), strict=True):
                    for start, count, shard in np.frombuffer(wanted, "<i4").reshape(-1, 3).tolist():
                        if shard >= 0:
                            by_shard.setdefault(shard, []).append((i, x, start, body[start : start + count + length - 1]))
                        else:
                            for s in range(start, start + count):
                                hot.setdefault(body[s : s + length], []).append((i, x, s))
                sent, gone = settled_windows(hot)
                for i, x, s, window in sent:
                    by_shard.setdefault(int.from_bytes(hashlib.blake2b(window, digest_size=6).digest()) % parts, []).append((i, x, s, window))
                done = {}
                if gone:
                    i, x, s = np.array(gone, np.int64).T
                    spans = [(*row[:2], 0, row[2]) for row in _merged_by_doc(i, x, s, s + length)]
                    done = {spans[0][0] % parts: _packed(spans)}
                if by_shard or done:
                    names, columns = [*by_shard, *done], [list(zip(*v, strict=True)) for v in by_shard.values()]
                    none = [None] * len(done)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.int32()), *(pa.array([np.array(c[k], kind).tobytes() for c in columns] + none, pa.binary()) for k, kind in ((0, "<i8"), (1, "<i8"), (2, "<i4"))), pa.array([np.array([len(x) for x in c[3]], "<i4").tobytes() for c in columns] + none, pa.binary()), pa.array([b"".join(c[3]) for c in columns] + none, pa.binary()), pa.array([None] * len(columns) + list(done.values()), pa.binary())],
                        ["shard", "ids", "hashes", "starts", "sizes", "bytes", "done"],
                    )

    def compare(rows: pa.Table) -> pa.Table:
        runs = [(i, x, spans) for blob in rows.column("done").drop_null().to_pylist() for i, x, _, spans in _unpacked(blob)]
        ids, hashes, starts, sizes, data = (np.frombuffer(b"".join(rows.column(c).drop_null().to_pylist()), k) for c, k in (("ids", "<i8"), ("hashes", "<i8"), ("starts", "<i4"), ("sizes", "<i4"), ("bytes", np.uint8)))
        piece, begins, ends = shared_runs(data, sizes := sizes.astype(np.int64), ids, length)
        ids, hashes, starts = ids[piece], hashes[piece], starts[piece] + begins - (np.cumsum(sizes) - sizes)[piece]
        sizes, repeats = ends - begins, copies(data, begins, ends, ids)
        runs += _merged_by_doc(*(x[repeats] for x in (ids, hashes, starts, starts + sizes)))
        ids, hashes, starts, sizes, begins = (x[~repeats] for x in (ids, hashes, starts, sizes, begins))
        if len(ids):
            data = data[ranges(begins, sizes)]
            # Runs follow one another, each with a separator (1) behind it; bytes are 2 to 257, the end is 0.
            ends = np.cumsum(sizes + 1)
            text = np.ones(int(ends[-1]) + 1, np.int16)
            text[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data.astype(np.int16) + 2
            text[-1] = 0
            gone = np.zeros(len(text), bool)
            with Disk(folder, budget) as disk:
                for order, opens in _groups(suffixes_descending(text, 258, disk), length):
                    piece = np.searchsorted(ends, order, "right")
                    inside = piece < len(sizes)
                    inside[inside] = (order + length <= ends[np.minimum(piece, len(sizes) - 1)] - 1)[inside]
                    group, order, piece = np.cumsum(opens)[inside], order[inside], piece[inside]
                    if len(group):
                        fresh = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                        least = np.repeat(np.minimum.reduceat(ids[piece], fresh), np.diff(np.append(fresh, len(group))))
                        gone[order[ids[piece] > least]] = True
            at = np.flatnonzero(gone)
            piece = np.searchsorted(ends, at, "right")
            begin = starts[piece] + at - (ends - sizes - 1)[piece]
            runs += _merged_by_doc(ids[piece], hashes[piece], begin, begin + length)
        columns = list(zip(*runs, strict=True)) or [[]] * 3
        return pa.table({n: pa.array(v, k) for n, v, k in zip(("id", "hash", "data"), columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)})

    sources = docs.join(asked, ["id", "hash"])
    more = sources.mapInArrow(gather, "shard int, ids binary, hashes binary, starts binary, sizes binary, bytes binary, done binary").groupBy("shard").applyInArrow(compare, "id long, hash long, data binary")
    return settled.where("spans is not null").select("id", "hash", "spans").union(more.select("id", "hash", F.col("data").alias("spans")))


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per row of docs (doc_id, text): the text's UTF-8 without every byte that is covered by a
    string of `length` bytes that also starts in a document with a smaller doc_id; spans are the maximal removed runs.

    Matches never cross documents and are judged on the input. A null text is empty; a shorter one is kept whole. A null
    doc_id is neither smaller nor larger than any: such rows are kept whole and take nothing from others. Rows that
    repeat a doc_id are one document's: neither takes from the other. Further columns are left out; an empty table gives no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    rows = rows.select("id", F.xxhash64("body").alias("hash"), "body")
    named = rows.where(F.col("id").isNotNull())
    spans = repeated_spans(named, length).groupBy("id", "hash").agg(F.collect_list("spans").alias("spans"))
    found = named.join(spans, ["id", "hash"], "left").unionByName(rows.where(F.col("id").isNull()).withColumn("spans", F.lit(None).cast("array<binary>")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "body", 4 << 20):
                sizes, runs, kept = [], [], []
                for body, told in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    a, z = merged(*np.frombuffer(b"".join(told or []), "<i4").reshape(-1, 2).T)
                    sizes.append(len(body))
                    runs.append([{"start": s, "end": e} for s, e in zip(a.tolist(), z.tolist(), strict=True)])
                    bounds = [0, *np.stack([a, z], 1).ravel().tolist(), len(body)]
                    kept.append(b"".join(body[s:e] for s, e in zip(bounds[::2], bounds[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return found.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
