import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import induced, suffixes


def slow(t):
    order = sorted(range(len(t)), key=lambda i: tuple(t[i:]))
    prefix = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        prefix.append(min(k, induced.MOST))
    return order, prefix


@pytest.mark.parametrize(("page", "group", "chunk"), [(1, 1, 3), (1, 2, 1 << 16), (2, 64, 3), (5, 2, 7), (256, 64, 1 << 16)])
def test_suffix_order_and_prefixes(monkeypatch, tmp_path, page, group, chunk):
    for name, value in (("LEAST_PAGE", page), ("GROUP", group), ("CHUNK", chunk)):
        monkeypatch.setattr(induced, name, value)
    rng = random.Random(page + chunk)
    for trial in range(150):
        most = rng.choice([1, 2, 3, 8, 60])
        t = [rng.randint(1, most) for _ in range(rng.randint(0, 60))]
        t = (t * 3 if trial % 3 == 0 else t) + [0]
        order, prefix = induced.sort_suffixes(np.array(t), max(t) + 1, f"file://{tmp_path}", 64 if trial % 2 else 1 << 20)  # a small budget uses the disk
        want = slow(t)
        assert order.tolist() == want[0] and prefix.tolist() == want[1], t
    assert not list(tmp_path.iterdir())


def test_long_runs(tmp_path):
    t = np.array([1] * 700 + [2] * 300 + [1] * 400 + [0])
    order, prefix = induced.sort_suffixes(t, 3, f"file://{tmp_path}", 1 << 20)
    want = slow(t.tolist())
    assert order.tolist() == want[0] and prefix.tolist() == want[1]


def test_tuples_of_many_times_the_budget(tmp_path):
    """Repeated prose of 150 KB, whose tuples are over ten times what may stay in memory."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    line = lambda: " ".join(rng.choice(words) for _ in range(40))
    lines = [line() for _ in range(60)]
    body = "\n".join(rng.choice(lines) if rng.random() < 0.4 else line() for _ in range(900)).encode() + b"ab" * 2000
    body = body[:150_000]
    t = np.append(np.frombuffer(body, np.uint8).astype(np.int16) + 1, 0).astype(np.int16)
    budget = 9 * len(t) // 12
    with induced.Disk(f"file://{tmp_path}", budget) as disk:
        parts = list(induced.suffixes_descending(t, 258, disk))
        assert disk.written > 10 * budget
        assert disk.held < budget
    got = np.concatenate([p for p, _ in parts])[::-1]
    want = sorted(range(len(body) + 1), key=lambda i: body[i : i + 5000])
    assert got.tolist() == want
    shared = np.concatenate([p for _, p in parts])[:0:-1].tolist()
    for k in range(1, len(want), 37):
        a, b = body[want[k - 1] :][:255], body[want[k] :][:255]
        assert shared[k - 1] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


class Counted:
    """numpy, with a count of the elements that minimum() makes."""

    def __init__(self):
        self.made, self.minimum = 0, self
        self.accumulate, self.reduceat = np.minimum.accumulate, np.minimum.reduceat

    def __getattr__(self, name):
        return getattr(np, name)

    def __call__(self, *a, **b):
        out = np.minimum(*a, **b)
        self.made += np.size(out)
        return out


def test_a_part_costs_what_it_holds(monkeypatch, tmp_path):
    """Each part of a scan keeps the queues' least values without going over all characters."""
    counted = Counted()
    monkeypatch.setattr(induced, "np", counted)
    rng = random.Random(2)
    t = np.append(np.array([rng.randint(1, 40_000) for _ in range(40_000)]), 0)
    order, _ = induced.sort_suffixes(t, 40_001, f"file://{tmp_path}", 1 << 20)
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i : i + 8].tolist())
    assert counted.made < 20 * len(t)


def brute(rows, length):
    """text by (doc_id, text) without the bytes that an earlier document's strings cover."""
    first = {}
    for i, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - length + 1):
            if i is not None:
                w = b[p : p + length]
                first[w] = min(first.get(w, i), i)
    out = {}
    for i, text in rows:
        b, gone = (text or "").encode(), set()
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < i:
                gone |= set(range(p, p + length))
        runs = sum(p - 1 not in gone for p in gone)
        out[i, text] = (len(b), len(gone), runs, bytes(x for p, x in enumerate(b) if p not in gone))
    return out


def compare(docs, rows, length=50):
    got = suffixes.dedup_substrings(docs, length)
    want = brute({(r[0], r[1]) for r in rows}, length)
    told = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got.collect())
    assert told == sorted(((r[0] if r[0] is not None else -1), *want[r[0], r[1]]) for r in rows)
    return told


def test_against_brute_force(docs, corpus):
    assert sum(x[2] for x in compare(docs.withColumn("hash", F.lit("clash")).withColumn("spans", F.lit(1)), corpus)) > 500


def test_many_shards_and_hot_stretches(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 2000)
    monkeypatch.setattr(suffixes, "HOT", 1)
    monkeypatch.setattr(suffixes, "TUPLE_BYTES", 4000)
    compare(docs, corpus)
    line = "The same opening line of every text in this place. "
    rows = [(i, line + "".join(random.Random(i).choice("abcd ") for _ in range(90))) for i in range(40)]
    compare(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def pieces(rng, n):
    """(ids, pieces): random bytes with common parts, some of which several ids have."""
    common = ["".join(rng.choice("ab") for _ in range(rng.randint(8, 40))) for _ in range(5)]
    out = [(rng.randint(1, 6), ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) + rng.choice(common) + "".join(rng.choice("abc") for _ in range(rng.randint(0, 3)))).encode()) for _ in range(n)]
    return np.array([i for i, _ in out]), [b for _, b in out]


@pytest.mark.parametrize("hashed", [5, 1 << 19])
def test_a_shard_sorts_what_several_documents_share(monkeypatch, hashed):
    """Windows of one document alone aren't sorted, nor a run's copies; no shared window is left out."""
    monkeypatch.setattr(suffixes, "HASHED", hashed)
    rng = random.Random(hashed)
    for _ in range(60):
        ids, parts = pieces(rng, rng.randint(1, 25))
        sizes, data = np.array([len(b) for b in parts]), np.frombuffer(b"".join(parts), np.uint8)
        holders = {}
        for i, b in zip(ids.tolist(), parts, strict=True):
            for p in range(len(b) - 7):
                holders.setdefault(b[p : p + 8], set()).add(i)
        want = {(k, p) for k, b in enumerate(parts) for p in range(len(b) - 7) if len(holders[b[p : p + 8]]) > 1}
        piece, start, end = suffixes.shared_runs(data, sizes, ids, 8)
        begins = np.cumsum(sizes) - sizes
        got = [(k, p - begins[k]) for k, a, z in zip(piece, start, end, strict=True) for p in range(a, z - 7)]
        assert len(got) == len(want) and set(got) == want
        bodies = [bytes(data[a:z]) for a, z in zip(start, end, strict=True)]
        least = {}
        for i, b in zip(ids[piece], bodies, strict=True):
            least[b] = min(least.get(b, i), i)
        assert suffixes.copies(data, start, end, ids[piece]).tolist() == [i > least[b] for i, b in zip(ids[piece], bodies, strict=True)]


def test_copies_are_compared_byte_for_byte(monkeypatch):
    monkeypatch.setattr(suffixes, "_slice_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    data, ends = np.frombuffer(b"aabbaabba", np.uint8), np.array([2, 4, 6, 9])
    assert suffixes.copies(data, np.array([0, 2, 4, 6]), ends, np.array([1, 2, 3, 4])).tolist() == [False, False, True, False]


def test_a_hot_window_is_sent_once_a_batch():
    sent, gone = suffixes.settled_windows({b"x" * 50: [(i, 7, 3) for i in range(500, 0, -1)], b"y" * 50: [(9, 1, 0), (9, 2, 4)]})
    assert sent == [(1, 7, 3, b"x" * 50), (9, 1, 0, b"y" * 50), (9, 2, 4, b"y" * 50)] and len(gone) == 499


def test_rows_of_a_batch_repeat_by_both_hashes():
    h, c = np.array([5, 5, 5, 6, 5], np.uint64), np.array([1, 1, 2, 1, 1], np.uint64)
    assert suffixes._repeats(np.array([3, 2, 9, 9, 2]), h, c).tolist() == [True, False, False, False, False]


def test_documents_meet_in_their_buckets():
    """Spans of a document come in several blobs; runs that end where another document's begin stay apart."""
    rng = random.Random(4)
    rows = [(rng.choice([-3, 2, 7]), rng.choice([-9, 5]), a := rng.randint(0, 90), a + rng.randint(1, 9)) for _ in range(60)]
    blobs, last = {}, (1 << 31) - 1
    for some in (rows[:20], rows[20:], [(2, 5, last - 5, last), (7, -9, 0, 1)]):
        i, x, a, z = np.array(some).T
        for bucket, blob in suffixes._in_buckets(i, x, np.stack([a, z], 1), 3):
            blobs.setdefault(bucket, []).append(blob)
    got = {(i, x): np.frombuffer(told, "<i4").reshape(-1, 2).tolist() for held in blobs.values() for i, x, told in suffixes._of_buckets(held, 2, True)}
    assert sum(len(list(suffixes._of_buckets(held, 2, False))) for held in blobs.values()) == len(got) == 6
    rows += [(2, 5, last - 5, last), (7, -9, 0, 1)]
    for name, runs in got.items():
        assert {p for a, z in runs for p in range(a, z)} == {p for i, x, a, z in rows if (i, x) == name for p in range(a, z)}
        assert all(z < a for (_, z), (a, _) in zip(runs, runs[1:], strict=False))
    assert list(suffixes._in_buckets(*np.zeros((2, 0), np.int64), np.zeros((0, 2)), 3)) == []


def test_odd_tables(spark, no_docs):
    assert suffixes.dedup_substrings(no_docs).count() == 0
    short = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 49), (None, "y" * 80), (5, "y" * 80), (6, "y" * 80)]
    compare(spark.createDataFrame(short, "doc_id long, text string"), short)
