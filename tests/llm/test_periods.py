import hashlib
import random
import zlib

import numpy as np
import pytest

from loomwright.llm import periods, queries


def plain(words, least=12):
    """All maximal runs, by looking at every period."""
    found, spans = [], set()
    for q in range(1, len(words) // 2 + 1):
        x = 0
        while x + q < len(words):
            start = x
            while x + q < len(words) and words[x] == words[x + q]:
                x += 1
            if x + q - start >= max(least, 2 * q) and (start, x + q) not in spans:
                spans.add((start, x + q))
                found.append((start, x + q, q))
            x += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences(rng):
    a, b, t = [0], [0, 1], [0]
    for _ in range(8):
        a, b = b, b + a
    for _ in range(7):
        t = t + [1 - x for x in t]
    yield from (a, t, [0] * 50, [], [1], [0, 1] * 6)
    for _ in range(150):
        yield [rng.randint(0, 1 + rng.randint(0, 2)) for _ in range(rng.randint(0, 150))]
        unit = [rng.randint(0, 2) for _ in range(rng.randint(1, 12))]
        yield (unit * 20)[: rng.randint(1, 60)] + [rng.randint(0, 2)] + (unit * 20)[rng.randint(0, 3) : rng.randint(4, 60)]
        half = (unit * 20)[: rng.randint(5, 40)]
        yield half + half[rng.randint(0, 3) :] + half + [7] + half


def test_runs_against_every_period():
    rng = random.Random(4)
    texts = list(sequences(rng))
    for at in range(0, len(texts), 9):
        some = texts[at : at + 9]
        words, text = np.array(sum(some, []), np.int64), np.repeat(np.arange(len(some)), [len(x) for x in some])
        got = list(zip(*(x.tolist() for x in periods.runs(words, text)), strict=True))
        starts = np.cumsum([0, *map(len, some)])
        assert got == [(a + s, b + s, q) for x, s in zip(some, starts.tolist(), strict=False) for a, b, q in plain(x)]


def test_wavelet_tree():
    rng = np.random.default_rng(5)
    values = rng.permutation(1000)
    tree = periods.WaveletTree(values, 1000)
    lo = rng.integers(0, 1000, 500)
    hi, x = lo + rng.integers(0, 100, 500).clip(0, 1000 - lo), rng.integers(0, 1100, 500)
    want = [min((v for v in values[a:b].tolist() if v >= c), default=-1) for a, b, c in zip(lo, hi, x, strict=True)]
    assert tree.successor(lo, hi, x).tolist() == want


def test_least_run():
    with pytest.raises(ValueError, match="under 12"):
        periods.runs(np.zeros(3, np.int64), np.zeros(3, np.int64), 3)


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = [(s, e - s, q) for s, e, q in plain(words)]
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def odd_documents():
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abé") for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t\n\x0b\x0c\r "), (None, "a b " * 20), (503, "x y " * 30), (504, "a\x1fb " * 14), rows[0], rows[3], (3, "other " * 15)]
    return rows


def test_query(spark, tmp_path):
    rows = odd_documents()
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as runs", "1 as start", "2 as collapsed").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in queries.op12_periods(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted((expected(*r) for r in rows), key=key)


def test_very_long_text(spark):
    unit = " ".join(str(i * i % 7919) for i in range(1000))
    (row,) = periods.periodic_runs(spark.createDataFrame([(1, " ".join([unit] * 1000))], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(0, 1_000_000, 1000)] and row.collapsed == unit
    assert periods.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
