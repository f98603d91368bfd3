import random
import re

import xxhash
from pyspark.sql import functions as F

from loomwright.llm import simhash

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def slow_print(text, size=3):
    w = SPACE.findall((text or "").encode().lower())
    s = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, radius):
    prints = {(i, t): slow_print(t) for i, t in rows}
    distinct = sorted(set(prints.values()))
    parent = {p: p for p in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in distinct:
        for b in distinct:
            if a < b and (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    return {k: (f"{p:016x}", least.get(find(p))) for k, p in prints.items()}


def test_every_near_pair_meets():
    rng = random.Random(2)
    for radius in (1, 3, 4):
        masks = simhash.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and all(20 < m.bit_count() < 45 for m in masks)
        for _ in range(2000):
            d = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(d & m == 0 for m in masks)


def test_against_all_pairs(docs, corpus):
    rows = {(r[0], r[1]) for r in corpus}
    want = components(rows, 3)
    got = simhash.simhash_groups(docs.withColumn("fp", F.lit("clash"))).collect()
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.fingerprint, r.component_id) for r in got) == sorted(((r[0] if r[0] is not None else -1), *want[r[0], r[1]]) for r in corpus)
    assert len({r.component_id for r in got}) < len(rows)


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 5)
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(6)]
    fps = sorted({b ^ sum(1 << x for x in rng.sample(range(63), rng.randint(0, 5))) for b in base for _ in range(40)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in simhash.links(df, 3).collect():
        assert (r.a ^ r.b).bit_count() <= 3
        parent[find(r.a)] = find(r.b)
    got = {frozenset(f for f in fps if find(f) == find(x)) for x in fps}
    parent.update({f: f for f in fps})
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    assert got == {frozenset(f for f in fps if find(f) == find(x)) for x in fps}


def test_verified_groups(spark, docs, no_docs):
    words = [f"word{i}" for i in range(200)]
    near = words[:]
    near[100] = "other"
    far = words[:120] + [f"else{i}" for i in range(80)]
    rows = [(5, " ".join(words)), (9, " ".join(near)), (7, " ".join(far)), (8, " ".join(words)), (1, None), (2, ""), (3, "tiny"), (4, "tiny"), (None, "tiny"), (8, " ".join(words))]
    out = {r.doc_id: r.keeper for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {8: 5, 9: 5, 2: 1, 4: 3}
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.simhash_groups(no_docs).count() == 0


def edited_pairs(kind, n, rng):
    """Texts with a copy each whose five-word Jaccard similarity is 0.8 or a little more."""
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    share = [1 / (i + 1) for i in range(len(vocabulary))]
    for _ in range(n):
        w = rng.choices(vocabulary, share, k=rng.choice([100, 300, 1000]))
        least, copy = None, list(w)
        spots = rng.sample(range(5, len(w) - 5), len(w) // 10)
        at = rng.randrange(len(w) // 2)
        for i in range(len(w) // 3):
            if kind == "appended":
                copy = copy + [f"new{i}"]
            elif kind == "run":
                copy = [*w[:at], *(f"new{j}" for j in range(i + 1)), *w[at + i + 1 :]]
            elif i < len(spots):
                copy = [*copy]
                copy[spots[i]] = f"new{i}"
            a, b = ({tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (w, copy))
            if len(a & b) < 0.8 * len(a | b):
                break
            least = copy
        yield " ".join(w), " ".join(least)


def test_recall_at_the_least_similarity(spark):
    rng, rows, kinds = random.Random(9), [], ("appended", "run", "scattered")
    for kind in kinds:
        for a, b in edited_pairs(kind, 60, rng):
            rows += [(len(rows), a), (len(rows) + 1, b)]
    out = {r.doc_id: r.keeper for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(i % 2 and k == i - 1 for i, k in out.items())
    for k, kind in enumerate(kinds):
        assert sum(120 * k <= i < 120 * (k + 1) for i in out) >= 59, kind
