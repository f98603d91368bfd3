import hashlib
import math
import random
import zlib

import pytest

from loomwright.llm import scans, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The trie from dictionaries alone."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    new = {c: own.get(c - int(math.fmod(c, 100)), [])[: h[c]] + own[c][h[c] :] for c in own}
    nodes = {}
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(m for m in members if len(new[m]) == len(path)))
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed):
    rng, rows = random.Random(seed), []
    for c in [*range(40), *range(100, 130), 205, 399, -3, 10**12]:
        for i in range(rng.choice([0, 1, 2, 3, 7, 12])):
            rows.append((c, i, rng.choice(["user", "assistant", None]), rng.choice(["a", "é😀", "", None, "b" * 50])))
    rows += [(7, None, "user", "first"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (None, 0, "user", "nobody"), (9, 1, None, "x" * 5_000_000)]
    rng.shuffle(rows)
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("here", [30, 1 << 18])
def test_against_dictionaries(spark, here):
    rows = conversations(here)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as depth", "1 as x", "2 as ends").repartition(5)
    out = trie.conversation_trie(df, here)
    found = [tuple(r[c] for c in COLUMNS) for r in out.collect()]
    assert len(found) == len(set(found))
    assert set(found) == plain(rows)
    places = sorted(x for r in out.select("enter", "leave").collect() for x in r)
    assert places == list(range(1, 2 * len(found) + 1))


def test_one_long_conversation_and_many_copies(spark):
    """A third of the turns in one conversation, and one conversation copied many times: ranges cut both."""
    rows = [(1, i, "user", str(i % 3)) for i in range(600)] + [(c, i, "user", "same") for c in range(1000, 1150) for i in range(3)]
    found = {tuple(r[c] for c in COLUMNS) for r in trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == plain(rows)


def test_no_conversations(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_scan_carries_over_ranges(spark):
    rng = random.Random(1)
    rows = [(s, i, rng.getrandbits(60)) for s, n in [(1, 1), (2, 300), (3, 2), (5, 70)] for i in range(n)]
    out = scans.exclusive_scan(spark.createDataFrame(rows, "s long, i long, v long").repartition(4), ["s"], ["i"], ["i", "v"], xor=("v",), last=("i", "v"), ranges=17).collect()
    want, acc, before = set(), {}, {}
    for s, i, v in rows:
        want.add((s, i, i, acc.get(s, 0), *(before.get(s, (None, None)))))
        acc[s], before[s] = acc.get(s, 0) ^ v, (i, v)
    assert {(r.s, r.i, r.before, r.before_v, r.previous_i, r.previous_v) for r in out} == want and len(out) == len(rows)


@pytest.mark.parametrize("here", [1, 1000])
def test_list_rank(spark, here):
    rng = random.Random(2)
    ids = [rng.getrandbits(50) for _ in range(40)]
    lists = [ids[:1], ids[1:15], ids[15:]]
    rows = [(a, b, rng.randint(0, 9)) for x in lists for a, b in zip(x, [*x[1:], None], strict=True)]
    weight = {a: w for a, _, w in rows}
    want = {(a, sum(weight[b] for b in x[:k])) for x in lists for k, a in enumerate(x)}
    rng.shuffle(rows)
    out = scans.list_rank(spark.createDataFrame(rows, "id long, next long, w long"), ["w"], here).collect()
    assert {tuple(r) for r in out} == want and len(out) == len(rows)
