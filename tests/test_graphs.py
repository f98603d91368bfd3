"""Cycles, components and orders of graphs against plain walks."""

import random

import pytest

from loomwright import graphs
from loomwright.plans import changeplan


def leads_back(edges):
    after = {}
    for a, b in edges:
        if a is not None and b is not None:
            after.setdefault(a, set()).add(b)
    out = set()
    for node in after:
        seen, front = set(), list(after[node])
        while front:
            x = front.pop()
            if x not in seen:
                seen.add(x)
                front += after.get(x, ())
        if node in seen:
            out.add(node)
    return out


@pytest.mark.parametrize("case", ["ring", "nested", "random", "none"])
def test_cycles(spark, case):
    rng = random.Random(3)
    edges = {
        "ring": [(f"r{i:05d}", f"r{(i + 1) % 10_000:05d}") for i in range(10_000)] + [("r00007", "out"), ("in", "r00009")],
        "nested": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "x"), ("y", "a"), ("e", "z"), ("p", "q"), ("q", "r"), ("r", "p"), ("r", "s"), ("s", "q"), ("a", "b"), (None, "a"), ("a", None)],
        "random": [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(75)],
        "none": [("a", "b"), ("b", "c"), ("a", "c")],
    }[case]
    found = [r.node for r in graphs.cycle_nodes(spark.createDataFrame(edges, "a string, b string")).collect()]
    want = {f"r{i:05d}" for i in range(10_000)} if case == "ring" else leads_back(edges)
    assert len(found) == len(set(found)) and set(found) == want


def test_components_of_a_star(spark):
    """A third of all links meet in one node."""
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000, 5000), (None, 3), (0, 7)]
    found = {r.node: r.component for r in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(400)} | {1000 + i: 1000 for i in range(301)}


def test_one_comparison_is_ordered_by_components(spark, monkeypatch):
    """A hot comparison: a task sees a component, and what comes after a cycle comes behind all of its members."""
    rng = random.Random(5)
    ids = [f"i{i:03d}" for i in range(240)]
    rows = [(1, i, rng.choice(["CREATE", "DROP"]), rng.choice(["TABLE", "VIEW", "UNHEARD_OF"]), f"k{rng.randrange(30)}") for i in ids] + [(2, "alone", "DROP", "TABLE", "k")]
    edges = [(1, ids[b], ids[a]) for at in range(0, 240, 24) for a, b in (sorted(rng.sample(range(at, at + 24), 2)) for _ in range(20))]
    edges += [(1, ids[0], ids[1]), (1, ids[1], ids[0]), (1, ids[5], "unknown"), (1, ids[6], ids[6])]
    changes = spark.createDataFrame(rows, "comparison_id int, id string, kind string, object_type string, object_key string")
    deps = spark.createDataFrame(edges, "comparison_id int, id string, needs string")
    place = {(r.comparison_id, r.id): r.position for r in changeplan.order_changes(changes, changeplan.ordering_edges(deps)).collect()}
    assert place.pop((2, "alone")) == 1
    in_cycle = leads_back([(a, b) for _, a, b in edges])

    def key(r):
        rank = changeplan.RANKS.get(r[3], len(changeplan.RANKS))
        return (r[2] == "DROP", -rank if r[2] == "DROP" else rank, r[4], r[1])

    left, want = {r[1]: r for r in rows if r[0] == 1}, []
    while left:
        ready = [r for i, r in left.items() if not any(e[1] == i and e[2] in left and not (i in in_cycle and e[2] in in_cycle) for e in edges)]
        want.append(left.pop(min(ready, key=key)[1])[1])
    assert [i for (_, i), _ in sorted(place.items(), key=lambda x: x[1])] == want
