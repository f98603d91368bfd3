"""Batches of edits against a plain table that they change one after another."""

import random

import pytest

from loomwright.operators import edits

KEY = ["a", "b"]
SCHEMA = "edit_id int, edit_seq int, op string, key struct<a:string,b:string>, values map<string,string>"


def plain(rows, batch):
    rows, told = [dict(r) for r in rows], {}
    number = lambda v: None if v in (None, "") else int(v)
    for edit_id, _, op, key, values in sorted(batch, key=lambda e: (e[1], e[0])):
        if op != "DELETE" and (not values or "no" in values or "bad" in (values.get("a"), values.get("v"))):
            told[edit_id] = (0, "INVALID")
        elif op == "INSERT":
            rows.append({"a": number(values.get("a")), "b": values.get("b"), "v": number(values.get("v"))})
            told[edit_id] = (1, "APPLIED")
        elif key[0] == "bad":
            told[edit_id] = (0, "INVALID")
        else:
            hit = [r for r in rows if (r["a"], r["b"]) == (number(key[0]), key[1])]
            told[edit_id] = (len(hit), "APPLIED" if len(hit) == 1 else "AMBIGUOUS" if hit else "STALE")
            if len(hit) == 1 and op == "DELETE":
                rows.remove(hit[0])
            elif len(hit) == 1:
                hit[0].update({c: v if c == "b" else number(v) for c, v in values.items()})
    return rows, told


def batch_of(rng, n, names):
    a, b = lambda: rng.choice([*names, None]), lambda: rng.choice(["x", "y", None])
    out = []
    for i in range(n):
        values = {c: f() for c, f in (("a", a), ("b", b), ("v", lambda: str(rng.randrange(100)))) if rng.random() < 0.5}
        if rng.random() < 0.05:
            values[rng.choice(["no", "v"])] = "bad"
        op = rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"])
        key = ("bad" if rng.random() < 0.03 else a(), b())
        out.append((i, rng.randrange(n), op, None if op == "INSERT" else key, None if op == "DELETE" else values))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches(spark, seed):
    rng = random.Random(seed)
    names = [str(i) for i in range(12)] if seed == 1 else [str(i) for i in range(60)]
    rows = [{"a": rng.choice([*range(40), None]), "b": rng.choice(["x", "y", None]), "v": i} for i in range(70)]
    batch = batch_of(rng, 150, names)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "a int, b string, v int")
    out, told = edits.replay(df, spark.createDataFrame(batch, SCHEMA), KEY)
    want, known = plain(rows, batch)
    assert {r.edit_id: (r.matched, r.status) for r in told.collect()} == known
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str((r["a"], r["b"], r["v"])) for r in want)
    assert all((r.message is None) == (r.status == "APPLIED") for r in told.collect())


def test_one_key_in_half_of_the_table_and_of_the_edits(spark):
    """The hot key's rows are counted, and its edits stream through one group in order."""
    rows = [{"a": 1, "b": "hot", "v": i} for i in range(500)] + [{"a": i, "b": "x", "v": i} for i in range(500)]
    batch = [(i, i, "UPDATE", ("1", "hot"), {"v": "0"}) for i in range(200)] + [(200 + i, i, "UPDATE", (str(i), "x"), {"a": str(i + 1)}) for i in range(3)] + [(300 + i, 300 + i, "UPDATE", ("9", "x"), {"v": str(i)}) for i in range(200)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "a int, b string, v int")
    out, told = edits.replay(df, spark.createDataFrame(batch, SCHEMA), KEY)
    want, known = plain(rows, batch)
    assert {r.edit_id: (r.matched, r.status) for r in told.collect()} == known
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str((r["a"], r["b"], r["v"])) for r in want)


def test_deletes_stop_at_the_first_failure_and_pass_new_rows(spark):
    df = spark.createDataFrame([(i, "x", i) for i in range(5)], "a int, b string, v int")
    asked = [(1, 1, ("0", "x"), False), (2, 2, ("77", "x"), True), (3, 3, ("1", "x"), None), (4, 4, ("1", "x"), False), (5, 5, ("2", "x"), False)]
    told = spark.createDataFrame(asked, "edit_id int, edit_seq int, key struct<a:string,b:string>, is_new boolean")
    left, said = edits.apply_ordered_deletes(df, told, KEY)
    assert sorted(r.a for r in left.collect()) == [2, 3, 4]
    assert {r.edit_id: r.status for r in said.collect()} == {1: "APPLIED", 2: "NEW", 3: "APPLIED", 4: "STALE", 5: "SKIPPED"}


def test_nothing_to_do(spark):
    df = spark.createDataFrame([(1, "x", 1)], "a int, b string, v int")
    out, told = edits.replay(df, spark.createDataFrame([], SCHEMA), KEY)
    assert [tuple(r) for r in out.collect()] == [(1, "x", 1)] and told.count() == 0
    out, told = edits.replay(df.limit(0), spark.createDataFrame([(1, 1, "INSERT", None, {"a": "5"})], SCHEMA), KEY)
    assert [tuple(r) for r in out.collect()] == [(5, None, None)] and [r.status for r in told.collect()] == ["APPLIED"]
