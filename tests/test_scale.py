"""Row numbers and written files on tables of many partitions."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from loomwright.operators import browse, exports


@pytest.mark.parametrize("partitions", [8, 200])
def test_row_numbers_have_no_gaps(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        n = 3_000_000
        rows = spark.range(n).select(F.xxhash64("id").alias("k"), "id", F.sha2(F.col("id").cast("string"), 256).alias("payload"), F.repeat(F.lit("wide "), 12).alias("more"))
        found = browse.number_rows(rows, [("k", True)])
        told = found.agg(F.count("*").alias("n"), F.countDistinct("row_no").alias("d"), F.min("row_no").alias("a"), F.max("row_no").alias("z")).first()
        assert tuple(told) == (n, n, 1, n)
        # Neighbours in number are neighbours in order, at the bounds of ranges too.
        pairs = found.select("k", "row_no")
        wrong = pairs.join(pairs.select(F.col("k").alias("next"), (F.col("row_no") - 1).alias("row_no")), "row_no").where("k > next")
        assert wrong.isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_row_numbers_of_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (0, "c")], "k int, v string")
    found = {(r.k, r.v, r.row_no) for r in browse.number_rows(rows, [("k", True)], 10).collect()}
    assert found == {(0, "c", 11), (1, "a", 12), (1, "a", 13), (None, "b", 14)}
    assert browse.number_rows(rows.limit(0), [("k", True)]).count() == 0


def test_csv_files_have_one_header_each(spark, tmp_path):
    path = f"{tmp_path}/csv"
    exports.write_csv(spark.range(0, 4000, 1, 40).select("id", F.lit('a,"b"').alias("t")), path)
    files, seen = glob.glob(f"{path}/*.txt"), []
    assert len(files) == 40
    for name in files:
        lines = open(name, encoding="utf-8", newline="").read().split("\r\n")
        assert lines[0] == "﻿id,t" and lines[-1] == "" and not any("id" in x for x in lines[1:])
        seen += [int(x.split(",")[0]) for x in lines[1:-1]]
    assert sorted(seen) == list(range(4000)) and not os.path.exists(f"{path}/part")


def test_order_of_changes_is_the_plain_one(spark):
    """Of the changes whose needs are placed, the least by (drop, rank, key, id) comes next; what is in a cycle comes last."""
    import random

    from loomwright.plans import changeplan

    rng, rows, edges = random.Random(4), [], []
    kinds, types = ["CREATE", "ALTER", "DROP"], ["TABLE", "INDEX", "VIEW", "SEQUENCE", "TRIGGER"]
    for c in range(3):
        ids = [f"c{c}-{i:02d}" for i in range(40)]
        rows += [(c, i, rng.choice(kinds), rng.choice(types), f"k{rng.randrange(12)}") for i in ids]
        edges += [(c, ids[b], ids[a]) for a, b in (sorted(rng.sample(range(40), 2)) for _ in range(50))] + [(c, ids[3], ids[5]), (c, ids[5], ids[3])]
    want = set()
    for c in range(3):
        def key(r):
            rank = changeplan.RANKS[r[3]]
            return (r[2] == "DROP", -rank if r[2] == "DROP" else rank, r[4], r[1])

        left, placed = {r[1]: r for r in rows if r[0] == c}, []
        while left:
            ready = [r for i, r in left.items() if not any(e[0] == c and e[1] == i and e[2] in left and e[2] != i for e in edges)]
            for r in [min(ready, key=key)] if ready else sorted(left.values(), key=key):
                placed.append(left.pop(r[1])[1])
        want |= {(c, i, n + 1) for n, i in enumerate(placed)}
    changes = spark.createDataFrame(rows, "comparison_id int, id string, kind string, object_type string, object_key string")
    out = changeplan.order_changes(changes, spark.createDataFrame(edges, "comparison_id int, id string, needs string"))
    assert {(r.comparison_id, r.id, r.position) for r in out.collect()} == want


def test_a_selection_that_does_not_settle_is_an_error(spark, monkeypatch):
    from loomwright.plans import changeplan

    monkeypatch.setattr(changeplan, "ROUNDS", 1)
    ids = [f"x{i}" for i in range(5)]
    changes = spark.createDataFrame([(1, i, "ALTER", "SAFE_AUTOMATIC") for i in ids], "comparison_id int, id string, kind string, automation string")
    edges = spark.createDataFrame([(1, a, b) for a, b in zip(ids, [*ids[1:], "gone"], strict=True)], "comparison_id int, id string, needs string")
    with pytest.raises(RuntimeError):
        changeplan.select_changes(changes, edges, changes.select("comparison_id", "id"))
