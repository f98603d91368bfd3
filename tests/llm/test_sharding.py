import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import queries, sharding
from loomwright.llm.common import fresh_path


def plain(n, seed, i):
    """The permutation of one number, in Python's own integers."""
    m = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
        return x ^ (x >> 31)

    bits = max(2, (n - 1).bit_length())
    low, high = bits // 2, bits - bits // 2
    while True:
        left, right = i >> low, i & ((1 << low) - 1)
        for r in range(8):
            key = mix((r + 1) * 0x9E3779B97F4A7C15 + seed & m)
            if r % 2:
                right ^= mix(left + key & m) & ((1 << low) - 1)
            else:
                left ^= mix(right + key & m) & ((1 << high) - 1)
        i = left << low | right
        if i < n:
            return i


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    p, numbers = sharding.Permutation(n, 7), np.arange(n)
    at = p.position(numbers)
    assert at.tolist() == [plain(n, 7, i) for i in range(n)]
    assert sorted(at.tolist()) == list(range(n))
    assert p.number(at).tolist() == numbers.tolist()
    shard, slot = sharding.locate(p, numbers, 16)
    for s in set(shard.tolist()):
        mine = np.flatnonzero(shard == s)
        assert sorted(slot[mine].tolist()) == list(range(len(mine)))
        assert sharding.number_at(p, s, slot[mine], 16).tolist() == mine.tolist()
    with pytest.raises(ValueError, match="under"):
        p.position(np.array([n]))


def test_assignment(spark, docs, corpus):
    clashing = docs.withColumns({"shard": F.lit("x"), "slot": F.lit(1), "__at": F.lit(2), "size": F.lit("y")})
    out = sharding.assign_shards(clashing).collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=key) == sorted(((r[0], size(r[1]), crc(r[1])) for r in corpus), key=key)
    assert [r.row_number for r in sorted(out, key=lambda r: r.row_number)] == list(range(len(corpus)))
    ids = [r.doc_id for r in sorted(out, key=lambda r: r.row_number)]
    assert ids == sorted((i for i in ids if i is not None)) + [None] * ids.count(None)
    n = len(corpus)
    for r in out:
        at = plain(n, 13, r.row_number)
        assert (r.shard, r.slot) == (at % 16, at // 16)
    counts = [sum(r.shard == s for r in out) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    # Files and partitions don't matter, equal rows aside.
    again = sharding.assign_shards(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=key) == sorted(map(tuple, out), key=key)
    other = sharding.assign_shards(docs, seed=14).collect()
    assert sorted(map(tuple, other), key=key) != sorted(map(tuple, out), key=key)


def test_odd_tables(spark, no_docs):
    assert sharding.assign_shards(no_docs).count() == 0
    same = spark.createDataFrame([(1, "same")] * 300 + [(2, "z" * 5_000_000)], "doc_id long, text string")
    out = sharding.assign_shards(same).collect()
    assert sorted(r.row_number for r in out) == list(range(301))
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(16) for k in range(19 if s < 13 else 18)]


def test_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_shards(spark, str(tmp_path))
    assert dict(out.dtypes) | {"row_number": "bigint"} == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int", "row_number": "bigint"}
    assert {(r.law, r.grown_shard) for r in out.collect()} == {("rows", None)}


def test_written_shards(spark, docs, corpus):
    folder = fresh_path(spark, "shards")
    out = sharding.write_shards(docs, folder, 4, rows_a_file=10)
    assert out.count() == len(corpus) and set(docs.columns) < set(out.columns)
    want = {(r.row_number, r.shard, r.slot) for r in sharding.assign_shards(docs, 4).collect()}
    assert {(r.row_number, r.shard, r.slot) for r in out.collect()} == want
    # A file holds a stretch of a shard's slots, in order.
    spans = {}
    for r in out.select(F.input_file_name().alias("f"), "shard", "slot", F.monotonically_increasing_id().alias("i")).collect():
        spans.setdefault((r.f, r.shard), []).append((r.i, r.slot))
    for rows in spans.values():
        slots = [s for _, s in sorted(rows)]
        assert slots == list(range(slots[0], slots[0] + len(slots)))
    with pytest.raises(ValueError, match="clash"):
        sharding.write_shards(docs.withColumn("Slot", F.lit(1)), folder)
