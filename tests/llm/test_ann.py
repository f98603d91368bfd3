import numpy as np

from loomwright.llm import ann


def truth(ids, x, q, k):
    i = ids.index(q)
    s = x @ x[i] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[i]))
    order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[j], ids[j]))[:k]
    return [(ids[j], s[j]) for j in order]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 16))
    x = (centres[rng.integers(0, 20, 900)] + 0.4 * rng.standard_normal((900, 16))).astype(np.float32)
    ids = list(range(900))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, score int")
    out = ann.nearest(df, df.where("vec_id % 50 = 0"), 5).collect()
    hits = total = 0
    for q in range(0, 900, 50):
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == [1, 2, 3, 4, 5]
        want = truth(ids, x.astype(float), q, 5)
        hits += len({r.vec_id for r in got} & {i for i, _ in want})
        total += 5
        s = {i: v for i, v in truth(ids, x.astype(float), q, 900)}
        assert all(abs(s[r.vec_id] - r.score) < 1e-12 for r in got)
        assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    assert hits / total >= 0.9


def test_copies_odd_vectors_and_few_candidates(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 30)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [float("inf"), 1.0]), (104, [None, 1.0]), (105, []), (None, [1.0, 2.0]), (50, [2.0, -1.0]), (3, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.nearest(df, df.where("vec_id in (0, 50, 100)"), 3)
    got = {(r.query_id, r.rank): (r.vec_id, round(r.score, 12)) for r in out.collect()}
    assert [got[0, r] for r in (1, 2, 3)] == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert [got[50, r] for r in (1, 2, 3)] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    assert len(got) == 6
    few = spark.createDataFrame([(1, [1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.rank) for r in ann.nearest(few, few.where("vec_id = 1"), 5).collect()] == [(2, 1)]


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(none, none).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(one, one).count() == 0


def test_recall_on_the_table(spark):
    """All queries of the embeddings table against all rows, in several blocks."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect() if r.embedding is not None}
    ids = sorted(rows)
    x = np.stack([rows[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in ann.nearest(table, table.where("vec_id % 50 = 0"), 5, block=500).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in (i for i in ids if i % 50 == 0):
        s = x @ x[ids.index(q)]
        s[ids.index(q)] = -2
        hits += len({ids[j] for j in np.argsort(-s)[:5]} & found[q])
        total += 5
    assert hits / total >= 0.9, hits / total


def test_ties_go_to_smaller_ids(spark):
    df = spark.createDataFrame([(i, [float(2**i), float(2**i)]) for i in range(30)], "vec_id long, embedding array<double>")
    for block in (4, 1000):
        out = ann.nearest(df, df.where("vec_id in (0, 7)"), 5, block=block).collect()
        assert sorted((r.query_id, r.rank, r.vec_id) for r in out) == [(0, r, r) for r in range(1, 6)] + [(7, r, r - 1) for r in range(1, 6)]


def test_descent_finds_the_longest_prefix():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((200, 6))
    forest = ann.Forest(x, 5, 0.97)
    bits, asked = forest.strings(x), forest.strings(rng.standard_normal((40, 6)))
    want = [max(64 - int(a ^ b).bit_length() for row in bits for a, b in zip(row, q, strict=True)) for q in asked]
    assert forest.longest(asked).tolist() == want


def test_ascent_visits_what_shares_the_prefix():
    """With a recall that nothing reaches, the ascent ends at the root and so is exact."""
    rng = np.random.default_rng(9)
    x, q = rng.standard_normal((300, 8)), rng.standard_normal((50, 8))
    asks, place, score = ann.Forest(x, 3, 2.0).search(q, 5)
    s = q @ x.T / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :]
    for i in range(50):
        assert set(place[asks == i]) == set(np.argsort(-s[i])[:6])
        assert np.allclose(np.sort(score[asks == i]), np.sort(s[i])[-6:])
