import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwright.llm import toxicity
from loomwright.llm.common import payload


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4))) for _ in range(300)]
    bad = ["foulone", "foultwo", "foulthree", "foulfour"]
    out = []
    for i in range(400):
        w = [rng.choice(words) for _ in range(60)]
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad).upper() + "!")
        out.append((i, " ".join(w), int(toxic)))
    return out


@pytest.fixture(scope="module")
def index(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i % 4 != 2] + [(1, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    return toxicity.train(docs, labels)


def test_held_out_rows(spark, rows, index):
    held = [r for r in rows if r[0] % 4 == 2]
    docs = spark.createDataFrame([r[:2] for r in held], "doc_id long, text string").withColumn("score", F.lit("clash"))
    out = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    assert sum(out[i].predicted == t for i, _, t in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    assert all(len(r.evidence) == len(r.similarity) <= toxicity.NEIGHBOURS for r in out.values())


def test_nearest_is_exact(spark, rows, index):
    """Evidence and cosines against plain TF-IDF that is computed from the texts alone, over every word of the examples."""
    bags = {i: Counter(text.lower().replace("!", " ").split()) for i, text, _ in rows}
    taught = [i for i, _, _ in rows if i % 4 != 2]
    holders = Counter(w for bag in bags.values() for w in bag)
    vocabulary = {w for i in taught for w in bags[i]}
    idf = {w: math.log((1 + len(rows)) / (1 + holders[w])) + 1e-6 for w in vocabulary}
    assert len(index.terms) == len(vocabulary)

    def vector(i):
        v = {w: (1 + math.log(c)) * idf[w] for w, c in bags[i].items() if w in vocabulary}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    vectors = {i: vector(i) for i in bags}
    docs = spark.createDataFrame([r[:2] for r in rows[:60]], "doc_id long, text string")
    for r in toxicity.score(docs, index).collect():
        cosine = {j: sum(x * vectors[j].get(w, 0.0) for w, x in vectors[r.doc_id].items()) for j in taught}
        assert np.allclose(sorted((s for s in cosine.values() if s > 0), reverse=True)[: toxicity.NEIGHBOURS], r.similarity, atol=1e-9)
        assert np.allclose([cosine[j] for j in r.evidence], r.similarity, atol=1e-9) and len(set(r.evidence)) == len(r.evidence)


def test_relevant_part(index, rows):
    """The second vote's parts against sums over dense rows."""
    data = pa.array([text for _, text, _ in rows[:50]])
    row, term, w, length = index.vectors(*payload(data))
    near = index.nearest(row, term, w, 50, toxicity.NEIGHBOURS)
    asked, known = np.zeros((50, len(index.terms))), np.zeros((len(index.ids), len(index.terms)))
    asked[row, term] = w
    known[index.examples, np.repeat(np.repeat(np.arange(len(index.terms)), np.diff(index.heads)), np.diff(index.starts))] = index.weight
    want = ((asked * index.relevance) @ known.T)[near[0], near[1]]
    assert want.max() > 0 and np.allclose(index.relevant(row, term, w, near), want, atol=1e-12)


def test_blocks_are_skipped_without_a_loss():
    """Sparse random rows over many blocks, small slices, and an example for each row that isn't to be found."""
    rng = np.random.default_rng(5)
    n, terms = 1000, 200
    cells = np.unique(rng.integers(0, n, 8000) * terms + np.minimum(rng.geometric(0.03, 8000), terms) - 1)
    labels = (np.arange(n) % 7 == 0).astype(float)
    index = toxicity.build(np.arange(terms), rng.random(terms) + 0.1, np.zeros(terms), np.arange(n), labels, np.ones(n), cells // terms, cells % terms, np.ones(len(cells)))
    dense = np.zeros((n, terms))
    term = np.repeat(np.repeat(np.arange(terms), index.heads[1:] - index.heads[:-1]), np.diff(index.starts))
    dense[index.examples, term] = index.weight
    at, term = np.nonzero(dense)
    before, toxicity.CELLS = toxicity.CELLS, 1 << 12
    try:
        row, ids, s = index.nearest(at, term, dense[at, term], n, 7, np.arange(n))
    finally:
        toxicity.CELLS = before
    scores = dense @ dense.T
    np.fill_diagonal(scores, -1)
    for i in range(n):
        want = np.sort(scores[i][scores[i] > 1e-12])[::-1][:7]
        assert np.allclose(s[row == i], want, atol=1e-9) and i not in ids[row == i]


def plain_index(rng, n, size, repeats):
    """An index over random sparse examples, some of which are equal, and its dense rows in the index's order."""
    dense = np.zeros((n, size))
    for r in range(n):
        some = np.minimum(rng.geometric(0.02, 30), size) - 1  # a few words are in most examples
        dense[r, some] = rng.integers(1, 4, 30)
    dense[rng.integers(0, n, repeats)] = dense[0]
    row, term = np.nonzero(dense)
    index = toxicity.build(np.arange(size), rng.random(size) + 0.1, np.zeros(size), np.arange(n), np.zeros(n), np.ones(n), row, term, dense[row, term])
    known = np.zeros((n, size))
    known[index.examples, np.repeat(np.repeat(np.arange(size), np.diff(index.heads)), np.diff(index.starts))] = index.weight
    return index, known


@pytest.mark.parametrize(("full", "thin"), [(0, 32), (3, 32), (40, 2), (1024, 1 << 20)])
def test_full_lists_give_the_same_neighbours(monkeypatch, full, thin):
    """Whichever words have full lists, neighbours and cosines are those of sums in the order of terms, to the bit, and equal examples
    come in the order of the index."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(toxicity, "FULL", full)
    monkeypatch.setattr(toxicity, "THIN", thin)
    index, known = plain_index(rng, 300, 400, 60)
    assert (index.full[0] >= 0).sum() == index.full[1].shape[1] <= full and "full" not in index.__getstate__()
    picked = rng.integers(0, 300, 40)
    for without in (None, picked):
        row, term = np.nonzero(known[picked])
        got = index.nearest(row, term, known[picked][row, term], 40, 15, without)
        want = []
        for r, p in enumerate(picked):
            shared = [np.flatnonzero((known[p] > 0) & (x > 0)) for x in known]
            cosine = [sum((known[p, t] * known[e, t] for t in some), 0.0) for e, some in enumerate(shared)]
            ranked = sorted((-c, e) for e, c in enumerate(cosine) if c > 0 and (without is None or e != p))
            want += [(r, e, -c) for c, e in ranked[:15]]
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_common_words_cost_no_postings(monkeypatch):
    """Words that most examples hold are added up from full lists: their postings aren't gone through for each row."""
    rng, gone = np.random.default_rng(3), []
    index, known = plain_index(rng, 1000, 200, 0)
    assert index.full[1].size and index.forward
    real = toxicity.ranges
    monkeypatch.setattr(toxicity, "ranges", lambda starts, counts: (gone.append(int(np.sum(counts))), real(starts, counts))[1])
    row, term = np.nonzero(known[:50])
    index.nearest(row, term, known[:50][row, term], 50, 15)
    postings = int((index.starts[index.heads[1:]] - index.starts[index.heads[:-1]])[term].sum())
    assert sum(gone) < postings / 2


def test_a_toxic_word_of_four_examples(spark, rows):
    more = [(1000 + i, f"plain text with a rareslur number {i}", 1) for i in range(4)] + [(2000 + i, f"plain text of number {i}", 0) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows + more], "doc_id long, text string")
    found = toxicity.train(docs, spark.createDataFrame([(i, t) for i, _, t in rows + more], "doc_id long, toxic int"))
    out = toxicity.score(spark.createDataFrame([(1, "another rareslur here"), (2, "another text here")], "doc_id long, text string"), found).orderBy("doc_id").collect()
    assert set(out[0].evidence[:4]) == {1000, 1001, 1002, 1003} and out[0].predicted == 1 and out[1].predicted == 0


def test_examples_stay_bounded_by_id(spark):
    """A third of the rows has one id: it is one example."""
    docs = spark.range(600).select(F.when(F.col("id") < 200, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"))
    found = toxicity.train(docs, docs.select("doc_id", F.lit(1).alias("toxic")).union(docs.select("doc_id", F.lit(0).alias("toxic")).where("doc_id % 2 = 0")))
    assert len(found.ids) == len(set(found.ids.tolist())) == 401


def test_examples_stay_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EXAMPLE_BYTES", {1: 20_000, 0: 20_000})
    monkeypatch.setattr(toxicity, "LONGEST", 5_000)
    docs = spark.range(400).select("id", F.concat(F.lit("start"), F.expr("repeat(concat(' word', id), if(id % 40 = 0, 2000, 40))")).alias("text")).withColumnRenamed("id", "doc_id")
    found = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert 60 < len(found.ids) < 300 and not (found.ids % 40 == 0).any() and found.votes.min() > 1
    assert abs(found.votes.sum() - 390) < 60


def test_a_very_long_text_is_scored_whole(spark, rows, index):
    text = "wordlessness " * 400_000 + " foulone foultwo foulthree foulfour foulone foultwo"
    out = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), index).first()
    assert len(text) > 5_000_000 and out.predicted == 1 and out.evidence


def test_odd_texts_and_empty_tables(spark, index):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "nothing known here"), (3, "nothing known here"), (None, "foulone foultwo")], "doc_id long, text string")
    out = toxicity.score(odd, index).orderBy("doc_id").collect()
    assert len(out) == 5 and len({r.score for r in out[1:]}) == 1 and not any(r.predicted for r in out[1:])
    assert out[0].predicted == 1
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    empty = toxicity.train(docs, labels)
    assert toxicity.score(docs, empty).count() == 0
    assert toxicity.score(odd, empty).where("score between 0 and 1").count() == 5
