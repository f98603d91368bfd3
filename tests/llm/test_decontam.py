import re

import pytest
from pyspark.sql import functions as F

from loomwright.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans(decontam.UPPER, decontam.LOWER)


def words(t):
    return WORD.findall((t or "").translate(UP))


def brute(text, items, size=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(size, len(b))
        for i in range(len(b) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def items(corpus):
    w = words(corpus[4][1])
    long = " ".join(words(corpus[2][1])[:30])
    return [(1, " ".join(w[:10])), (2, long.upper()), (11, " ".join(words(corpus[7][1])[:3])), (12, None), (13, "..."), (None, long), (14, "and and and"), (15, "no such phrase here"), (2, long), (16, "and. " * 12)]


def test_against_brute_force(spark, docs, corpus, items):
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    out = decontam.contamination(docs.withColumn("hash", F.lit("clash")), bench).collect()
    assert len(out) == len(corpus)
    known = [x for x in items if x[0] is not None]
    want = sorted(((r[0] if r[0] is not None else -1), *brute(r[1], known)[:2], ",".join(brute(r[1], known)[2])) for r in corpus)
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, r.n_hit, ",".join(r["items"])) for r in out) == want
    assert any(r.n_hit for r in out) and all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in out)
    assert all(sum(h.end - h.start for h in r.hits or []) == r.n_hit for r in out)


def test_clean_documents_stay(spark, docs, corpus, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = decontam.uncontaminated(docs, bench)
    known = [x for x in items if x[0] is not None]
    assert left.columns == docs.columns
    assert left.count() == sum(not brute(r[1], known)[1] for r in corpus)


def test_lower_casing_touches_ascii_only(spark):
    texts = ["ABC déF", "ÉÀ Kelvin K", "ΣΑΣ", "plain", "ß ẞ İ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(decontam.ascii_lower(F.col("t"))).collect()] == [t.translate(UP) for t in texts]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha one two beta"), (2, "beta x x x x x x x x x x alpha"), (3, "Alpha, beta. alpha")], "doc_id long, text string")
    index = decontam.postings(docs, spark.createDataFrame([("alpha",), ("beta",)], "term string"))
    pairs = spark.createDataFrame([("alpha", "beta")], "first string, second string")
    found = decontam.proximity_matches(index, pairs).join(decontam.keyed(docs).drop("words"), decontam.KEY)
    got = sorted((r.doc_id, r.at, r.other_at) for r in found.collect())
    assert got == [(1, 0, 3), (3, 0, 1), (3, 2, 1)]


def test_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(no_docs, none).count() == 0
    assert decontam.contamination(docs, none).where("contaminated or n_hit > 0").count() == 0
    assert decontam.uncontaminated(docs, none).count() == docs.count()


def test_very_long_texts_and_copies(spark):
    """A text of a million words with a window at its end, which many rows copy."""
    end = "the very last ten words of this text are these"
    docs = spark.createDataFrame([(1, "some words and " * 300_000 + end)], "doc_id long, text string")
    docs = docs.union(docs.withColumn("doc_id", F.lit(2).cast("long"))).union(spark.createDataFrame([(3, end), (4, end[:-6])], "doc_id long, text string"))
    out = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(docs, spark.createDataFrame([(7, end)], "item_id long, text string")).collect()}
    assert out == {1: (900_010, 10, ["7"]), 2: (900_010, 10, ["7"]), 3: (10, 10, ["7"]), 4: (9, 0, [])}
