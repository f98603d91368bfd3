import numpy as np
from pyspark.sql import functions as F

from loomwright.llm import quality


def test_accuracies_are_found_without_labels():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.2
    v = np.stack([np.where(truth, np.where(rng.random(4000) < 0.6, 1, -1), np.where(rng.random(4000) < 0.97, -1, 1)) for _ in quality.LABELLERS], 1).astype(np.int8)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts)
    assert ((model.bad(v) > 0.5) == truth).mean() > 0.97
    assert all(0.8 < a <= 1 for a in model.accuracy().values())


def test_measures_of_plain_texts():
    from loomwright.llm.common import payload
    import pyarrow as pa

    texts = ["", "THE CAT!! SAT!!", "a a a b", "x | y | z", "ok.\nno end\nfine!"]
    table, repeats = quality.measures(*payload(pa.array(texts)))
    got = dict(zip(quality.LABELLERS, table.T, strict=True))
    assert got["upper"].tolist() == [0, 1, 0, 0, 0]
    assert got["repeats"][2] == 0.5 and repeats[2] == 0.5
    assert got["bars"][3] == 2 / 5
    assert abs(got["ends"][4] + 2 / 3) < 1e-12
    assert got["ends"][0] == -1.0


def test_junk_goes_and_clean_texts_stay(spark, docs, corpus):
    junk = [(5000 + i, " ".join(w.upper() + "!!" for w in "some shouted words about nothing at all".split()) * 12, "en", "s0", 1) for i in range(12)]
    both = docs.union(spark.createDataFrame(junk, docs.schema)).withColumn("accepted", F.lit("clash"))
    model = quality.train(both, 1000)
    out = {(r.doc_id, r.text): r.accepted for r in quality.classify(both, model).collect()}
    assert all(not out[r[0], r[1]] for r in junk)
    assert all(out[r[0], r[1]] for r in corpus if r[1] and len(r[1]) > 30 and not r[1].startswith("and."))
    assert out[1000, None] and out[1001, ""]


def test_empty_table(no_docs):
    assert quality.classify(no_docs, quality.train(no_docs)).count() == 0


def test_sample_stays_bounded(spark, monkeypatch):
    sizes, fit = [], quality.linear_fit
    monkeypatch.setattr(quality, "linear_fit", lambda x, target, weight, *a: sizes.append((len(x), weight.sum(), weight.max())) or fit(x, target, weight, *a))
    own = spark.range(2000).selectExpr("id as doc_id", "concat('text number ', id) as text")
    no_id = spark.range(1000).selectExpr("cast(null as long) as doc_id", "concat('without a number ', id) as text")
    same = spark.range(1000).selectExpr("cast(7 as long) as doc_id", "'the same text.' as text")
    quality.train(own.union(no_id).union(same), 200)
    (rows, votes, most), = sizes
    assert 100 < rows < 250 and 140 < votes < 260 and 50 <= most <= 51
