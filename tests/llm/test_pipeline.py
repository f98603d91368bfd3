import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwright.llm.common import connected_components, materialize


def test_stages_on_odd_documents(spark, docs, no_docs, tmp_path):
    spark.createDataFrame([(1, "no such phrase in any document of this table at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, no_docs):
        frame, counts = start, [start.count()]
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = materialize(stage(spark, frame, str(tmp_path)), name)
            assert frame.columns == docs.columns
            counts.append(frame.count())
        assert counts == sorted(counts, reverse=True)
        packed = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == frame.select("doc_id").distinct().count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "paragraphs", "decontamination", "packing"]


ADDED = ["weak_good", "quality_score", "accepted", "n_removed", "removed", "n_sentences", "n_paragraphs", "items", "n_hit", "n_items", "n_words", "contaminated", "keeper", "component", "x", "fp", "first", "__id", "__text"]


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "paragraphs", "decontamination"])
def test_columns_of_clashing_names_pass(spark, docs, tmp_path, name):
    spark.createDataFrame([(1, "no such phrase in any document of this table at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = spark.createDataFrame([(7000, " ".join(f"w{i * i % 9973}" for i in range(700_000)), "en", "s1", 5)], docs.schema)
    frame = docs.union(long).withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in ADDED})
    out = dict(corpus_pipeline.STAGES)[name](spark, frame, str(tmp_path))
    assert out.schema.simpleString() == frame.schema.simpleString()
    rows = out.collect()
    assert len(rows) > 30 and (name == "quality" or 7000 in {r.doc_id for r in rows})
    assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in ADDED)


def test_near_copies_go(spark, docs, tmp_path):
    left = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    copies = docs.where("text is not null and doc_id is not null").groupBy("text").agg({"doc_id": "min"}).collect()
    assert left - {None} <= {r[1] for r in copies} | {1000}
    assert None in left


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(80)) for k in "abcd")
    rows = [(1, a), (7, a), (7, b), (3, c), (3, c), (None, d), (None, d), (9, d), (None, c + " more")]
    frame = spark.createDataFrame([(*r, str(i)) for i, r in enumerate(rows)], "doc_id long, text string, source string")
    left = corpus_pipeline.near_duplicate_stage(spark, frame.repartition(3), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted([(1, a), (7, b), (0, d), (0, c + " more")])
    left = corpus_pipeline.near_duplicate_stage(spark, frame.where("doc_id = 3").repartition(3), "").collect()
    assert [(r.doc_id, r.text) for r in left] == [(3, c)] and left[0].source in "34"


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 100), (None, 3), (3, None)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
