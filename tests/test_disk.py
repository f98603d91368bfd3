"""What a query writes on the way to its result doesn't stay on the disk."""

import os
import time

import pytest

import corpus_pipeline
from loomwright import graphs
from loomwright.llm import paragraphs, simhash
from loomwright.shared import FREED, condensed, kept, shared_folder


def _tables(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return {x.rsplit("-", 1)[0]: x for x in os.listdir(folder)} if os.path.isdir(folder) else {}


def _left(spark, before):
    return sorted(k for k, v in _tables(spark).items() if before.get(k) != v)


def _shuffles(spark):
    return {x for _, _, names in os.walk(spark.conf.get("spark.local.dir")) for x in names if x.startswith("shuffle_") and x.endswith(".data")}


@pytest.fixture
def docs(spark):
    words = [f"w{i}" for i in range(60)]
    text = lambda k: "\n".join(" ".join(words[(i * (k + j)) % 60] for i in range(12)) for j in range(4))
    return spark.createDataFrame([(i, text(i % 5)) for i in range(20)], "doc_id long, text string")


def test_op3_leaves_its_losses_alone(spark, docs):
    before = _tables(spark)
    out = paragraphs.dedup_paragraphs(docs)
    assert _left(spark, before) == ["losses"]
    assert sum(r.n_removed > 0 for r in out.collect()) >= 15


def test_near_duplicates_leave_what_they_tell_alone(spark, docs):
    before = _tables(spark)
    out = simhash.without_near_duplicates(docs)
    assert _left(spark, before) == ["told"]
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 3, 4]


def test_components_leave_their_result_alone(spark):
    before = _tables(spark)
    out = graphs.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"))
    assert _left(spark, before) == ["components"]
    assert {r.component for r in out.collect()} == {0} and out.count() == 10


def test_a_written_table_leaves_no_shuffle(spark):
    before = _shuffles(spark)
    out = kept(spark.range(1000).repartition(3, "id"), "dealt")
    for _ in range(50):  # blocks go in the background
        if not (left := _shuffles(spark) - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 1000
    assert spark.conf.get(FREED) == "false"


def test_condensed_keeps_outer_tables(spark):
    outer = kept(spark.range(5), "outer")
    before = _tables(spark)

    def inside():
        first = kept(outer.where("id > 0"), "first")
        return condensed(spark, lambda: kept(first.where("id > 1"), "second").where("id > 2"), "third")

    assert sorted(r.id for r in condensed(spark, inside, "fourth").collect()) == [3, 4]
    assert _left(spark, before) == ["fourth"] and outer.count() == 5
    with pytest.raises(ZeroDivisionError):
        condensed(spark, lambda: [kept(outer, "fifth"), 1 / 0], "sixth")
    assert _left(spark, before) == ["fourth"]


def test_a_stage_s_table_goes_when_the_next_is_written(spark, tmp_path, monkeypatch):
    spark.range(9).selectExpr("id as doc_id", "'a' as text").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"stage{i}", lambda s, docs, d, i=i: docs.where(f"doc_id <> {i}")) for i in range(4)])
    before = _tables(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert _left(spark, before) == ["stage2"] and sorted(r.doc_id for r in out.collect()) == [4, 5, 6, 7, 8]


def test_results_alone_are_left_beside_earlier_ones(spark, docs):
    """Every name in the folder is compared: tables of one name, left by earlier queries of the session, don't hide a new one."""
    folder = shared_folder(spark).removeprefix("file:")
    links = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    for find, name in ((lambda: graphs.components(links), "components"), (lambda: paragraphs.dedup_paragraphs(docs), "losses")):
        for _ in range(2):
            before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
            find()
            assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before] == [name]
