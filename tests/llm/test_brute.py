"""The pipeline and the trained operators against plain versions and labels that they don't read."""

import numpy as np
import public_tokenizers
import pytest
from test_decontam import brute as windows_hit
from test_paragraphs import WORD
from test_paragraphs import brute as repeated_lines
from tokenizers import Tokenizer

import corpus_pipeline
from loomwright.llm import quality
from loomwright.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def shingles(text):
    w = WORD.findall(text.encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def one_of_each_group(rows):
    """All pairs: rows (doc_id, text) in order, without those that are connected to an earlier one."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return [r for i, r in enumerate(rows) if group[i] == i]


def test_pipeline_against_a_plain_one(spark, corpus, tmp_path):
    rows = sorted({r[0]: r for r in corpus if r[0] is not None}.values())
    items = [(1, " ".join(w.decode() for w in WORD.findall((rows[2][1]).encode().lower())[:14])), (2, "no such words in any of them at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    accepted = {r.doc_id for r in quality.classify(table, quality.train(table)).where("accepted").collect()}
    left = one_of_each_group([(r[0], r[1] or "") for r in rows if r[0] in accepted])
    gone = repeated_lines(left, 5, 0.8)
    left = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[t])) for i, t in left]
    kept = [(i, t) for i, t in left if not windows_hit(t, items)[1]]
    assert len(kept) < len(left) < len(rows)
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*encode.encode(t, add_special_tokens=False).ids, 1] for i, t in kept}
    pieces, sequences = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in pieces.items()} == want
    assert sum(n for p in sequences.values() for _, n in p) == sum(map(len, want.values()))
    for p in sequences.values():
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))]


def test_posteriors_against_a_plain_fit():
    """Expectation-maximisation a document at a time gives what the counted patterns give."""
    rng = np.random.default_rng(2)
    v = rng.integers(-1, 2, (300, len(quality.LABELLERS))).astype(np.int8)
    v[:40] = 1
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    got = quality.expectation_maximisation(patterns, counts).bad(v)
    bad = [0.8 if 1 in row else 0.02 for row in v.tolist()]
    for _ in range(100):
        seen = [[{-1: [2.0, 0.2], 0: [1.0, 1.0], 1: [0.2, 2.0]}[x][:] for x in (-1, 0, 1)] for _ in quality.LABELLERS]
        total = [1.0, 1.0]
        for row, b in zip(v.tolist(), bad, strict=True):
            for c, w in enumerate((1 - b, b)):
                total[c] += w
                for i, x in enumerate(row):
                    seen[i][x + 1][c] += w
        now = []
        for row in v.tolist():
            chance = [total[c] / sum(total) * np.prod([seen[i][x + 1][c] / sum(seen[i][y][c] for y in range(3)) for i, x in enumerate(row)]) for c in range(2)]
            now.append(chance[1] / sum(chance))
        done = max(abs(a - b) for a, b in zip(now, bad, strict=True)) < 1e-6
        bad = now
        if done:
            break
    assert np.allclose(got, bad, atol=1e-4)


@pytest.mark.parametrize(("name", "column", "least"), [("op1_quality", "quality", 0.97), ("op2_langid", "lang", 0.97)])
def test_accuracy_on_rows_not_learned_from(spark, name, column, least):
    """op1 reads no labels at all; op2 is judged on its held-out fold."""
    found = QUERIES[name](spark, DATA)
    if name == "op1_quality":
        both = found.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("quality is not null").selectExpr("cast(accepted as int) = quality as right")
    else:
        both = found.where("held_out").join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").selectExpr("lang_pred = lang as right")
    rows = [r.right for r in both.collect()]
    assert len(rows) > 100 and sum(rows) / len(rows) >= least
