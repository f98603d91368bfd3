import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwright.llm import packing
from loomwright.llm.common import payload
from loomwright.llm.queries import tokenizer
from loomwright.llm.tokens import PieceTokenizer

ODD = ["", "a", "  a", "\n\n a  \n", "it's don't ' s", "日本 語 ok", "x<|endoftext|>y", "  ", "é É\t\tß 12a3 ½²", "\xa0a", "a\r\nb", "a\n b", "\n", "a  ", "##$ %%", "\x00\x1f", "🙂 a"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_librarys(reference, corpus):
    texts = ODD + [r[1] or "" for r in corpus]
    ids, ends = tokenizer().encode(*payload(pa.array(texts)))
    parts = np.split(ids, ends[:-1])
    assert [p.tolist() for p in parts] == [[*reference.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    plain = PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"), None, "")
    assert plain.encode(*payload(pa.array(texts)))[0].tolist() == ids.tolist()


@pytest.mark.parametrize(("tokens", "weights"), [([100, 50], None), ([5000, 3, 900], None), ([100000, 1, 7, 30000], [1, 5, 0, 3]), ([2048 * 3], None), ([10**5, 33333] + [777 * i for i in range(20)], None), ([3 * 10**13, 10**13, 17], None)])
def test_schedule_fills_every_window(tokens, weights):
    segments = packing.schedule(tokens, weights)
    if sum(tokens) > 10**9:  # exact beyond 64 bits, too
        total = sum(s.given(np.array([s.count])).sum() for s in segments)
        assert total == sum(tokens)
        first, length, sequence, offset = next(packing.pieces(segments, 0, 10**13, 5000))
        assert length.sum() <= 5000 and (offset + length <= 2048).all()
        return
    filled: dict[int, list] = {}
    for q, n in enumerate(tokens):
        at, rng = 0, np.random.default_rng(q)
        while at < n:
            size = min(n - at, int(rng.integers(1, 5000)))
            assert sum(int(x[1].sum()) for x in packing.pieces(segments, q, at, size)) == size
            for first, length, sequence, offset in packing.pieces(segments, q, at, size):
                for row in zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True):
                    filled.setdefault(row[0], []).append(row[1:])
            at += size
    assert sorted(filled) == list(range(len(filled)))
    for k, rows in filled.items():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0, k


def test_shares_hold_in_every_window():
    tokens = [600_000, 300_000, 100_000]
    bulk = packing.schedule(tokens)[0]
    taken = np.diff(bulk.given(np.arange(bulk.count + 1)), axis=1)
    assert bulk.count == sum(tokens) // 2048
    assert (np.abs(taken - 2048 * np.array([[0.6], [0.3], [0.1]])) < 3).all()


def test_round_trip(docs, corpus, reference):
    out = packing.pack(docs.withColumns({"part": F.lit(9), "ids": F.lit("clash")}), tokenizer()).collect()
    sequences, by_doc = {}, {}
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.source, r.doc_tokens), []).append((r.start, ids.tolist()))
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    want = {}
    for i, text, _, source, _ in corpus:
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault((i, source, len(ids)), []).append(ids)
    assert set(want) == set(by_doc)
    for key, texts in want.items():
        got = sorted(by_doc[key])
        if len(texts) == 1:
            assert [x for _, ids in got for x in ids] == texts[0]
        assert sum(len(ids) for _, ids in got) == sum(map(len, texts))


def test_weights_and_empty(docs, no_docs):
    out = packing.pack(docs, tokenizer(), {"s0": 1.0, "s1": 3.0}).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n == 2048 or r.n & (r.n - 1) == 0 for r in out)
    assert packing.pack(no_docs, tokenizer()).count() == 0


def test_a_weight_beyond_the_largest_sources_counts(spark):
    """40 sources, of which the one with a weight of 500 against 1 has the fewest tokens of all."""
    rows = [(i, "word " * (400 if i % 40 else 380), f"s{i % 40}") for i in range(800)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), tokenizer(), {f"s{i}": 500.0 if i == 0 else 1.0 for i in range(40)}, with_ids=False)
    first = {r.source: r.n for r in out.where("sequence_id < 3").groupBy("source").agg(F.sum("length").alias("n")).collect()}
    assert abs(first["s0"] - 3 * 2048 * 500 / 539) < 45
    assert out.agg(F.sum("length")).first()[0] == out.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_many_sources_share_a_queue(spark):
    rows = [(i, f"some words of {i} " * (i % 50), f"s{i % 100}" if i % 3 else None) for i in range(1500)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7), tokenizer(), with_ids=False).collect()
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0


def test_a_very_long_text(spark, reference):
    text = "Ein langer Text, 12 mal. " * 60_000
    out = packing.pack(spark.createDataFrame([(1, text, "a"), (2, "short", "a")], "doc_id long, text string, source string"), tokenizer()).where("doc_id = 1").orderBy("start").collect()
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in out])
    assert ids.tolist() == [*reference.encode(text, add_special_tokens=False).ids, 1]
