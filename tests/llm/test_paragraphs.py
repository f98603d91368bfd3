import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomwright.llm import paragraphs
from loomwright.llm.shingling import similar_members

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, min_words, least):
    """(doc_id, text) -> numbers of the paragraphs that go."""
    occurrences = defaultdict(set)
    for i, text in {(r[0], r[1]) for r in rows}:
        for k, line in enumerate((text or "").split("\n")):
            w = WORD.findall(line.encode().lower())
            if len(w) >= min_words:
                occurrences[tuple(w)].add(((i is not None, i or 0), k, text or ""))
    items = [(frozenset(w[j : j + 5] for j in range(len(w) - 4)), o) for w, o in occurrences.items()]
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if len(items[a][0] & items[b][0]) >= least * len(items[a][0] | items[b][0]):
                parent[find(a)] = find(b)
    groups = defaultdict(set)
    for n, (_, o) in enumerate(items):
        groups[find(n)] |= o
    gone = defaultdict(set)
    for o in groups.values():
        for (_, i), k, text in sorted(o, key=lambda x: x[:2])[1:]:
            gone[text].add(k)
    return gone


@pytest.mark.parametrize("least_words", [paragraphs.MIN_WORDS, 8])
def test_against_brute_force(docs, corpus, least_words):
    out = paragraphs.dedup_paragraphs(docs.withColumn("removed", F.lit("clash")), min_words=least_words).withColumn("t", F.col("text")).collect()
    assert len(out) == len(corpus)
    gone = brute(corpus, least_words, 0.8)
    texts = {(r[0], r[1]) for r in corpus}
    seen = 0
    for r in out:
        source = next(t for i, t in texts if i == r.doc_id and t is not None and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in r.removed) == r.text) if r.text is not None else None
        if source and r.doc_id is not None and not source.startswith("and."):
            shared = [t for i, t in texts if t == source]
            if len(shared) == 1:
                assert set(r.removed) == gone[source], r.doc_id
                seen += len(r.removed)
    assert seen > 5
    assert sum(r.n_removed for r in out) > 0


def test_null_and_empty(no_docs, docs):
    assert paragraphs.dedup_paragraphs(no_docs).count() == 0
    out = {r.doc_id: r for r in paragraphs.dedup_paragraphs(docs.where("doc_id >= 1000")).collect()}
    assert out[1000].text is None and out[1000].n_removed == 0
    assert out[1001].text == "" and out[1001].n_paragraphs == 1


def test_bands_reach_the_recall():
    bands, rows = paragraphs.tune()
    assert 1 - (1 - 0.8**rows) ** bands >= paragraphs.RECALL and bands * rows <= paragraphs.MOST_HASHES


def test_chunks_of_a_large_group_lose_no_link(spark):
    import numpy as np

    base = np.arange(1, 101, dtype=np.uint64) * np.uint64(977)
    rows = []
    for i in range(50):
        own = base.copy()
        own[i % 10] = 10**12 + i
        rows.append((i, bytearray(np.sort(own).tobytes())))
    sets = spark.createDataFrame(rows, "x long, set binary")
    members = spark.createDataFrame([(i, 1) for i in range(50)], "x long, band long")
    found = similar_members(members, sets, 0.8, 7).collect()
    parent = {i: i for i in range(50)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[find(r.a)] = find(r.b)
    assert len({find(i) for i in range(50)}) == 1


def test_members_that_only_others_connect(spark):
    """A chain in one group: each set is near the next alone, so the least member connects few of them."""
    import numpy as np

    rows = [(i, bytearray(np.arange(5 * i, 5 * i + 100, dtype=np.uint64).tobytes())) for i in range(40)]
    sets = spark.createDataFrame(rows, "x long, set binary")
    members = spark.createDataFrame([(i, b) for i in range(40) for b in (1, 2)] + [(99, 3)], "x long, band long")
    found = {(r.a, r.b) for r in similar_members(members, sets, 0.8, 16).collect()}
    assert all(abs(a - b) <= 2 for a, b in found)
    reached, more = {0}, True
    while more:
        more = {x for p in found for x in p if set(p) & reached} - reached
        reached |= more
    assert reached == set(range(40))


def test_a_very_long_text(spark):
    line = "Ein Satz mit mehr als fünf Wörtern, Nummer {}."
    rows = [(1, "\n".join(line.format(i) for i in range(30_000))), (2, line.format(17) + "\nshort line\n" + line.format("x"))]
    out = {r.doc_id: r for r in paragraphs.dedup_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed", "removed").collect()}
    assert out[2].removed == [0] and out[1].n_removed == 0


def brute_sentences(rows, gone):
    """(doc_id, text) -> (paragraph, sentence) that go from the paragraphs outside gone."""
    places = defaultdict(set)
    for i, text in {(r[0], r[1]) for r in rows}:
        for k, line in enumerate((text or "").split("\n")):
            if k in gone[text or ""] or len(WORD.findall(line.encode().lower())) <= paragraphs.LONG:
                continue
            for j, sentence in enumerate(re.split("(?<=[.!?]) ", line)):
                w = WORD.findall(sentence.encode().lower())
                if len(w) >= paragraphs.SENTENCE_WORDS:
                    places[tuple(w)].add(((i is not None, i or 0), k, j, text or ""))
    cut = defaultdict(set)
    for found in places.values():
        for _, k, j, text in sorted(found, key=lambda x: x[:3])[1:]:
            cut[text].add((k, j))
    return cut


def test_passages_inside_different_paragraphs(spark):
    import random

    rng = random.Random(5)

    def sentence(n, end="."):
        return " ".join("".join(rng.choices("aeioßknrst", k=rng.randint(3, 8))) for _ in range(n)) + end

    passage = [sentence(20), sentence(9, "!"), sentence(4), sentence(30, "?")]
    rows = []
    for i in range(30):
        front, back = [sentence(rng.randint(3, 30)) for _ in range(4)], [sentence(rng.randint(3, 30)) for _ in range(4)]
        body = [*front, *passage, *back] if i % 3 == 0 else [*front, sentence(60), *back, back[0]] if i % 3 == 1 else [*front, *back, sentence(60)]
        rows.append((i, "\n".join([sentence(6), " ".join(body), "  ".join(passage[:2]).upper() + " ", ""])))
    rows += [(None, " ".join([sentence(60), *passage])), (40, None), (41, ""), (42, ". ! ? " * 60), (43, "x. y" * 60 + "\n" + " ".join(passage)), rows[6]]
    rows += [(50, " ".join(passage)), (51, " ".join([*passage[:2], sentence(60)])), (52, sentence(60)[:-1] + "! " + passage[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_sentences", F.lit("clash"))
    gone = brute(rows, paragraphs.MIN_WORDS, 0.8)
    cut = brute_sentences(rows, gone)
    out = paragraphs.dedup_paragraphs(docs).collect()
    assert len(out) == len(rows) and sum(r.n_sentences for r in out) > 25
    texts = defaultdict(set)
    for i, text in rows:
        texts[i].add(text)
    for r in out:
        (text,) = texts[r.doc_id]
        if text is None:
            assert r.text is None and r.n_removed == 0
            continue
        lines = []
        for k, line in enumerate(text.split("\n")):
            if k not in gone[text]:
                lines.append(" ".join(s for j, s in enumerate(re.split("(?<=[.!?]) ", line)) if (k, j) not in cut[text]))
        assert (r.text, set(r.removed), r.n_sentences) == ("\n".join(lines), gone[text], len(cut[text])), r.doc_id
        assert r.n_removed == len(gone[text]) + len(cut[text])
