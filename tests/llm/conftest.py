import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Small documents with exact and near copies, shared passages, junk, and odd rows: null and empty texts, null ids, repeats."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    passage = sentence(rng, vocabulary, 60)
    rows = []
    for i in range(60):
        lines = [sentence(rng, vocabulary, rng.randint(3, 70)).capitalize() for _ in range(rng.randint(1, 4))]
        if i % 7 == 3:
            lines.insert(rng.randint(0, len(lines)), passage)
        text = "\n".join(lines)
        if i % 10 == 9:
            text = rows[-3][1]
        if i % 10 == 8 and len(text.split(" ")) > 40:
            w = rows[-2][1].split(" ")
            w[len(w) // 2] = "CHANGED"
            text = " ".join(w)
        rows.append((i * 3, text, "en", f"s{i % 3 if i % 4 else 0}", len(text)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s0", 0), (1002, "a", "en", "s9", 1), (None, rows[0][1], "en", "s0", 1), (1003, "!!! ... \n\n", "en", "s1", 9), (1004, "and. " * 80, "en", "s1", 400), (1005, "and. " * 90, "en", "s1", 450)]
    rows += [rows[5], (rows[6][0], "another text under a known number " * 9, "en", "s1", 3)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
