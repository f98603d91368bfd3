"""Quality by weak labels: overlapping heuristic labellers vote, expectation-maximisation estimates how often each is
right from all documents' votes, and the posterior labels train a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, drawn, payload, small_batches
from .features import linear_fit, ngram_counts, normalized
from .tokens import SliceHasher

BITS = 11
ORDERS = (1, 2, 3)
#: The scorer is fitted on about so many documents, chosen by a hash of doc_id.
SAMPLE = 5000
#: Share of bad documents that the labellers' model starts from.
BAD = 0.15

# What each labeller measures, from where on it votes bad, and up to where it votes good (else it abstains).
LABELLERS = {
    "upper": (0.55, 0.25),  # upper-case share of ASCII letters
    "symbols": (0.04, 0.01),  # share of bytes that are neither letters, digits, white space nor usual punctuation
    "repeats": (0.3, 0.1),  # share of words that equal the word before them
    "shouts": (0.3, 0.1),  # exclamation marks a word
    "bars": (0.15, 0.05),  # vertical bars a word
    "variety": (-0.15, -0.4),  # distinct words / words of a text of 50 words at least, negated
    "runs": (0.25, 0.1),  # share of bytes that equal the byte before them (white space and continuation bytes apart)
    "ends": (-0.3, -0.9),  # share of lines that end with a full stop, question or exclamation mark, negated
}

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 white space, 5 usual punctuation, 6 beyond ASCII, 0 symbols
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1] = 1, 2, 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[list(b".,;:'\"-!?()")] = 5
_KIND[0x80:] = 6
#: For the scorer: letters by case, digits and letters beyond ASCII each become one byte, other bytes stay.
_SHAPE = np.arange(256, dtype=np.uint8)
for _kind, _as in ((1, "a"), (2, "A"), (3, "0"), (6, "a")):
    _SHAPE[_KIND == _kind] = ord(_as)


def _shares(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, labellers) of what LABELLERS tells, and for each text the share of repeated words for the scorer."""
    kind, n = _KIND[data], len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    black = np.concatenate([[False], kind != 4, [False]])
    bound = np.zeros(len(data) + 1, bool)
    bound[offsets] = True
    inside = black[1:-1]
    starts = np.flatnonzero(inside & (~black[:-2] | bound[:-1]))
    ends = np.flatnonzero(inside & (~black[2:] | bound[1:])) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(owner, minlength=n)
    h = SliceHasher(data)(starts, ends)
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])]) if len(h) else np.zeros(0, bool)
    order = np.lexsort((h, owner))
    fresh = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])]) if len(h) else again
    distinct = np.bincount(owner[order][fresh], minlength=n)
    each = np.maximum(count, 1)
    upper, letters = _shares(kind == 2, offsets), _shares((kind == 1) | (kind == 2), offsets)
    same = np.concatenate([[False], (data[1:] == data[:-1]) & (kind[1:] != 4) & (kind[1:] != 6)]) & ~bound[:-1] if len(data) else np.zeros(0, bool)
    # A line ends where a newline or the text's end follows its last byte.
    last = np.zeros(len(data), bool)
    if len(data):
        last = (data != 10) & np.concatenate([data[1:] == 10, [True]]) | (data != 10) & bound[1:]
    good_end = last & np.isin(data, np.frombuffer(b".!?", np.uint8))
    repeats = np.bincount(owner, again, n) / each
    variety = np.where(count >= 50, -distinct / each, -1.0)
    lines = _shares(last, offsets)
    ends_share = np.where(lines > 0, -_shares(good_end, offsets) / np.maximum(lines, 1), -1.0)
    table = [upper / np.maximum(letters, 1), _shares(kind == 0, offsets) / size, repeats, _shares(data == ord("!"), offsets) / each, _shares(data == ord("|"), offsets) / each, variety, _shares(same, offsets) / size, ends_share]
    return np.stack(table, 1), repeats


def votes(table: np.ndarray) -> np.ndarray:
    """1 bad, 0 none, -1 good, for each text and labeller."""
    bad, good = np.array(list(LABELLERS.values())).T
    return np.where(table >= bad, 1, np.where(table <= good, -1, 0)).astype(np.int8)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed n-grams of the text's shape, and repeated words as a further column in BITS."""
    x = normalized(ngram_counts(_SHAPE[data], offsets, ORDERS, BITS))
    x[:, 0] = np.sqrt(measures(data, offsets)[1])
    return x


@dataclass
class LabelModel:
    """log chances of each vote (bad 1, none 0, good -1 at index vote + 1) by class (0 good, 1 bad), and of the class."""

    chance: np.ndarray  # (labellers, 3, 2)
    prior: np.ndarray

    def bad(self, v: np.ndarray) -> np.ndarray:
        """Posterior of bad for rows of votes."""
        logs = self.prior + sum(self.chance[i, v[:, i] + 1] for i in range(v.shape[1]))
        e = np.exp(logs - logs.max(1, keepdims=True))
        return e[:, 1] / e.sum(1)

    def accuracy(self) -> dict[str, float]:
        """How often each labeller is right when it votes."""
        p = np.exp(self.chance + self.prior)
        return {name: float((p[i, 0, 0] + p[i, 2, 1]) / (p[i, 0].sum() + p[i, 2].sum())) for i, name in enumerate(LABELLERS)}


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Fits the labellers' accuracies to vote patterns and how often each occurs; starts from a vote that counts a
    single bad vote as much as all good ones, as most labellers look for one defect each."""
    k, counts = patterns.shape[1], counts.astype(np.float64)
    bad = np.where((patterns == 1).sum(1) > 0, 0.8, 0.02) if len(patterns) else np.zeros(0)
    model = LabelModel(np.zeros((k, 3, 2)), np.log([1 - BAD, BAD]))
    for _ in range(rounds):
        weight = np.stack([(1 - bad) * counts, bad * counts], 1)
        chance = np.stack([np.stack([weight[patterns[:, i] == v].sum(0) for v in (-1, 0, 1)]) for i in range(k)]) if len(patterns) else np.zeros((k, 3, 2))
        # A few made-up rows say that a labeller is right rather than wrong; they only matter where votes are rare.
        chance = chance + np.array([[2.0, 0.2], [1.0, 1.0], [0.2, 2.0]])
        model = LabelModel(np.log(chance / chance.sum(1, keepdims=True)), np.log((weight.sum(0) + [1, 1]) / (weight.sum() + 2)))
        now = model.bad(patterns) if len(patterns) else bad
        if np.abs(now - bad).max(initial=0) < 1e-6:
            break
        bad = now
    return model


@dataclass
class QualityModel:
    labels: LabelModel
    w: np.ndarray
    b: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Chance that each text is good."""
        return 1 / (1 + np.exp((features(data, offsets) @ self.w + self.b).astype(np.float64)))


def train(docs: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fits the labellers to all of docs (doc_id, text), and the scorer to about `sample` of them. No labels are read."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for whole in batches:
            for batch in by_bytes(whole, "text", 2 << 20):
                found, n = np.unique(votes(measures(*payload(batch.column("text")))[0]), axis=0, return_counts=True)
                for v, c in zip(found, n.tolist(), strict=True):
                    seen[v.tobytes()] = seen.get(v.tobytes(), 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    # At most 3 ** 8 patterns.
    told = docs.select("text").mapInArrow(tell, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns = np.array([np.frombuffer(r.pattern, np.int8) for r in told], np.int8).reshape(len(told), len(LABELLERS))
    labels = expectation_maximisation(patterns, np.array([r.n for r in told]))
    rate = sample / max(1, sum(r.n for r in told))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", 1 << 20):
                text = payload(batch.column("text"))
                x, bad = features(*text), labels.bad(votes(measures(*text)[0]))
                at = [np.flatnonzero(row) for row in x]
                yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("votes"), pa.array(bad), pa.array([i.tolist() for i in at], pa.list_(pa.int32())), pa.array([row[i].tolist() for row, i in zip(x, at, strict=True)], pa.list_(pa.float32()))], ["x", "votes", "bad", "at", "value"])

    found = drawn(docs.select("text"), F.lit(rate)).mapInArrow(encode, "x long, votes int, bad double, at array<int>, value array<float>").toArrow().sort_by("x")
    if not len(found):
        return QualityModel(labels, np.zeros(1 << BITS, np.float32), -10.0)
    x = np.zeros((len(found), 1 << BITS), np.float32)
    sizes = found.column("at").combine_chunks().value_lengths().to_numpy()
    x[np.repeat(np.arange(len(found)), sizes), found.column("at").combine_chunks().flatten().to_numpy()] = found.column("value").combine_chunks().flatten().to_numpy()
    bad = found.column("bad").to_numpy()
    w, b = linear_fit(x, bad[:, None].astype(np.float32), found.column("votes").to_numpy(), "logistic", 1e-6, 500)
    return QualityModel(labels, w[:, 0], float(b[0]))


def classify(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """docs with weak_good (the labellers' posterior), quality_score (the scorer's chance of good) and accepted
    (quality_score >= least). Only the text is read; null and empty texts are judged like any other and come out good,
    as no labeller objects. Rows and other columns stay as they are (clashing names are replaced)."""
    small_batches(docs.sparkSession)
    rest = docs.drop("weak_good", "quality_score", "accepted")
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "__text", 1 << 20):
                text = payload(batch.column("__text"))
                score = model.score(*text)
                weak = 1 - model.labels.bad(votes(measures(*text)[0]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(weak), pa.array(score), pa.array(score >= least)], [*names, "weak_good", "quality_score", "accepted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), "weak_good double, quality_score double, accepted boolean"])
    return rest.withColumn("__text", F.coalesce(F.col("text"), F.lit(""))).mapInArrow(run, schema)
