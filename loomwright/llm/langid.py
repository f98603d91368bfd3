"""Language identification in two steps: a softmax model names the language family, then one-versus-one linear
support vector machines tell the languages of that family apart. All models work on hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, drawn, payload, small_batches
from .features import LOWER, linear_fit, ngram_counts, normalized

# Families of common languages. A language that is missing here joins the family of the one it is nearest to.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tk ug uz",
    "indic": "bn gu hi mr ne pa sd si ur",
    "semitic": "am ar he mt",
    "sinitic": "zh",
}

BITS = 12
ORDERS = (1, 2, 3, 4)
#: About so many rows are fitted on: in equal parts for the languages, but 50 for each at least.
SAMPLE = 2400


def featured(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return normalized(ngram_counts(LOWER[data], offsets, ORDERS, BITS))


@dataclass
class LanguageModel:
    families: list[str]
    family_w: np.ndarray
    family_b: np.ndarray
    languages: list[list[str]]
    pairs: list[list[tuple[int, int]]]
    pair_w: list[np.ndarray]
    pair_b: list[np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """A language and a score for each row: the family's probability, times the mean chance of winning its duels."""
        z = x @ self.family_w + self.family_b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        family, names, scores = p.argmax(1), np.empty(len(x), object), p.max(1).astype(np.float64)
        for f, own in enumerate(self.languages):
            rows = np.flatnonzero(family == f)
            if not len(rows):
                continue
            chance = np.zeros((len(rows), len(own)))
            for (i, j), w, b in zip(self.pairs[f], self.pair_w[f], self.pair_b[f], strict=True):
                win = 1 / (1 + np.exp(-2 * (x[rows] @ w + b).astype(np.float64)))
                chance[:, i] += win
                chance[:, j] += 1 - win
            if len(own) > 1:
                scores[rows] *= chance.max(1) / (len(own) - 1)
            names[rows] = np.array(own, object)[chance.argmax(1)]
        return names.tolist(), np.clip(scores, 0, 1)


def fit(x: np.ndarray, langs: list[str]) -> LanguageModel | None:
    """Fits both steps; None without rows."""
    if not langs:
        return None
    known = {c: f for f, codes in FAMILIES.items() for c in codes.split()}
    names = sorted(set(langs))
    y = np.array([names.index(v) for v in langs])
    centres = normalized(np.stack([np.maximum(x[y == i].mean(0), 0) ** 2 for i in range(len(names))]))
    family = [known.get(v) for v in names]
    placed = [i for i, f in enumerate(family) if f]
    for i, f in enumerate(family):
        if f is None:
            family[i] = family[max(placed, key=lambda k: (float(centres[i] @ centres[k]), -k))] if placed else "other"
    families = sorted(set(family))
    group = np.array([families.index(family[i]) for i in y])
    share = 1 / np.bincount(y)[y]
    w, b = linear_fit(x, np.eye(len(families), dtype=np.float32)[group], share, "softmax", 1e-5)
    languages = [[v for v, f in zip(names, family, strict=True) if f == fam] for fam in families]
    pairs, pair_w, pair_b = [], [], []
    for own in languages:
        pairs.append([(i, j) for i in range(len(own)) for j in range(i + 1, len(own))])
        pair_w.append([])
        pair_b.append([])
        for i, j in pairs[-1]:
            rows = np.flatnonzero((y == names.index(own[i])) | (y == names.index(own[j])))
            side = np.where(y[rows] == names.index(own[i]), 1, -1)[:, None].astype(np.float32)
            dw, db = linear_fit(x[rows], side, share[rows], "hinge", 1e-5)
            pair_w[-1].append(dw[:, 0])
            pair_b[-1].append(float(db[0]))
    return LanguageModel(families, w, b, languages, pairs, pair_w, pair_b)


def train(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """Fits on about `sample` rows of labelled (doc_id, text, lang), chosen by a hash of the text; repeats count as often
    as they would in a sample."""
    small_batches(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    per = max(50, sample // len(counts))
    rate = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per / n))))
    chosen = drawn(labelled.select("lang", "text"), rate[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", 1 << 20):
                x = featured(*payload(batch.column("text")))
                nonzero = [np.flatnonzero(row) for row in x]
                yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("lang"), batch.column("votes"), pa.array([i.tolist() for i in nonzero], pa.list_(pa.int32())), pa.array([row[i].tolist() for row, i in zip(x, nonzero, strict=True)], pa.list_(pa.float32()))], ["x", "lang", "votes", "at", "value"])

    found = chosen.mapInArrow(run, "x long, lang string, votes int, at array<int>, value array<float>").toArrow().sort_by([("lang", "ascending"), ("x", "ascending")])
    x = np.zeros((len(found), 1 << BITS), np.float32)
    sizes = [len(v) for v in found.column("at")]
    x[np.repeat(np.arange(len(found)), sizes), found.column("at").combine_chunks().flatten().to_numpy()] = found.column("value").combine_chunks().flatten().to_numpy()
    again = np.repeat(np.arange(len(found)), found.column("votes").to_numpy())
    return fit(x[again], found.column("lang").take(pa.array(again)).to_pylist())


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs with lang_pred and score. Only the text is read; a null text or one without a letter is `und` with score
    0, and so is every text without a model. Rows and other columns stay as they are (clashing names are replaced)."""
    small_batches(docs.sparkSession)
    fields = "lang_pred string, score double"
    rest = docs.drop("lang_pred", "score")
    columns = rest.columns
    blank = ~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "__text", 1 << 20):
                und = batch.column("__und").to_numpy(zero_copy_only=False)
                names, scores = model.predict(featured(*payload(batch.column("__text")))) if model else (["und"] * len(batch), np.zeros(len(batch)))
                names = ["und" if u else v for u, v in zip(und, names, strict=True)]
                kept = [batch.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(np.where(und, 0.0, scores))], [*columns, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), fields])
    return rest.withColumns({"__text": F.coalesce(F.col("text"), F.lit("")), "__und": blank}).mapInArrow(run, schema)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts (null for a null doc_id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts
