"""Near-duplicate paragraphs: MinHash bands gather candidates, exact Jaccard similarity of word shingles decides, and
each component of similar paragraphs keeps its first occurrence. A passage that stands inside different long paragraphs
makes them no near-duplicates of one another; so the sentences of long paragraphs that stay are held against each other too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, condensed, connected_components, materialize, payload, small_batches
from .features import LOWER, words
from .shingling import SHINGLE, shingles, similar_members
from .tokens import SliceHasher, mixed

SIMILARITY = 0.8
#: A paragraph of fewer words has no five-word shingle, so none that could repeat; it is left as it is.
MIN_WORDS = 5
#: The sentences of a paragraph of more words are units of their own; a sentence of so many words or more goes if it repeats.
LONG, SENTENCE_WORDS = 50, 8
# A sentence ends behind one of these bytes with a space after it; the space parts it from the next.
STOPS, PARTING = np.frombuffer(b".!?", np.uint8), "(?<=[.!?]) "
#: A pair at the least similarity must meet in some band with this chance; of the shapes that do, tune() takes the strictest.
RECALL, MOST_HASHES = 0.998, 60
#: Paragraphs of a bucket are dealt to chunks of about so many, and each pair of chunks is compared in a group of its own.
CHUNK = 1024


def tune(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which `most` hashes at most give the recall, with as few bands as do."""
    shapes = [(b, r) for r in range(1, most + 1) for b in range(1, most // r + 1) if 1 - (1 - similarity**r) ** b >= recall]
    rows = max(r for _, r in shapes)
    return min(b for b, r in shapes if r == rows), rows


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text index and number within the text of each line of each text (an empty text has one)."""
    bound = np.concatenate([offsets[1:], np.flatnonzero(data == 10)])
    kind = np.concatenate([np.ones(len(offsets) - 1, bool), np.zeros(len(bound) - len(offsets) + 1, bool)])
    order = np.lexsort((kind, bound))
    ends, last = bound[order], kind[order]
    owner = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(ends) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], (ends + ~last)[:-1]]) if len(ends) else ends
    first = np.searchsorted(owner, np.arange(len(offsets) - 1))
    return starts, ends, owner, np.arange(len(ends)) - first[owner]


class Units:
    """The paragraphs and the words of a batch of texts."""

    def __init__(self, batch: pa.RecordBatch):
        self.data, self.offsets = payload(batch.column("text"))
        lowered = LOWER[self.data]
        self.start, self.end, self.owner, self.number = paragraphs(self.data, self.offsets)
        self.words, w_end, _ = words(lowered, self.offsets)
        self.hashes = SliceHasher(lowered)(self.words, w_end)
        self.first, self.last = np.searchsorted(self.words, self.start), np.searchsorted(self.words, self.end)

    def paragraphs(self, min_words: int) -> tuple[np.ndarray, ...]:
        """For the paragraphs of min_words words at least: text index, number, word hashes and bounds."""
        some = np.flatnonzero(self.last - self.first >= min_words)
        return self.owner[some], self.number[some], *self._taken(self.first[some], self.last[some])

    def sentences(self) -> tuple[np.ndarray, ...]:
        """For the sentences of SENTENCE_WORDS words at least of paragraphs of more than LONG: text index, the paragraph's
        number, the sentence's number in it, word hashes and bounds."""
        long = self.last - self.first > LONG
        cuts = np.flatnonzero((self.data[1:] == 0x20) & np.isin(self.data[:-1], STOPS)) + 1
        line = np.searchsorted(self.start, cuts, "right") - 1
        inside = long[line] & (cuts > self.start[line])
        own = np.flatnonzero(long)
        line, start = np.concatenate([own, line[inside]]), np.concatenate([self.start[own], cuts[inside] + 1])
        order = np.lexsort((start, line))
        line, start = line[order], start[order]
        fresh = np.concatenate([[True], line[1:] != line[:-1]])[: len(line)]
        end = np.where(np.append(fresh[1:], True)[: len(line)], self.end[line], np.append(start[1:], 0)[: len(line)] - 1)
        part = np.arange(len(line)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        first, last = np.searchsorted(self.words, start), np.searchsorted(self.words, end)
        some = np.flatnonzero(last - first >= SENTENCE_WORDS)
        return self.owner[line[some]], self.number[line[some]], part[some], *self._taken(first[some], last[some])

    def _taken(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words first .. last - 1 of each run, one run after the other, and the runs' bounds in them."""
        counts = last - first
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return self.hashes[np.arange(int(bounds[-1])) + np.repeat(first - bounds[:-1], counts)], bounds


def _contents(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of words."""
    out = []
    for seed in (1, 2):
        place = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))
        terms = mixed(hashes + mixed(np.uint64(seed << 40) + place.astype(np.uint64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        out.append(mixed(sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(h: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(runs, bands): a hash of each band's minima."""
    rng, out = np.random.default_rng(23), np.zeros((len(ends) - 1, bands), np.uint64)
    for b in range(bands):
        for _ in range(rows):
            a, c = rng.integers(1, 1 << 63, 2, np.uint64)
            out[:, b] = mixed(out[:, b] + np.minimum.reduceat(mixed(h * (a | np.uint64(1)) + c), ends[:-1]))
        out[:, b] = mixed(out[:, b] + np.uint64(b))
    return out.view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def duplicate_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(removed, cut, links): removed has (id, hash, at) for each paragraph of docs (doc_id, text) that goes; a document is
    named by its doc_id and its text's hash, a paragraph by its number in it. cut has (id, hash, at, part) for each sentence
    that goes from a paragraph that stays. links has (a, b), pairs of distinct paragraphs found similar, whose components are
    the clusters."""
    small_batches(docs.sparkSession)
    bands, rows = tune(least)
    min_words, names = max(min_words, SHINGLE), ["id", "hash", "at", "part", "x", "y", "bands"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", 1 << 20):
                units = Units(batch)
                owner, number, part, hashes, bounds = units.sentences()
                if len(owner):
                    x, y = _contents(hashes, bounds)
                    at = pa.array(owner)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("hash").take(at), pa.array(number, pa.int32()), pa.array(part, pa.int32()), pa.array(x), pa.array(y), pa.nulls(len(owner), pa.list_(pa.int64()))], names)
                owner, number, hashes, bounds = units.paragraphs(min_words)
                if not len(owner):
                    continue
                keys = signatures(*shingles(hashes, bounds), bands, rows)
                x, y = _contents(hashes, bounds)
                at = pa.array(owner)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(owner) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("hash").take(at), pa.array(number, pa.int32()), pa.nulls(len(owner), pa.int32()), pa.array(x), pa.array(y), lists], names)

    spark = docs.sparkSession
    units = materialize(_texts(docs).mapInArrow(sign, "id long, hash long, at int, part int, x long, y long, bands array<long>"), "paragraphs")
    found = units.where("part is null").drop("part")
    # Equal paragraphs are one class from here on, named by x.
    place = F.struct("id", "hash", "at")
    classes = materialize(found.groupBy("x", "y").agg(F.min(place).alias("first"), F.first("bands").alias("bands")), "classes")

    def met() -> DataFrame:
        keyed = classes.select("x", F.explode("bands").alias("band"))
        shared = keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
        return keyed.join(materialize(shared.select("band"), "shared"), "band").select("x", "band")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", 1 << 20):
                owner, number, hashes, bounds = Units(batch).paragraphs(min_words)
                h, ends = shingles(hashes, bounds)
                index = {(o, n): i for i, (o, n) in enumerate(zip(owner.tolist(), number.tolist(), strict=True))}
                ids, sets = [], []
                for o, wanted in enumerate(batch.column("asked").to_pylist()):
                    for w in wanted:
                        i = index[o, w["at"]]
                        ids.append(w["x"])
                        sets.append(np.unique(h[ends[i] : ends[i + 1]]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["x", "set"])

    def similar() -> DataFrame:
        members = condensed(spark, met, "members")
        # The shingles of the paragraphs that met others, from their first places.
        asked = members.select("x").distinct().join(classes, "x").select("x", "first.*")
        asked = asked.groupBy("id", "hash").agg(F.collect_list(F.struct("at", "x")).alias("asked"))
        texts = _texts(docs)
        sources = texts.join(asked, texts["id"].eqNullSafe(asked["id"]) & (texts["hash"] == asked["hash"])).select("text", "asked")
        sets = materialize(sources.mapInArrow(expand, "x long, set binary").dropDuplicates(["x"]), "shingles")
        return similar_members(members, sets, least, CHUNK)

    links = condensed(spark, similar, "similar")

    def gone() -> DataFrame:
        nodes = connected_components(links)
        clusters = classes.join(nodes, classes["x"] == nodes["node"], "left").select("x", "y", "first", F.coalesce("component", "x").alias("cluster"))
        keepers = materialize(clusters.groupBy("cluster").agg(F.min("first").alias("keeper")), "leaders")
        keepers = materialize(clusters.join(keepers, "cluster").select("x", "y", "keeper"), "keepers")
        return found.drop("bands").join(keepers, ["x", "y"]).where(~place.eqNullSafe(F.col("keeper"))).select("id", "hash", "at")

    removed = condensed(spark, gone, "removed")
    cut = condensed(spark, lambda: _repeated_sentences(units.where("part is not null").drop("bands"), removed), "cut")
    return removed, cut, links


def _repeated_sentences(sentences: DataFrame, removed: DataFrame) -> DataFrame:
    """(id, hash, at, part) of the sentences (and x, y) outside the removed paragraphs that repeat an earlier one there."""
    place = F.struct("id", "hash", "at", "part")
    # Written before they are joined on their own keys: a sentence that every document has can be split then.
    repeated = materialize(sentences.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y"), "repeated")
    repeated = sentences.join(repeated, ["x", "y"])
    gone = removed.select(F.col("id").alias("i"), F.col("hash").alias("h"), F.col("at").alias("a")).distinct()
    left = repeated.join(gone, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")) & (F.col("at") == F.col("a")), "left_anti")
    left = materialize(left, "sentences")
    keepers = materialize(left.groupBy("x", "y").agg(F.min(place).alias("keeper")), "first")
    return left.join(keepers, ["x", "y"]).where(~place.eqNullSafe(F.col("keeper"))).select("id", "hash", "at", "part")


def dedup_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, least: float = SIMILARITY) -> DataFrame:
    """docs without repeated paragraphs: text loses them, and n_removed, removed, n_sentences and n_paragraphs are added.

    A paragraph is a line. Two are similar if the Jaccard similarity of their sets of five-word shingles is `least` or
    more; of each component of similar paragraphs of min_words words or more, the occurrence with the smallest (doc_id,
    number) stays, all others go, in whatever document; `removed` has their numbers. Shorter paragraphs always stay.

    Of a paragraph of more than LONG words that stays, each sentence of SENTENCE_WORDS words or more goes whose words are those of an
    earlier one, by (doc_id, paragraph, sentence), in such a paragraph; n_sentences counts them. A sentence ends at a full stop,
    exclamation or question mark with a space behind it; the others are joined by spaces, and a line that loses all of them is left empty.
    n_removed counts paragraphs and sentences.

    Null texts stay null; rows that repeat a doc_id and its text lose the same paragraphs; a null doc_id counts as the smallest;
    other columns stay as they are (clashing names are replaced). An empty table gives no rows."""

    def losses() -> DataFrame:
        removed, cut, _ = duplicate_paragraphs(docs, min_words, least)
        lost = cut.groupBy("id", "hash", "at").agg(F.sort_array(F.collect_set("part")).alias("parts"))
        each = removed.withColumn("parts", F.lit(None).cast("array<int>")).unionByName(lost)
        whole = F.when(F.col("parts").isNull(), F.col("at"))
        return each.groupBy("id", "hash").agg(F.sort_array(F.collect_set(whole)).alias("gone"), F.collect_list(F.when(F.col("parts").isNotNull(), F.struct("at", "parts"))).alias("cut"))

    by_doc = condensed(docs.sparkSession, losses, "losses")
    added = ("n_removed", "removed", "n_sentences", "n_paragraphs")
    rest = docs.drop(*added).withColumns({"__id": F.col("doc_id").cast("long"), "__hash": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    told = by_doc.select(F.col("id").alias("__i"), F.col("hash").alias("__h"), F.col("gone").alias("__gone"), F.col("cut").alias("__cut"))
    out = rest.join(told, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")), "left")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)

    def shortened(line: Column, i: Column) -> Column:
        own = F.filter("__cut", lambda c: c["at"] == i)
        left = F.filter(F.split(line, PARTING, -1), lambda s, j: ~F.array_contains(own[0]["parts"], j))
        return F.when(F.size(own) > 0, F.array_join(left, " ")).otherwise(line)

    numbered = F.transform(lines, lambda line, i: F.struct(F.when(F.size("__cut") > 0, shortened(line, i)).otherwise(line).alias("line"), i.alias("i")))
    left = F.filter(numbered, lambda x: ~F.array_contains("__gone", x["i"]))
    text = F.when(F.col("__gone").isNotNull(), F.array_join(F.transform(left, lambda x: x["line"]), "\n")).otherwise(F.col("text"))
    sentences = F.coalesce(F.aggregate("__cut", F.lit(0), lambda n, c: n + F.size(c["parts"])), F.lit(0))
    return out.select(
        *(text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in added),
        (F.coalesce(F.size("__gone"), F.lit(0)) + sentences).alias("n_removed"),
        F.coalesce("__gone", F.expr("cast(array() as array<int>)")).alias("removed"),
        sentences.alias("n_sentences"),
        F.size(lines).alias("n_paragraphs"),
    )
