"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bit positions has a nonzero vector of r + 1 bits; the mask of table v keeps the positions whose
vector has an odd product with v. Up to r differing positions span at most r dimensions, so some v is orthogonal
to all of them, and its mask sees no difference: each pair within radius r meets in one of 2**(r+1) - 1 tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, condensed, connected_components, materialize, payload, small_batches
from .paragraphs import signatures, tune
from .shingling import similar_members, text_shingles

#: Buckets of more fingerprints are cut into chunks, and each pair of chunks is compared in a group of its own.
CHUNK = 2048


def masks(radius: int, seed: int = 5) -> list[int]:
    """The masks of the covering family: the vectors are dealt evenly to the positions in a fixed random order."""
    top = 1 << (radius + 1)
    vectors = np.resize(np.arange(1, top), 64)
    np.random.default_rng(seed).shuffle(vectors)
    return [sum(1 << i for i, a in enumerate(vectors.tolist()) if (a & v).bit_count() & 1) for v in range(1, top)]


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half the shingles' XXH64 values; a text without words gives 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest, size = b" ".join(words), xxhash.xxh64_intdigest, min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, counts = len(words) - size + 1, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        some = [digest(joined[a:b], seed) for a, b in zip(starts[at : min(n, at + (1 << 16))].tolist(), ends[at + size - 1 : at + (1 << 16) + size - 1].tolist(), strict=False)]
        counts += np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def word_fingerprint(text: bytes, seed: int = 42) -> int:
    """A fingerprint of single words: a word weighs the root of its count, and a bit is set if it is set in words of
    over half the weight. A few changed words move it less than a fingerprint of shingles."""
    counts = Counter(text.lower().split())
    if not counts:
        return 0
    bits = np.unpackbits(np.array([xxhash.xxh64_intdigest(w, seed) for w in counts], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    weight = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
    return sum(1 << i for i in np.flatnonzero(2 * (weight @ bits) > weight.sum()).tolist())


def fingerprints(docs: DataFrame, shingle: int | None = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number, of shingles or, for None, of words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                data, offsets = payload(batch.column("text"))
                raw, bounds = data.tobytes(), offsets.tolist()
                found = np.array([fingerprint(raw[a:b], shingle) if shingle else word_fingerprint(raw[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _spanning(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all pairs within the radius do: a search from each unseen one."""
    a, b, left = [], [], fps
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(front[:64, None] ^ left[None, :]) <= radius
            hit = near.any(0)
            a.append(front[:64][near[:, hit].argmax(0)])
            b.append(left[hit])
            front, left = np.concatenate([front[64:], left[hit]]), left[~hit]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links between the distinct fingerprints fp, whose components are those of all pairs within the radius."""
    # A small table has few files; its rows are dealt to all tasks before they are multiplied.
    spark = distinct.sparkSession
    distinct = distinct.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("k")) for i, m in enumerate(masks(radius))))
    keyed = distinct.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.k")
    large = materialize(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK), "large")
    keyed = keyed.join(large, ["t", "k"], "left").withColumn("chunks", F.ceil(F.coalesce("n", F.lit(1)) / CHUNK).cast("int"))
    keyed = keyed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    keyed = keyed.select("fp", "t", "k", "own", F.explode(F.expr("sequence(0, chunks - 1)")).alias("other"))
    keyed = keyed.select("fp", "t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    group = ["t", "k", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                now = [batch.column(c).to_numpy(zero_copy_only=False) for c in [*group, "fp"]]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if held is None or not len(held[0]):
                continue
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in held[:4]], axis=0)) + 1
            edges = np.concatenate([[0], change, [len(held[0])] if batch is None else []]).astype(np.int64)
            many = np.flatnonzero(np.diff(edges) > 1)
            fps = held[4].view(np.uint64)
            found = [_spanning(fps[edges[m] : edges[m + 1]], radius) for m in many.tolist()]
            held = [x[edges[-1] :] for x in held]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)], ["a", "b"])

    return keyed.repartition(*group).sortWithinPartitions(*group, "fp").mapInArrow(run, "a long, b long")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def simhash_groups(docs: DataFrame, shingle: int | None = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of docs (doc_id, text).

    Fingerprints that differ in at most `radius` bits are linked, equal ones too; component_id is the smallest doc_id
    of the component. Equal fingerprints are one node throughout, so copies of a text cost nothing. A null or blank
    text has fingerprint 0 and is linked like any other; a null doc_id is never the smallest unless it is alone; repeated
    rows are kept; further columns are left out; an empty table gives no rows."""
    found = materialize(fingerprints(docs, shingle), "fingerprints")
    whole = condensed(docs.sparkSession, lambda: _component_ids(found, radius), "components")
    return found.join(whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _component_ids(found: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) for each fingerprint of found (doc_id, fp)."""
    classes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    nodes = connected_components(links(classes.select("fp"), radius))
    whole = classes.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    whole = materialize(whole, "found")
    least = materialize(whole.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    return whole.join(least, "component").select("fp", "component_id")


def _near_texts(docs: DataFrame, least: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, x) for each row of docs (doc_id, text), x the hash of its text, and one row (x, first, least, component) for
    each distinct text: the rows' smallest doc_id, a null as the smallest and without nulls, and the text's group."""
    small_batches(docs.sparkSession)
    bands, rows = tune(least)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("x", F.xxhash64("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", 1 << 20):
                data, offsets = payload(batch.column("text"))
                raw, bounds = data.tobytes(), offsets.tolist()
                prints = np.array([word_fingerprint(raw[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], np.uint64)
                sets = text_shingles(batch)
                keys = signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("x"), pa.array(prints.view(np.int64)), lists], ["doc_id", "x", "fp", "bands"])

    found = materialize(named.mapInArrow(sign, "doc_id long, x long, fp long, bands array<long>"), "signed")
    # Copies are one node from here on, named by x.
    classes = found.groupBy("x").agg(F.min(F.struct("doc_id")).alias("first"), F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("first", F.col("first.doc_id")), "classes")
    # Texts of one fingerprint are a group, and so are two fingerprints' least texts where the covering tables link them.
    # The MinHash bands' groups add what the fingerprints miss.
    def met() -> DataFrame:
        prints = materialize(classes.groupBy("fp").agg(F.min("x").alias("x")), "prints")
        linked = links(prints.select("fp"), radius).distinct()
        linked = linked.join(prints.select(F.col("fp").alias("a"), F.col("x").alias("ax")), "a").join(prints.select(F.col("fp").alias("b"), F.col("x").alias("bx")), "b")
        pairs = linked.select(F.explode(F.array("ax", "bx")).alias("x"), F.xxhash64(F.lit("link"), "a", "b").alias("band"))
        keyed = materialize(classes.select("x", F.xxhash64(F.lit("fp"), "fp").alias("band")).union(classes.select("x", F.explode("bands"))).union(pairs), "keyed")
        # Texts that meet in many bands, without others, are compared once: groups of the same members are one group.
        shared = keyed.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("x")).alias("members")).where("n > 1")
        shared = materialize(shared.groupBy("n", "members").agg(F.min("band").alias("band")).select("band"), "shared")
        return keyed.join(shared, "band").select("x", "band")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array([s.tobytes() for s in text_shingles(batch)], pa.binary())], ["x", "set"])

    def similar() -> DataFrame:
        members = condensed(docs.sparkSession, met, "members")
        asked = members.select("x").distinct().join(classes, "x").select(F.col("x").alias("asked"), "first")
        sources = named.join(asked, (named["x"] == asked["asked"]) & named["doc_id"].eqNullSafe(asked["first"])).select("x", "text")
        sets = materialize(sources.mapInArrow(expand, "x long, set binary").dropDuplicates(["x"]), "sets")
        return similar_members(members, sets, least, 256)

    nodes = connected_components(condensed(docs.sparkSession, similar, "similar"))
    whole = classes.join(nodes, classes["x"] == nodes["node"], "left").select("x", "first", "least", F.coalesce("component", "x").alias("component"))
    return found.select("doc_id", "x"), materialize(whole, "groups")


def near_duplicates(docs: DataFrame, least: float = 0.8, radius: int = 3) -> DataFrame:
    """(doc_id, keeper) for each document of docs (doc_id, text) that repeats another, its keeper: the smallest doc_id of
    its group. Groups are components of documents with the same text, or whose sets of five-word shingles have a Jaccard
    similarity of `least` or more. Looked at are the texts that the covering tables link, word fingerprints within the radius, and those
    that share a MinHash band (of 12 x 4, which 99.8 % of pairs at 0.8 do, whatever was changed).

    A text of fewer than five words is one shingle, one of none is like others of none. Rows with a null doc_id are left
    out; a doc_id with several texts has a row for each of them that repeats another document."""

    def repeats() -> DataFrame:
        found, groups = _near_texts(docs.where(F.col("doc_id").isNotNull()), least, radius)
        keepers = materialize(groups.groupBy("component").agg(F.min("least").alias("keeper")), "keepers")
        keepers = materialize(groups.join(keepers, "component").select("x", "keeper"), "kept")
        return found.join(keepers, "x").where("doc_id <> keeper").select("doc_id", "keeper").distinct()

    return condensed(docs.sparkSession, repeats, "repeats")


def without_near_duplicates(docs: DataFrame, least: float = 0.8, radius: int = 3) -> DataFrame:
    """docs (doc_id, text and further columns) with one row of each group of near_duplicates(): that of the smallest
    doc_id, a null as the smallest, then of the smallest text hash; of rows that repeat its doc_id and text, any one.

    Rows are told apart by doc_id and text, so a doc_id's other texts are judged on their own. An empty table gives no rows."""

    def repeats() -> DataFrame:
        found, groups = _near_texts(docs, least, radius)
        place = F.struct(F.col("first").alias("doc_id"), "x")
        keepers = materialize(groups.groupBy("component").agg(F.min(place).alias("keeper")), "keepers")
        keepers = materialize(groups.join(keepers, "component").select("x", "keeper"), "kept")
        rows = found.groupBy("doc_id", "x").agg(F.count("*").alias("n")).join(keepers, "x")
        told = rows.select(F.col("doc_id").alias("__first"), F.col("x").alias("__x"), "n", F.struct("doc_id", "x").eqNullSafe(F.col("keeper")).alias("stays"))
        return told.where("not stays or n > 1")

    told = condensed(docs.sparkSession, repeats, "told")
    named = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__hash": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    same = named["__doc"].eqNullSafe(told["__first"]) & (named["__hash"] == told["__x"])
    out = named.join(told, same, "left_anti").select(*docs.columns)
    repeated = told.where("stays")
    if repeated.isEmpty():
        return out
    # Repeated rows are reduced before they are shuffled.
    once = named.groupBy("__doc", "__hash").agg(F.first(F.struct(*docs.columns)).alias("row"))
    once = once.join(repeated, once["__doc"].eqNullSafe(repeated["__first"]) & (once["__hash"] == repeated["__x"]), "left_semi")
    return out.union(once.select("row.*"))
