"""The registered queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, langid, paragraphs, periods, quality, suffixes, toxicity
from .common import table
from .packing import pack
from .sharding import assign_shards
from .simhash import simhash_groups
from .tokens import PieceTokenizer
from .trie import conversation_trie
from .warc import archive_pages


def tokenizer() -> PieceTokenizer:
    return PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.train(docs)).select("doc_id", "weak_good", "quality_score", "accepted")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(langid.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.train(docs.where(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraphs.dedup_paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_removed", "n_sentences", "n_paragraphs", F.array_join("removed", ",").alias("removed"), F.sha2("text", 256).alias("kept_sha256"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer(), with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(langid.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    index = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, index).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversation_trie(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periods.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periods.periodic_runs(docs)
    longest = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    out = found.withColumn("r", longest).select("doc_id", F.size("runs").cast("long").alias("n_runs"), "r.start", "r.length", "r.period", listed.alias("listed"), "collapsed")
    exponent = F.floor(1000 * F.col("length") / F.col("period"))
    return out.select("doc_id", "n_runs", "start", "length", "period", exponent.alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_langid": op2_langid,
    "op3_paragraphs": op3_paragraphs,
    "op4_neighbours": op4_neighbours,
    "op5_decontamination": op5_decontamination,
    "op6_substrings": op6_substrings,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
    "op11_trie": op11_trie,
    "op12_periods": op12_periods,
    "op13_shards": op13_shards,
}
