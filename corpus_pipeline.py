"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import decontam, packing, paragraphs, quality, simhash
from loomwright.llm.common import condensed, table
from loomwright.llm.queries import tokenizer


def _hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but doc_id and text under names that no operator adds, and those names."""
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(names), names


def _shown(found: DataFrame, docs: DataFrame, names: dict[str, str], **changed: Column) -> DataFrame:
    """The columns of docs, from a result over _hidden(docs); changed has those that are computed anew."""
    return found.select(*(changed.get(c, F.col(names.get(c, c))).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the weak-label scorer rejects.

    Null and empty texts stay: no labeller objects to them, and later stages count them. Texts of any length are judged whole; repeated rows are
    judged alike, and a score of exactly the threshold is accepted; an empty table gives none. Columns of any name pass unchanged."""
    hidden, names = _hidden(docs)
    return _shown(quality.classify(hidden, quality.train(docs.select("doc_id", "text"))).where("accepted"), docs, names)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that of the smallest doc_id, a null as the smallest.

    Rows are told apart by doc_id and text, of rows that tie in both any one stays; null, empty and blank texts are one group; texts of any length
    are compared whole; an empty table gives no rows. Columns of any name pass unchanged."""
    hidden, names = _hidden(docs)
    return _shown(simhash.without_near_duplicates(hidden), docs, names)


def paragraph_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts paragraphs that repeat an earlier one out of the texts, and counts n_chars anew where it did.

    Null texts stay null, repeated rows lose the same paragraphs, emptied documents stay; earlier is by doc_id, then place, ties by the text's hash; texts
    of any length are cut whole; an empty table gives no rows. Other columns of any name pass unchanged."""
    hidden, names = _hidden(docs)
    found = paragraphs.dedup_paragraphs(hidden)
    changed = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(names["n_chars"]))} if "n_chars" in names else {}
    return _shown(found, docs, names, **changed)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item.

    Null and empty texts hold none; repeated rows go or stay together; texts of any length are searched whole; empty tables give no rows, or drop
    none. Columns of any name pass unchanged."""
    hidden, names = _hidden(docs)
    return _shown(decontam.uncontaminated(hidden, table(spark, sf_dir, "benchmark")), docs, names)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left, each source in proportion to its tokens.

    A null text is an end id alone, a null source is a source, repeated rows are packed each; a text of any length is cut freely, ties follow
    doc_id; an empty table gives no rows. The result has the pieces' columns alone, whatever docs' others are called."""
    return packing.pack(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("paragraphs", paragraph_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the trained scorer nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result but the last is written to the shared folder and read again, and goes when the next is written."""

    def after(k: int) -> DataFrame:
        if not k:
            return table(spark, sf_dir, "documents")
        name, stage = STAGES[k - 1]
        return condensed(spark, lambda: stage(spark, after(k - 1), sf_dir), name)

    return STAGES[-1][1](spark, after(len(STAGES) - 1), sf_dir)
