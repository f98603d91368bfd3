"""Shared plumbing: shared-folder tables, text batches, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graphs import components
from ..shared import condensed, discard, fresh_path, freed, kept, shared_dir  # noqa: F401  the operators have them from here

#: Rows in an Arrow batch of texts; a batch is cut further by bytes inside the tasks.
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, which outlives any executor."""
    return kept(df, name)


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of long texts small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > TEXT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into slices whose column holds about `most` bytes at most (one row at least)."""
    sizes = np.frombuffer(batch.column(column).buffers()[1], np.int32, len(batch) + 1, batch.column(column).offset * 4).astype(np.int64)
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def payload(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column (null: empty), and the len + 1 offsets into them."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those from starts[1] on, and so forth."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node that can be reached. See graphs.components."""
    return components(links)


def drawn(rows: DataFrame, rate: Column) -> DataFrame:
    """One row of rows (text and further columns) for each of its distinct rows that is drawn, with votes, how many rows it
    stands for in a sample of the given rate (1 at most; it may depend on the other columns), and x, a hash of its text.

    A row that occurs n times gets n x rate votes, rounded up with the chance of what is over, by a hash of its text:
    the votes' sum is near the sample's size however often texts or ids repeat, and so bounds the drawn rows."""
    keys = [c for c in rows.columns if c != "text"]
    hashed = rows.withColumn("x", F.xxhash64("text"))
    share = F.pmod(F.col("x"), F.lit(1 << 30)) / (1 << 30)
    votes = hashed.groupBy("x", *keys).agg(F.count("*").alias("n")).select("x", *keys, F.floor(F.col("n") * F.least(rate, F.lit(1.0)) + share).cast("int").alias("votes"))
    votes = F.broadcast(votes.where("votes > 0"))
    return hashed.join(votes, ["x", *keys]).groupBy("text", "x", *keys).agg(F.max("votes").alias("votes"))
