"""Paging, counting, sorting and previews of tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import kept

#: (column, ascending) keys.
Sorts = list[tuple[str, bool]]


#: Offsets from which a page isn't taken from the top rows of each task any more.
DEEP = 1_000_000


def order_columns(sorts: Sorts) -> list[Column]:
    """Nulls come last in ascending and first in descending order, as in the databases served."""
    return [F.asc_nulls_last(c) if up else F.desc_nulls_first(c) for c, up in sorts]


def sort_by(df: DataFrame, sorts: Sorts) -> DataFrame:
    return df.orderBy(*order_columns(sorts)) if sorts else df


def page(df: DataFrame, offset: int, limit: int, sorts: Sorts | None = None, where: str | None = None) -> DataFrame:
    """Rows offset .. offset + limit - 1 of the filtered and sorted table; the plan keeps only the top rows of each task. Those are
    offset + limit rows; from DEEP on the table is sorted in ranges instead. For many pages of a table see Pages."""
    df = df.where(where) if where else df
    if sorts and offset >= DEEP:
        rows = number_rows(df, sorts, -1, "__row")
        return rows.where((F.col("__row") >= offset) & (F.col("__row") < offset + limit)).orderBy("__row").drop("__row")
    return sort_by(df, sorts or []).offset(offset).limit(limit)


def page_with_more(df: DataFrame, offset: int, limit: int, sorts: Sorts, where: str | None = None) -> DataFrame:
    """A page with has_more on each row: whether rows follow it. One row beyond the page is read for that."""
    rows = page(df, offset, limit + 1, sorts, where)
    numbered = rows.select(F.struct("*").alias("r"))
    packed = numbered.agg(F.collect_list("r").alias("rows"))  # limit + 1 rows
    out = packed.select(F.explode(F.slice(F.array_sort("rows", _comparator(sorts)), 1, limit)).alias("r"), (F.size("rows") > limit).alias("has_more"))
    return out.select("r.*", "has_more")


def _comparator(sorts: Sorts):
    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, up in reversed(sorts):
            x, y = a[name], b[name]
            low = F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), 1).when(y.isNull(), -1).when(x < y, -1).when(x > y, 1).otherwise(0)
            low = low if up else -low
            out = F.when(low != 0, low).otherwise(out)
        return out

    return compare


def count_rows(df: DataFrame, where: str | None = None) -> DataFrame:
    return (df.where(where) if where else df).agg(F.count("*").alias("n_rows"))


def number_rows(df: DataFrame, sorts: Sorts, offset: int = 0, name: str = "row_no") -> DataFrame:
    """df with its place in the sort order, from offset + 1 on: unique and without gaps; rows that tie get any order. A sort value
    that very many rows share is split by a hash of the row (of all columns but maps); only rows that are equal throughout stay together.

    The rows are sorted in ranges and written to the shared folder once, each with its range and its place there. The
    counts of the ranges are read from that table, so that they are those of the rows numbered: bounds of ranges are sampled,
    and a second exchange could draw others. No task sees more than a range."""
    keys = order_columns(sorts)
    spark = df.sparkSession
    told = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    parts = df.withColumn("__row_hash", F.xxhash64(*told) if told else F.lit(0)).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "__row_hash").sortWithinPartitions(*keys, "__row_hash").drop("__row_hash")
    tagged = kept(parts.withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    # One row for each range: a table as small as the number of tasks.
    counts = tagged.groupBy("__part").agg((F.max("__seq") + 1).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return tagged.join(F.broadcast(starts), "__part").select(*df.columns, (F.col("__start") + F.col("__seq") + 1 + offset).alias(name))


class Pages:
    """The pages of a table in a sort order over any number of columns. The rows are sorted and written once, in files of whole stretches of
    pages; which file has which pages is known from then on, so that a page reads one or two files, however far behind it is."""

    def __init__(self, df: DataFrame, size: int, sorts: Sorts):
        spark = df.sparkSession
        self.spark, self.size, self.sorts, self.columns = spark, size, sorts, df.columns
        numbered = number_rows(df, sorts, -1, "__row").withColumn("__page", F.floor(F.col("__row") / size))
        numbered = numbered.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "__page").sortWithinPartitions("__row")
        self.table = kept(numbered, "pages")
        # One row for each file, as many as ranges.
        files = self.table.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("__page").alias("low"), F.max("__page").alias("high"), F.count("*").alias("n"))
        self.files = files.collect()
        self.rows = sum(f.n for f in self.files)
        self.count = -(-self.rows // size)

    def page(self, number: int) -> DataFrame:
        """The rows of a page, from 0 on, in order; none beyond the last."""
        return self.slice(number * self.size, self.size)

    def slice(self, offset: int, limit: int) -> DataFrame:
        low, high = offset // self.size, (offset + max(limit, 1) - 1) // self.size
        paths = [f.file for f in self.files if f.low <= high and f.high >= low]
        rows = self.spark.read.schema(self.table.schema).parquet(*paths) if paths else self.table.limit(0)
        return rows.where(F.col("__page").between(low, high) & (F.col("__row") >= offset) & (F.col("__row") < offset + limit)).orderBy("__row").select(*self.columns)

    def numbered(self) -> DataFrame:
        """All rows with page_no, from 1 on."""
        return self.table.select(*self.columns, (F.col("__page") + 1).alias("page_no"))

    def starts(self) -> DataFrame:
        """(page_no, sort columns): the first row of each page."""
        return self.table.where(F.col("__row") % self.size == 0).select((F.col("__page") + 1).alias("page_no"), *(c for c, _ in self.sorts))


def after(sorts: Sorts, row: dict) -> Column:
    """Whether a row comes behind the given values of the sort columns, nulls placed as order_columns places them."""
    out = F.lit(False)
    for name, up in reversed(sorts):
        c, value = F.col(name), row[name]
        same = c.isNull() if value is None else c.eqNullSafe(F.lit(value))
        if up:
            behind = F.lit(False) if value is None else c.isNull() | (c > F.lit(value))
        else:
            behind = c.isNotNull() if value is None else c < F.lit(value)
        out = F.coalesce(behind, F.lit(False)) | (same & out)
    return out


def iterate_pages(df: DataFrame, size: int, key: str | Sorts) -> Iterator[DataFrame]:
    """The pages of a table by a column or by sorts: it is sorted once, and each page reads its own file."""
    pages = Pages(df, size, [(key, True)] if isinstance(key, str) else key)
    for i in range(pages.count):
        yield pages.page(i)


def page_number(df: DataFrame, size: int, key: str | Sorts) -> DataFrame:
    """Every row with the page that iterate_pages would yield it on, from 1 on."""
    sorts = [(key, True)] if isinstance(key, str) else key
    return number_rows(df, sorts).withColumn("page_no", F.ceil(F.col("row_no") / size)).drop("row_no")


def preview(df: DataFrame) -> DataFrame:
    """Short texts for display: timestamps to the second, texts to 500 characters, bytes to 64."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.StringType):
            c = F.when(F.length(c) > 500, F.concat(F.left(c, F.lit(500)), F.lit("..."))).otherwise(c)
        elif isinstance(f.dataType, T.BinaryType):
            head = F.lower(F.hex(F.substring(c, 1, 64)))
            c = F.when(F.octet_length(c) > 64, F.concat(head, F.lit("...("), F.octet_length(c).cast("string"), F.lit(" bytes)"))).otherwise(head)
        out.append(c.alias(f.name))
    return df.select(*out)


def attach_comments(df: DataFrame, comments: DataFrame) -> DataFrame:
    """df with the comments (column_name, comment) of its columns in the fields' metadata; columns without one are left alone."""
    known: dict[str, str] = {r.column_name: r.comment for r in comments.where(F.col("column_name").isin(df.columns) & (F.col("comment") != "")).limit(len(df.columns)).collect()}
    for name, text in known.items():
        df = df.withMetadata(name, {"comment": text})
    return df


def comments_of(df: DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"column_name": df.columns, "comment": [f.metadata.get("comment") for f in df.schema.fields]})
