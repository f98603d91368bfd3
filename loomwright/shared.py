"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions without spark.checkpoint.dir (tests).
_own: dict[str, str] = {}
#: The tables written since the innermost open condensed() began.
_written: ContextVar[list[str] | None] = ContextVar("_written", default=None)
#: With this, Spark removes a query's shuffle files when the query has ended; else when the driver's garbage happens to be collected.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def one_process(spark: SparkSession) -> bool:
    """Whether tasks run in the driver's own process. Those of local-cluster[...] don't."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session of one machine gets a folder of its own; on a cluster that is an
    error, for executors would write where nobody else reads."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not folder:
        if not one_process(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _own[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return folder.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URL with a scheme that pyarrow and Hadoop both read."""
    return re.sub("^file:/+", "file:///", shared_folder(spark))


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table or folder that a query left in the shared folder."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended
        return


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is planned inside leaves no shuffle files."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if (own := _written.get()) is not None:
        own.append(path)
    with freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def condensed(spark: SparkSession, found: Callable[[], DataFrame], name: str) -> DataFrame:
    """kept(found(), name), without the tables that were kept on the way to it: they are removed once it is written, so nothing else
    may read them later. Calls may be nested."""
    own: list[str] = []
    try:
        token = _written.set(own)
        try:
            df = found()
        finally:
            _written.reset(token)
        return kept(df, name)
    finally:
        for path in own:
            discard(spark, path)


def merged(df: DataFrame) -> DataFrame:
    """df for a join by sorted shuffles: however small Spark thinks it, it isn't gathered on the driver to be broadcast. For tables that grow
    with the input and are joined over and over, where such broadcasts add up."""
    return df.hint("merge")
