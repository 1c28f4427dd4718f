"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where it names none, a temporary one on a local master, else an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="matchlake-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder where nothing is yet; what comes to be there is removed when the application ends."""
    path = f"{shared_dir(spark)}/matchlake-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, removed when the application ends: lineage ends there, and what is used twice is made once.

    The shuffles of the write serve nothing else, so their files go when it ends, not when the driver happens to collect garbage.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Removes a table of `written` that nothing reads any more, before the application ends."""
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in folders:
        if folder.rsplit("/", 1)[-1].startswith("matchlake-"):
            _remove(df.sparkSession, folder)


def few_rows_at_once(spark: SparkSession, rows: int) -> None:
    """Python workers of the session get at most `rows` rows at once from now on."""
    now = int(spark.conf.get(ARROW_ROWS))
    spark.conf.set(ARROW_ROWS, str(min(rows, now) if now > 0 else rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python steps of what is written inside get at most `rows` rows at once."""
    before = spark.conf.get(ARROW_ROWS)
    few_rows_at_once(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


@contextmanager
def large_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """For tables whose rows are megabytes: files are read, and Python steps of what is written inside get, at most `rows` rows at once."""
    before = spark.conf.get(READ_ROWS)
    spark.conf.set(READ_ROWS, str(rows))
    try:
        with small_batches(spark, rows):
            yield
    finally:
        spark.conf.set(READ_ROWS, before)
