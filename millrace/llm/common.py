"""What the training-data operators share: table reading and tables that cut the lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written stages: `spark.checkpoint.dir` where it is set.

    Only where it is unset in a local session (local runs, tests) a temporary folder is taken.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written to the shared folder, and free the shuffle files behind it.

    The rows are made once (a checkpoint makes them twice), the table is columnar and compressed, and
    Spark removes the shuffle files of the job that wrote it when the write has ended.
    """
    return written_parts([df])


def written_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """One written table of the rows of several frames of one schema, at least one; the shuffle files of each are gone before the next."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = None
    for df in parts:
        spark = df.sparkSession
        path = path or f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
        before = spark.conf.get(key, "false")
        spark.conf.set(key, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def while_needed(df: DataFrame) -> Iterator[DataFrame]:
    """A written table that is removed at the end of the block; what is made of it must be written by then."""
    table_ = written(df)
    try:
        yield table_
    finally:
        if files := table_.inputFiles():
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


durable = written  # every step that cuts its lineage does it the same way


@contextmanager
def bucketed_table(df: DataFrame, *columns: str) -> Iterator[DataFrame]:
    """A table in the warehouse bucketed by `columns`, dropped at the end; joins and groups by them read it without a shuffle.

    `df` should already be partitioned by the columns, or each task writes a file for every bucket.
    """
    spark = df.sparkSession
    name = f"millrace_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        df.write.bucketBy(parts, *columns).format("parquet").option("compression", "zstd").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
