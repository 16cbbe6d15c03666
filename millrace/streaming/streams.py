"""Streaming forms: log append, page changes with late data, visit counts with expiring state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cut import delete, names_in


def file_stream(spark: SparkSession, schema, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet file source; its checkpoint is the high-water mark of what was read."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def append_log(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends new log rows and ends when all present files are read."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def page_stream(pages: DataFrame, ts: str = "updated", late: str = "1 day") -> DataFrame:
    """Every (root, page, fingerprint) once, rows up to `late` behind included."""
    return pages.withWatermark(ts, late).dropDuplicatesWithinWatermark(["root", "page", "fingerprint"])


def visit_counts(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, n, last), for update or complete mode."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))


def windowed_counts(stream: DataFrame, ts: str, key: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, key, n) in append mode once a window is older than the watermark; state is dropped then."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count(F.lit(1)).alias("n"))


def lifetimes(stream: DataFrame, key: list[str], ts: str, idle: str = "183 days", late: str = "1 day") -> DataFrame:
    """(key, started, last, n): every life of a key, ended by `idle` without a row.

    A key's state goes when its life is over, and a key that returns starts a new life; rows up to `late`
    behind still count, older ones are dropped. In append mode a life comes once it has ended.
    Rows without a time belong to no life.
    """
    seen = stream.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    out = seen.groupBy(F.session_window(ts, idle).alias("life"), *key).agg(F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))
    return out.select(*key, F.col("life.start").alias("started"), "last", "n")


def upsert_batches(stream: DataFrame, target: str, key: list[str], order: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the latest row of each key in a table folder.

    Keys are dealt to buckets. A batch writes target/v=<n>/bucket=<b> for the buckets that it touches and
    reads only those of the versions before; other buckets stay as they are. Readers take each bucket's
    largest version (`newest_version`), so a repeated batch is harmless. Versions that the batch before
    has already replaced are deleted, so that readers of the last one are not disturbed.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return
        held = _held(spark, target, n)
        if any(b in held for b in touched):
            paths = [f"{target}/v={held[b][0]}/bucket={b}" for b in touched if b in held]
            old = spark.read.schema(batch.schema).parquet(*paths)
            rows = rows.unionByName(old.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
        columns = batch.columns
        newest = rows.groupBy("bucket", *key).agg(F.max_by(F.struct(*columns), order).alias("r")).select("bucket", "r.*")
        newest.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={n}")
        for b in touched:
            for v in held.get(b, [])[1:]:
                delete(spark, f"{target}/v={v}/bucket={b}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _held(spark: SparkSession, target: str, before: int | None = None) -> dict[int, list[int]]:
    """Each bucket's complete versions, newest first, of batches earlier than `before`."""
    versions = sorted((int(v[2:]) for v in names_in(spark, target) if v.startswith("v=")), reverse=True)
    out: dict[int, list[int]] = {}
    for v in versions:
        names = names_in(spark, f"{target}/v={v}")
        if (before is None or v < before) and "_SUCCESS" in names:
            for b in names:
                if b.startswith("bucket="):
                    out.setdefault(int(b[7:]), []).append(v)
    return out


def newest_version(spark: SparkSession, target: str) -> DataFrame:
    """The table that `upsert_batches` keeps: each bucket as of the last batch that touched it; only these are read."""
    held = _held(spark, target)
    return spark.read.parquet(*[f"{target}/v={versions[0]}/bucket={b}" for b, versions in sorted(held.items())])


def run_to_table(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over everything that is there into a memory table and returns it (small results and tests)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
