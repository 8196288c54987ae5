"""Incremental ingestion and event-time operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plenora.operators.ledger import latest_success


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream; the number per trigger bounds what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def unique_events(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """A stream without repeated keys within the watermark's delay; state is dropped with it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def tumbling_counts(stream: DataFrame, ts: str, width: str, delay: str, keys: Sequence[str] = (), value: str | None = None) -> DataFrame:
    """Counts (and sums) per window and key; late rows are taken up to the delay."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    w = F.window(F.col(ts), width)
    src = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    return src.groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("window_start"), *keys, "n", *(["total"] if value else []))


def sliding_counts(stream: DataFrame, ts: str, width: str, slide: str, delay: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per sliding window and key; an event counts in every window that holds it."""
    src = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    return src.groupBy(F.window(F.col(ts), width, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def activity_sessions(stream: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Sessions of a key: events no further than ``gap`` apart. Output: key, start, end, n."""
    src = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    return src.groupBy(F.session_window(F.col(ts), gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def keep_latest(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], ok: Column, ts: str, keep: Sequence[str], buckets: int = 64) -> StreamingQuery:
    """Drain a log into a table of the latest successful row per key, then stop; read it with ``latest_table``.

    The table lies in ``buckets`` of the keys' hashes. A batch reads and writes
    only the buckets that it touches, as the next, numbered version of these; a
    batch that is run again writes the same version, so a restart after a lost
    driver or executor repeats nothing.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = latest_success(batch, keys, ok, ts, keep).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]
        old = _latest_buckets(spark, target, n)
        paths = [old[b] for b in touched if b in old]
        if paths:
            before = spark.read.schema(new.drop("bucket").schema).parquet(*paths).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            new = latest_success(before.unionByName(new), [*keys, "bucket"], F.col("ok"), ts, keep)
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v{n:09d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest_buckets(spark: SparkSession, target: str, before: int) -> dict[int, str]:
    """Of each bucket the folder of its last version under ``before``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(conf)
    found: dict[int, str] = {}
    for v in sorted(str(s.getPath()) for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{target}/v*"))) if fs.exists(root) else []:
        if int(v.rpartition("/v")[2]) < before:
            for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{v}/bucket=*")):
                found[int(str(s.getPath()).rpartition("=")[2])] = str(s.getPath())
    return found


def latest_table(spark: SparkSession, target: str) -> DataFrame:
    """The table that ``keep_latest`` keeps: the last version of every bucket."""
    return spark.read.parquet(*_latest_buckets(spark, target, 1 << 60).values())
