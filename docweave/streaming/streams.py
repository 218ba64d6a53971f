"""Streaming forms of ingest, exact dedup, counters, histograms, error groups and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission, monitoring


def read_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    """A file source; event times are made zoned ones, which watermarks need."""
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return found.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in found.columns else found


def ingest(files: DataFrame, target: str, checkpoint: str):
    """New files are admitted and appended once each; a batch that is replayed is overwritten, not doubled."""

    def write(batch: DataFrame, number: int) -> None:
        admission.admit(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_documents(files: DataFrame, target: str, checkpoint: str, key: str = "file_id", version: str = "version", buckets: int = 64):
    """Every document once, as its newest version has it, however often and in whatever batches it comes.

    The target is dealt into buckets of documents. A batch reads the buckets that its documents lie in, keeps the newest row of each document (of
    equal versions the one that was there), and overwrites these buckets only. A batch that is replayed finds its own rows and changes nothing.
    """
    spark = files.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def shaped(d: DataFrame) -> DataFrame:
        return admission.admit(d).withColumn("bucket", bucket)

    schema = shaped(spark.createDataFrame([], files.schema)).schema
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("bucket").parquet(target)

    def write(batch: DataFrame, number: int) -> None:
        new = shaped(batch).withColumn("at_first", F.lit(1))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # ``buckets`` rows at most
        if touched:
            old = spark.read.schema(schema).parquet(target).where(F.col("bucket").isin(touched)).withColumn("at_first", F.lit(0))
            both = old.unionByName(new)
            order = F.struct(F.col(version), -F.col("at_first"))
            kept = both.groupBy(key).agg(F.max_by(F.struct(*both.columns), order).alias("row")).select("row.*").drop("at_first")
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_contents(files: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """The first file of each content within the watermark."""
    return files.withColumn("hash", admission.content_hash("content")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["hash"])


def counters(events: DataFrame, label: str, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """(start, label, n): tumbling event counts; what is later than the watermark is dropped."""
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", width), label).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), label, "n")


def sliding(events: DataFrame, label: str, value: str, width: str = "10 minutes", step: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(start, label, n, mean): sliding windows of a value."""
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", width, step), label).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))
    return g.select(F.col("window.start").alias("start"), label, "n", "mean")


def error_groups(errors: DataFrame) -> DataFrame:
    return monitoring.error_groups(errors)


def windowed_alerts(counts: DataFrame, rules: DataFrame, target: str, checkpoint: str):
    """Each micro-batch of window counts (start, metric, value) against static rules.

    In update mode a window is judged with every batch that changes it, so the last windows count as well; of its alerts, the
    one of the last ``batch`` holds.
    """

    def judge(batch: DataFrame, number: int) -> None:
        monitoring.alerts(rules, batch.select("start", "metric", "value")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
