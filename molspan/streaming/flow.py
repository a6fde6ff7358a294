"""Structured Streaming over folders of Parquet files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molspan.functions.chain import Model
from molspan.operators.call import Options, call
from molspan.session import new_folder


def drain(spark: SparkSession, folder: str, name: str, schema: str, transform: Callable[[DataFrame], DataFrame], *, mode: str = "append", files_per_trigger: int = 8) -> DataFrame:
    """Runs ``transform`` over all that there is of a stream of files, and reads the result.

    Batches hold whole files, files_per_trigger at most; offsets and results are in the
    shared folder, so a stopped stream goes on where it was.
    """
    out, offsets = new_folder(spark, "stream-out"), new_folder(spark, "stream-offsets")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    made = transform(rows)
    query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """(w_start, event_type, n, total) by windows of event time."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("w_start"), "event_type", "n", "total")


def stream_calls(rows: DataFrame, out: str, offsets: str, model: Model, options: Options = Options(), *, once: bool = True, ordered_by: str | None = None):
    """Runs the fused plan over a stream of reads into Parquet under ``out``; returns the query.

    Each batch's rows keep their place beside those that were passed by: with ordered_by (such
    as voffset) a batch is written in that order, and ``batch`` tells which it was. Offsets
    are kept, so a stopped stream goes on where it was; a batch that is done again replaces
    its own folder. Memory is that of the tasks' Arrow batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        made = call(batch, model, options).withColumn("batch", F.lit(number))
        if ordered_by:
            made = made.repartitionByRange(ordered_by).sortWithinPartitions(ordered_by)
        made.drop("batch").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", offsets)
    return (writer.trigger(availableNow=True) if once else writer).start()


def call_stream(spark: SparkSession, folder: str, schema: str, model: Model, options: Options = Options(), *, glob: str = "*.parquet", files_per_trigger: int = 8, ordered_by: str | None = None) -> DataFrame:
    """stream_calls() over all Parquet files that there are in a folder, and the result read back."""
    out = new_folder(spark, "stream-calls")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    stream_calls(rows, out, new_folder(spark, "stream-offsets"), model, options, ordered_by=ordered_by).awaitTermination()
    return spark.read.parquet(out)
