"""Incremental batches on Structured Streaming: pages come in as files, candidates and running means go out.

The checkpoint remembers which files are done, so a run resumes where the last one ended; each batch is written under its own
number, so a batch that is run again after a failure replaces its own rows and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parapheur.operators import fields


def page_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def extract_incrementally(stream: DataFrame, out: str, checkpoint: str, text: str = "raw_text", confidence: str = "confidence", keys: tuple[str, ...] = ("page_row_id",)) -> StreamingQuery:
    """Run to completion over what is there now: the winner of every page and field, a folder a batch."""

    def batch(pages: DataFrame, number: int) -> None:
        won = fields.selected(fields.candidates(pages, text, confidence, list(keys)), list(keys))
        won.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_field_means(stream: DataFrame, name: str, checkpoint: str, metric: str = "f1") -> StreamingQuery:
    """Mean of a metric a field over all rows so far, in the memory table ``name``; the state is two numbers a field."""
    means = stream.groupBy("field_name").agg(F.avg(metric).alias("mean"), F.count(metric).alias("n"))
    return means.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(stream: DataFrame, time: str, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Rows a window and field by event time, late rows counted until the watermark passes."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "field_name").agg(F.count(F.lit(1)).alias("n"), F.avg("f1").alias("f1"))
