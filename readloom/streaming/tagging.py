"""Tagging of streams. The tagger is a projection, so a stream takes the very plan of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readloom.config import TagConfig
from readloom.operators.tags import tag_reads
from readloom.sources.sam import parse_lines


def sam_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Records of SAM text files as they arrive in a folder."""
    return parse_lines(spark.readStream.options(**options).text(folder))


def tag_stream(reads: DataFrame, mapping: DataFrame | None, sink: str, checkpoint: str, config: TagConfig = TagConfig(), variants: bool = False, available_now: bool = True) -> StreamingQuery:
    """Tags a streaming frame into Parquet files."""
    writer = tag_reads(reads, mapping, config, variants).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(tagged: DataFrame, tag: str, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Reads for each value of a tag in windows of event time; the watermark bounds the state."""
    rows = tagged.withWatermark(time, late) if tagged.isStreaming else tagged
    return rows.groupBy(F.window(time, window).alias("w"), tag).agg(F.count(tag).alias("n_reads")).filter("n_reads > 0").select(F.col("w.start").alias("window_start"), tag, "n_reads")
