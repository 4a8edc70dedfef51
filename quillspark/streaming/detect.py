"""Detection on streams: row by row, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import with_detection, with_mixed


def read_text_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def detect_stream(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """The stream with a detection struct."""
    return with_detection(stream, text_col)


def spans_stream(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """The stream with one row per span."""
    mixed = with_mixed(stream, text_col)
    return mixed.select(*stream.columns, F.posexplode("mixed.segments").alias("span", "segment"))


def language_counts(stream: DataFrame, time_col: str, window: str, watermark: str, text_col: str = "text") -> DataFrame:
    """Texts per language and time window, late ones up to the watermark."""
    found = detect_stream(stream, text_col).withWatermark(time_col, watermark)
    return found.groupBy(F.window(time_col, window), F.coalesce("detection.language_code", F.lit("und")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def write_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """All that is there now, exactly once, to files."""
    return stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
