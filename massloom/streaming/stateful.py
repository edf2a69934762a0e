"""The same operators over streams: sessions, windows and candidate search with static references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.session import Scratch


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """A driver table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false").parquet(f"{sf_dir}/{name}.parquet*")


def gap_sessions(stream: DataFrame, at: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Sessions that end after a gap, with rows up to ``late`` behind the newest still counted."""
    return stream.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap)).agg(F.count("*").alias("points"), F.sum("value").alias("signal"), F.max("value").alias("height"))


def window_totals(stream: DataFrame, at: str, width: str, slide: str, late: str) -> DataFrame:
    """Total and base peak per sliding window."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width, slide)).agg(F.sum("value").alias("total"), F.max("value").alias("base_peak"), F.count("*").alias("points"))


def with_closing_rows(stream: DataFrame, *times: str) -> DataFrame:
    """``stream`` (with a column ``at``) and, one in each batch, rows of these times whose other columns are null, so that what waits for the watermark is emitted."""
    spark = stream.sparkSession
    scratch = Scratch(spark, "closing")
    folder = scratch.path("rows")
    for time in times:
        rest = [F.lit(None).cast(t).alias(c) for c, t in stream.dtypes if c != "at"]
        spark.range(1).select(F.lit(time).cast("timestamp").alias("at"), *rest).select(*stream.columns).coalesce(1).write.mode("append").parquet(folder)
    closing = spark.readStream.schema(stream.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream.unionByName(closing)


def run_to_end(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """All that is there now, through a file sink with its own checkpoint, as a table."""
    spark = stream.sparkSession
    scratch = Scratch(spark, label)
    out, marks = scratch.path("out"), scratch.path("checkpoint")
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
