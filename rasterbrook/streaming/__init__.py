"""Structured Streaming over image files: new files in, decoded rows or converted files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterbrook.functions import bits
from rasterbrook.sources import images

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of (path, modificationTime, format, length, content) of files as they come to a folder."""
    found = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "modificationTime", bits.file_signature(F.col("content")).alias("format"), "length", "content")


def decoded(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """The same with width, height, data and error in place of content."""
    return images.decode(new_files(spark, path, per_trigger))


def counts(files: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, format, files, bytes) by time of change; state is dropped behind the watermark."""
    return files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window), "format").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def convert(spark: SparkSession, source: str, target: str, checkpoint: str, to: str = "bmp") -> StreamingQuery:
    """Runs through the files that are there: each into a row (path, content, error) of Parquet in target; a broken one has no content."""
    encode = {"bmp": images.encode_bmp, "jpeg": images.encode_jpeg}[to]
    rows = decoded(spark, source).select("path", "width", "height", "data", F.col("error").alias("why"))
    done = encode(rows).select("path", "content", F.coalesce("why", "error").alias("error"))
    return done.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
