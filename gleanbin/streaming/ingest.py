"""Incremental ingest: new files of a folder as a stream that takes what is there and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanbin.sources.io import LARGEST, is_elf

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_new(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*") -> int:
    """Appends path, size, sha256 of ELF files not taken before to the table out; the number of rows appended.

    The stream's checkpoint knows the files taken, so a run after a failure neither misses nor repeats one.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    kept = files.where(F.col("length").between(1, LARGEST) & is_elf(F.col("content"))).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    query = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)
