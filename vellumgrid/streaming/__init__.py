"""Streams of files: the parsers keep no state, so a stream of texts or packages goes through the same code as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.sources import docx, markup


def markup_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The node table of texts as they arrive in a folder."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    return markup.parse(files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")))


def package_nodes(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return docx.parse(files.select(F.col("path").alias("doc_id"), "content"))
