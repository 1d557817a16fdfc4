"""Structured Streaming over a landing folder: only new documents are chunked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.operators import chunking
from filigrane.sources.filings import REPORT_FILES, file_name, pdf_text


def chunk_stream(stream: DataFrame, source: str, text: str, out: str, checkpoint: str, dedupe_hours: int | None = None, time: str | None = None):
    """Start a query that appends the parent chunks of every new document to parquet at out, once each, then ends.

    With time and dedupe_hours, documents that come again within that time (by source) are left out.
    """
    if dedupe_hours is not None:
        stream = stream.withWatermark(time, f"{dedupe_hours} hours").dropDuplicatesWithinWatermark([source])
    chunks = chunking.parents(stream, F.col(source), F.col(text))
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landing_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as they arrive in path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def filing_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """source, section (general), content of the *.txt, *.md and *.pdf files that arrive anywhere below path, without reports.

    A file's source is its name.  Spark takes each path once, so that a new version of a file arrives in another folder.
    """
    landing = lambda: spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
    texts = [
        landing().option("pathGlobFilter", f"*.{kind}").option("wholetext", "true").text(path).select(file_name(F.col("_metadata.file_path")).alias("source"), F.col("value").alias("content"))
        for kind in ("txt", "md")
    ]
    binary = landing().schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pdf").format("binaryFile").load(path)
    every = texts[0].unionByName(texts[1]).unionByName(binary.select(file_name(F.col("path")).alias("source"), pdf_text("content").alias("content")))
    return every.filter(~F.lower("source").isin(*REPORT_FILES)).select("source", F.lit("general").alias("section"), "content")
