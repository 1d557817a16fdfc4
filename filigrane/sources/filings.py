"""Filing folders: text, Markdown and PDF files, read by Spark's own file sources."""

from __future__ import annotations

import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# fixed values: generated reports in a folder that are not filings
REPORT_FILES = ("report.md", "dcf_report.md")


def is_blank(text: Column) -> Column:
    """No text, or only white space in the Unicode sense."""
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+", "") == "", F.lit(True))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


@pandas_udf(StringType())
def pdf_text(content):
    """The text of PDF bytes, page by page; null without a PDF library or for a file that it can't read."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return content.map(lambda _: None)

    def one(data):
        try:
            return "\n".join(t for t in (p.extract_text() for p in PdfReader(io.BytesIO(data)).pages) if t)
        except Exception:  # a damaged file is a row without text, not a failed job
            return None

    return content.map(one)


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """source, content, status of the filings in a folder: *.pdf, *.txt, *.md, without reports and blank files.

    status: ok, or unreadable for a PDF whose text could not be had (its content is null; it is kept so that it shows).
    """
    texts = [
        spark.read.option("pathGlobFilter", f"*.{kind}").text(path, wholetext=True).select(file_name(F.col("_metadata.file_path")).alias("source"), F.col("value").alias("content"))
        for kind in ("txt", "md")
    ]
    pdf = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(file_name(F.col("path")).alias("source"), pdf_text("content").alias("content"))
    every = texts[0].unionByName(texts[1]).unionByName(pdf).filter(~F.lower("source").isin(*REPORT_FILES))
    status = F.when(F.col("content").isNull(), "unreadable").otherwise("ok")
    return every.withColumn("status", status).filter((F.col("status") == "unreadable") | ~is_blank(F.col("content")))
