"""Uploaded files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with their content; `mime` from the extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    low = F.lower("path")
    return files.withColumn("mime", F.when(low.endswith(".pdf"), "application/pdf").when(low.endswith(".md"), "text/markdown").otherwise("application/octet-stream"))


def accepted(mime: Column, path: Column) -> Column:
    return F.coalesce(mime == "application/pdf", F.lit(False)) | F.coalesce(F.lower(path).endswith(".md"), F.lit(False))


def accept_filter(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PDF and Markdown files, and the others with a message."""
    ok = accepted(F.col("mime"), F.col("path"))
    return files.where(ok), files.where(~ok).withColumn("message", F.lit("only PDF and Markdown files are read"))


def own_name() -> Column:
    """The name of the file that a row was read from; Spark gives it with blanks and other characters encoded."""
    return F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))


def scan_markdown(spark: SparkSession, path: str) -> DataFrame:
    """`file_name`, `markdown`: a whole file is one string. Files under names with `_` or `.` in front are not read."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(own_name().alias("file_name"), F.col("value").alias("markdown"))


def file_facts(files: DataFrame, page_items: DataFrame) -> DataFrame:
    """Size in MB to two places and the number of pages."""
    pages = page_items.groupBy("doc_id").agg(F.count("*").alias("pages"))
    return files.join(pages, "doc_id", "left").select("doc_id", F.round(F.col("length") / 1024 / 1024, 2).alias("size_mb"), F.coalesce("pages", F.lit(0)).alias("pages"))
