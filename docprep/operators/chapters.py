"""Chapters of Markdown documents and their export form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docprep.functions.text import strip_images, trim_ws

from .blocks import block_lines, heading_text, rendered
from .ordered import in_order

#: Fixed values.
PREFACE = "前言"
EMPTY_TITLE, EMPTY_HTML = "內容", "<p>無內容</p>"


def nonempty_documents(docs: DataFrame) -> DataFrame:
    """Null and empty Markdown goes, blank Markdown stays."""
    return docs.where(F.col("markdown").isNotNull() & (F.col("markdown") != ""))


def split_chapters(docs: DataFrame) -> DataFrame:
    """`doc_id`, `chapter_no` (from 0), `title`, `raw`: a chapter starts at each heading of depth 1 to 3.

    Headings are the blocks that rendering shows as such: lines with # marks, or a paragraph over a line of = or -. What
    stands before the first is chapter 0; `raw` holds the heading.
    """
    lines = block_lines(docs, ["doc_id"], "markdown")
    doc = Window.partitionBy("doc_id").orderBy("n")
    block = Window.partitionBy("doc_id", "block")
    head = F.coalesce(F.max(F.col("level") <= 3).over(block), F.lit(False))
    marked = lines.withColumn("head", head).withColumn("part", F.sum((F.col("head") & F.col("begins")).cast("int")).over(doc))
    title = F.when(F.col("head") & (F.col("kind") == "atx"), heading_text(F.col("line"))).when(F.col("head") & (F.col("kind") == "text"), trim_ws(F.col("line")))
    parts = marked.groupBy("doc_id", "part").agg(F.max("head").alias("headed"), F.array_join(in_order(title, "n"), "\n").alias("title"), F.array_join(in_order("line", "n"), "\n").alias("raw"))
    kept = nonempty_chapters(parts.withColumn("title", F.when(F.col("headed"), F.col("title")).otherwise(PREFACE)))
    order = Window.partitionBy("doc_id").orderBy("part")
    return kept.select("doc_id", (F.row_number().over(order) - 1).alias("chapter_no"), "title", "raw")


def nonempty_chapters(chapters: DataFrame) -> DataFrame:
    return chapters.where(trim_ws(F.col("raw")) != "")


def render_blocks(chapters: DataFrame) -> DataFrame:
    """`html` of a chapter's blocks; images are taken out."""
    html = rendered(chapters, ["doc_id", "chapter_no"], "raw", "title")
    return html.select("doc_id", "chapter_no", "title", strip_images(F.col("html")).alias("html"))


def chapter_fallback(docs: DataFrame, rendered: DataFrame) -> DataFrame:
    """Documents without a chapter get one that says so. One left join, so the chapters are worked out once."""
    every = docs.select("doc_id").distinct().join(rendered, "doc_id", "left")
    none = F.col("chapter_no").isNull()
    return every.select("doc_id", F.coalesce("chapter_no", F.lit(0)).alias("chapter_no"), F.when(none, EMPTY_TITLE).otherwise(F.col("title")).alias("title"), F.when(none, EMPTY_HTML).otherwise(F.col("html")).alias("html"))
