"""Pages, page batches and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docprep.functions.text import trim_ws

from .ordered import in_order


def page_text(page_items: DataFrame) -> DataFrame:
    """A page's items joined by one space."""
    return page_items.select("doc_id", "page_no", F.array_join("items", " ").alias("text"))


def document_from_pages(pages: DataFrame) -> DataFrame:
    """Pages in order, each followed by a blank line."""
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(in_order("text", "page_no"), lambda x: F.concat(x, F.lit("\n\n"))), "").alias("markdown"))


def page_batches(counts: DataFrame, size: int = 5) -> DataFrame:
    """Ranges of `size` pages from `pages`."""
    start = F.explode(F.sequence(F.lit(0), F.col("pages") - 1, F.lit(size))).alias("s")
    cut = counts.where("pages > 0").select("doc_id", "pages", start)
    return cut.select("doc_id", F.floor(F.col("s") / size).cast("int").alias("batch_no"), (F.col("s") + 1).cast("int").alias("start_page"), F.least(F.col("s") + size, F.col("pages")).cast("int").alias("end_page"))


def token_ranges(pages: Column, threshold: int = 1000, size: int = 500) -> Column:
    """Array of (start_page, end_page): one range up to `threshold` pages, else ranges of `size`."""
    step = F.when(pages <= threshold, pages).otherwise(size)
    return F.transform(F.sequence(F.lit(0), pages - 1, step), lambda s: F.struct((s + 1).cast("int").alias("start_page"), F.least(s + step, pages).cast("int").alias("end_page")))


def token_batches(counts: DataFrame, threshold: int = 1000, size: int = 500) -> DataFrame:
    """One range up to `threshold` pages, else ranges of `size`."""
    cut = counts.where("pages > 0").select("doc_id", F.posexplode(token_ranges(F.col("pages"), threshold, size)).alias("batch_no", "r"))
    return cut.select("doc_id", "batch_no", "r.start_page", "r.end_page")


def batch_raw_text(pages: DataFrame, size: int = 5) -> DataFrame:
    """The texts of a batch's pages, each followed by a line break."""
    batch = F.floor((F.col("page_no") - 1) / size).cast("int").alias("batch_no")
    return pages.groupBy("doc_id", batch).agg(F.array_join(F.transform(in_order("text", "page_no"), lambda x: F.concat(x, F.lit("\n"))), "").alias("raw_text"))


def is_last_batch(batches: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("batch_no")
    return batches.withColumn("is_last", F.lead("batch_no").over(order).isNull())


def assemble_extraction(batches: DataFrame) -> DataFrame:
    """`partial`: batch texts that have arrived, in order; `markdown`: the same trimmed."""
    joined = batches.groupBy("doc_id").agg(F.array_join(in_order("text", "batch_no"), "\n\n").alias("partial"))
    return joined.select("doc_id", "partial", trim_ws(F.col("partial")).alias("markdown"))


def extraction_complete(batches: DataFrame) -> DataFrame:
    """Done when all of `total` batches have a text and there is at least one."""
    done = batches.groupBy("doc_id").agg(F.count("text").alias("completed"), F.max("total").cast("long").alias("total"))
    return done.select("doc_id", "completed", "total", ((F.col("completed") == F.col("total")) & (F.col("total") > 0)).alias("complete"))


def progress(batches: DataFrame) -> DataFrame:
    """Batches with a text, all batches, percent rounded half up."""
    done = batches.groupBy("doc_id").agg(F.count("text").alias("done"), F.count("*").alias("total"))
    return done.select("doc_id", "done", "total", F.floor(F.lit(100) * F.col("done") / F.col("total") + 0.5).cast("long").alias("percent"))


def concat_fragments(fragments: DataFrame) -> DataFrame:
    """A draft is its fragments in order; a null fragment is empty."""
    return fragments.groupBy("doc_id", "chunk_no").agg(F.array_join(in_order(F.coalesce("text", F.lit("")), "seq"), "").alias("draft_text"))
