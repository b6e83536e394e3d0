"""The same aggregates on streams; each equals its batch form once the stream has ended.

What a stream keeps is bounded by its watermark: marks by which replays are known. What has been found so far, with the
fragments of open chunks, is a table of current rows (`sources/current_table.py`), of which a batch rewrites the buckets it
touches.
Rows and their replays carry the same `event_time`; rows older than the watermark are left out, so a row counts once or, if
it comes later than `delay` after younger ones, not at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.sources.current_table import BUCKETS, CurrentTable

#: How much later than the youngest row a row may come.
DELAY = "10 minutes"


def stream_drafts(fragments: DataFrame, delay: str = DELAY) -> DataFrame:
    """`doc_id`, `chunk_no`, `fragments`, `draft_text`, `final`, `parts`, `until` of each fragment that is not a replay;
    `longest_draft` puts them together.

    Fragments `seq` from 0, in any order, null ones empty; `last` marks a chunk's last one. The state is the numbers of the
    fragments that came within `delay`, without texts.
    """
    given = fragments.select(F.col("doc_id").cast("long"), F.col("chunk_no").cast("int"), F.col("seq").cast("int"), "text", F.coalesce("last", F.lit(False)).alias("last"), "event_time")
    return fragment_drafts(given.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["doc_id", "chunk_no", "seq", "last"]))


def fragment_drafts(fragments: DataFrame) -> DataFrame:
    """Each fragment as a draft of one, which `longest_draft` adds to the others of its chunk."""
    part = F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))
    whole = F.col("last") & (F.col("seq") == 0)
    return fragments.select("doc_id", "chunk_no", F.lit(1).cast("long").alias("fragments"), part["text"].alias("draft_text"), whole.alias("final"), F.array(part).alias("parts"), F.when(F.col("last"), F.col("seq")).alias("until"))


def longest_draft(drafts: DataFrame) -> DataFrame:
    """The draft of each chunk: of all fragments that are there or, once all up to the last one are, of those, which nothing
    changes any more. `parts` are the fragments (`seq`, `text`) of an open chunk, none of a whole one; `until` is the last."""
    each = drafts.groupBy("doc_id", "chunk_no").agg(
        F.max(F.when(F.col("final"), F.struct("fragments", "draft_text"))).alias("done"), F.array_sort(F.flatten(F.collect_list("parts"))).alias("sorted"), F.min("until").alias("until")
    )
    each = each.withColumn("parts", F.filter("sorted", lambda x, i: (i == 0) | (F.get("sorted", i - 1)["seq"] != x["seq"])))
    upto = F.filter("parts", lambda x: x["seq"] <= F.col("until"))
    each = each.withColumn("full", F.col("done").isNotNull() | F.coalesce(F.size(upto) == F.col("until") + 1, F.lit(False)))
    used = F.when(F.col("full"), upto).otherwise(F.col("parts"))
    text = F.array_join(F.transform(used, lambda x: x["text"]), "")
    return each.select(
        "doc_id", "chunk_no", F.coalesce("done.fragments", F.size(used).cast("long")).alias("fragments"), F.coalesce("done.draft_text", text).alias("draft_text"),
        F.col("full").alias("final"), F.when(F.col("full"), F.slice("parts", 1, 0)).otherwise(F.col("parts")).alias("parts"), "until",
    )


def stream_progress(replies: DataFrame, delay: str = DELAY) -> DataFrame:
    """`doc_id`, `done` (0 or 1), `total` of each reply that is not a replay. A batch without a text may get one later."""
    marked = replies.withColumn("done", F.col("text").isNotNull().cast("long")).withWatermark("event_time", delay)
    return marked.dropDuplicatesWithinWatermark(["doc_id", "batch_no", "done"]).select("doc_id", "done", F.col("total").cast("long").alias("total"))


def added_progress(rows: DataFrame) -> DataFrame:
    """Batches done and all batches of each document."""
    return rows.groupBy("doc_id").agg(F.sum("done").alias("done"), F.max("total").alias("total"))


def with_percent(progress: DataFrame) -> DataFrame:
    return progress.select("doc_id", "done", "total", F.floor(F.lit(100) * F.col("done") / F.col("total") + 0.5).cast("long").alias("percent"))


def stream_history(log: DataFrame) -> DataFrame:
    """Latest record of each id: the stream keeps nothing; `history.history_current` merges the records into the table."""
    return log


def run_to_end(stream: DataFrame, folder: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> DataFrame:
    """Run a stream over what has arrived and return the current row of each key.

    With the same folder a later run goes on where this one ended. A batch that is run again changes nothing.
    """
    table = CurrentTable(stream.sparkSession, f"{folder}/table", stream.schema, keys, merge, buckets)
    run = stream.writeStream.outputMode("update").foreachBatch(table.apply).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return table.read()
