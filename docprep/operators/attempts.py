"""What attempts at a chunk or a batch came to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docprep.functions.text import is_retryable, suspiciously_short

MAX_TRANSLATION, MAX_EXTRACTION, MAX_SHORT = 6, 3, 2


def short_outcome(attempts: DataFrame, max_retry: int = MAX_SHORT) -> DataFrame:
    """`outcome`: retry a short draft at first, accept it with a warning after `max_retry` retries, else ok."""
    short = suspiciously_short(F.col("source"), F.col("target"))
    return attempts.select("doc_id", "chunk_no", "retries", F.when(short & (F.col("retries") < max_retry), "retry").when(short, "accept_warn").otherwise("ok").alias("outcome"))


def missing_content(replies: DataFrame, most: int = MAX_TRANSLATION) -> DataFrame:
    """`retry` where a reply says that content is missing, but for the last attempt, which is accepted."""
    flagged = F.coalesce("missing_content", F.lit(False))
    return replies.select("doc_id", "chunk_no", "attempt_no", (flagged & (F.col("attempt_no") < most)).alias("retry"))


def attempt_stats(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("doc_id", "chunk_no").agg(F.count("*").alias("attempts"), F.max("attempt_no").alias("final_attempt"), F.max_by("error_message", F.when(F.col("error_message").isNotNull(), F.col("attempt_no"))).alias("last_error"))


def translation_outcome(attempts: DataFrame, most: int = MAX_TRANSLATION) -> DataFrame:
    """`outcome`, `attempt_no` of the attempt that ended each chunk, or `pending` while none has.

    An attempt without an error ends the chunk as accepted, unless content is missing and attempts are left. A
    retryable error counts one more until the last, which fails; another error fails at once. One counter serves all.
    """
    order = Window.partitionBy("doc_id", "chunk_no").orderBy("attempt_no")
    tried = attempts.withColumn("tries", F.row_number().over(order))
    error = F.col("error_message").isNotNull() | F.coalesce(F.col("http_status") >= 400, F.lit(False))
    missing = F.coalesce("missing_content", F.lit(False))
    spent = F.col("tries") >= most
    ends = F.when(error & is_retryable(F.col("http_status"), F.col("error_message")), F.when(spent, "failed")).when(error, "failed").when(missing & ~spent, None).otherwise("accepted")
    last = F.min_by(F.struct("end", "attempt_no"), F.when(F.col("end").isNotNull(), F.col("tries")))
    return tried.withColumn("end", ends).groupBy("doc_id", "chunk_no").agg(last.alias("x"), F.max("attempt_no").alias("latest")).select("doc_id", "chunk_no", F.coalesce("x.end", F.lit("pending")).alias("outcome"), F.coalesce("x.attempt_no", "latest").alias("attempt_no"))


def extraction_outcome(attempts: DataFrame, most: int = MAX_EXTRACTION) -> DataFrame:
    """`outcome` of each batch: accepted, empty (the last batch, without text, failed `most` times), failed, or pending."""
    done = attempts.groupBy("doc_id", "batch_no").agg(F.bool_or("ok").alias("ok"), F.count("*").alias("tries"), F.bool_and("is_last").alias("is_last"), F.bool_or("has_raw").alias("has_raw"))
    spent = F.col("tries") >= most
    return done.select("doc_id", "batch_no", F.when(F.col("ok"), "accepted").when(spent & F.col("is_last") & ~F.col("has_raw"), "empty").when(spent, "failed").otherwise("pending").alias("outcome"))


def document_status(outcomes: DataFrame) -> DataFrame:
    """error if a chunk failed, completed if all were accepted, else translating."""
    seen = outcomes.groupBy("doc_id").agg(F.bool_or(F.col("outcome") == "failed").alias("bad"), F.bool_and(F.col("outcome") == "accepted").alias("good"))
    return seen.select("doc_id", F.when(F.col("bad"), "error").when(F.col("good"), "completed").otherwise("translating").alias("status"))


def eta(log: DataFrame) -> DataFrame:
    """`eta_seconds` after each save: time since the run began over all chunks done, times those left; `eta_this_run`
    divides by the chunks done in this run only."""
    run = Window.partitionBy("id")
    order = run.orderBy("ts", "current_chunk")
    spent = F.timestamp_diff("MICROSECOND", F.min("ts").over(run), "ts")
    left = F.col("total_chunks") - F.col("current_chunk")
    here = F.col("current_chunk") - F.first("current_chunk").over(order)
    rounded = lambda n: F.when(n > 0, F.floor(spent / n * left / 1e6 + 0.5)).cast("long")
    return log.select("id", "ts", "current_chunk", rounded(F.col("current_chunk")).alias("eta_seconds"), rounded(here).alias("eta_this_run"))
