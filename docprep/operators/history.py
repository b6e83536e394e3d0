"""Progress history: an append-only log, its current state, and where to resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def history_append(rows: DataFrame, path: str) -> None:
    """One row for each save; an empty style or glossary is null."""
    rows.withColumns({c: F.nullif(c, F.lit("")) for c in ("translation_style", "glossary_text")}).write.mode("append").parquet(path)


def history_current(log: DataFrame) -> DataFrame:
    """The latest record of each id; of equal times the one further on. A maximum, so it is combined before the shuffle."""
    fields = [c for c in log.columns if c != "id"]
    latest = log.groupBy("id").agg(F.max_by(F.struct(*fields), F.struct("ts", "current_chunk")).alias("r"))
    return latest.select("id", *[F.col(f"r.{c}") for c in fields])


def history_minus_deleted(log: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Records of ids without a tombstone; where tombstones have a time `ts`, records saved later than the last one count."""
    if "ts" not in tombstones.columns:
        return log.join(tombstones.select("id").distinct(), "id", "left_anti")
    last = tombstones.groupBy("id").agg(F.max("ts").alias("deleted"))
    return log.join(last, "id", "left").where(F.col("deleted").isNull() | (F.col("ts") > F.col("deleted"))).drop("deleted")


def history_delete(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The current records that remain when `ids` are deleted; a record saved after its tombstone's `ts` is back."""
    return history_minus_deleted(history_current(log), ids)


def history_list(log: DataFrame) -> DataFrame:
    return history_current(log).orderBy(F.desc("ts"), "id")


def history_get(log: DataFrame, record_id) -> DataFrame:
    return history_current(log.where(F.col("id") == record_id))


def pending_chunks(chunks: DataFrame, accepted: DataFrame) -> DataFrame:
    return chunks.join(accepted.select("doc_id", "chunk_no").distinct(), ["doc_id", "chunk_no"], "left_anti")


def resume_filter(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Chunks from the saved one on; a finished document starts again; one without a record starts at 0."""
    done = (F.col("current_chunk") == F.col("total_chunks")) & (F.col("total_chunks") > 0)
    start = state.select("doc_id", F.when(done, 0).otherwise(F.col("current_chunk")).alias("start"))
    return chunks.join(start, "doc_id", "left").where(F.col("chunk_no") >= F.coalesce("start", F.lit(0))).drop("start")


def select_text(docs: DataFrame, mode: str) -> DataFrame:
    """The translation in translate mode, but the source while a document is being extracted or analysed."""
    early = F.coalesce(F.col("stage").isin("extracting", "analyzing"), F.lit(False))
    return docs.select("doc_id", F.when(F.lit(mode == "translate") & ~early, F.col("translated_text")).otherwise(F.col("extracted_text")).alias("text"))
