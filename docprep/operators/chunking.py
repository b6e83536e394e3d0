"""Bounded chunks of Markdown: sections, then paragraphs, then sentences, packed in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docprep.functions.text import let, split_paragraphs, split_sections, split_sentences, trim_ws

MAX_CHARS = 3500


def _pieces(md: Column, limit: int, mode: str) -> Column:
    """Array of (text, size, nl: ends in a line break, kind S, P or N, opens: the size test of an enclosing long part has fired)."""

    def piece(text: Column, kind: str, opens: Column) -> Column:
        return F.struct(text.alias("text"), F.char_length(text).alias("size"), text.endswith("\n").alias("nl"), F.lit(kind).alias("kind"), opens.alias("opens"))

    def paragraph(p: Column, at: Column) -> Column:
        cut = F.transform(split_sentences(p, mode), lambda s, i: piece(s, "N", i == 0))
        return F.when(F.char_length(p) > limit, cut).otherwise(F.array(piece(p, "P", at == 0)))

    def section(s: Column) -> Column:
        cut = F.flatten(F.transform(split_paragraphs(s), paragraph))
        return F.when(F.char_length(s) > limit, cut).otherwise(F.array(piece(s, "S", F.lit(False))))

    return F.flatten(F.transform(split_sections(md), section))


def _starts(pieces: Column, limit: int) -> Column:
    """Indexes of the pieces that open a chunk. The state is the chunk's length and last character, never its text."""
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("nl"), F.lit(0).alias("i"), F.array(F.lit(0)).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        flush = (acc["n"] > 0) & (x["opens"] | (acc["n"] + x["size"] > limit))
        n = F.when(flush, 0).otherwise(acc["n"])
        sep = F.when((n == 0) | (x["kind"] == "N"), 0).when(x["kind"] == "P", 2).when(acc["nl"], 0).otherwise(1)
        ends = F.when(x["size"] > 0, x["nl"]).when(sep > 0, F.lit(True)).otherwise(acc["nl"] & (n > 0))
        at = F.when(flush, F.concat(acc["at"], F.array(acc["i"]))).otherwise(acc["at"])
        return F.struct((n + sep + x["size"]).alias("n"), ends.alias("nl"), (acc["i"] + 1).alias("i"), at.alias("at"))

    return F.aggregate(pieces, start, step, lambda acc: acc["at"])


def _text(part: Column) -> Column:
    """A chunk from its pieces; leading empty pieces add no separator."""

    def joined(part: Column, first: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(part, i - 1)
            sep = F.when((i <= first) | (x["kind"] == "N"), "").when(x["kind"] == "P", "\n\n").when((before["size"] == 0) | before["nl"], "").otherwise("\n")
            return F.concat(sep, x["text"])

        return F.array_join(F.transform(part, one), "")

    def empty_ahead(part: Column) -> Column:
        at = F.array_position(F.transform(part, lambda x: x["size"] > 0), F.lit(True))
        return F.when(at == 0, F.size(part)).otherwise(at - 1)

    return trim_ws(let(part, lambda p: let(empty_ahead(p), lambda first: joined(p, first))))


def chunk_documents(docs: DataFrame, limit: int = MAX_CHARS, mode: str = "reference", id_col: str = "doc_id", md_col: str = "markdown") -> DataFrame:
    """`<id>`, `chunk_no` (from 0), `source_text`, `n_chars`: every document's chunks of about `limit` characters.

    No shuffle and no Python: a document is one array of pieces and one fold over their lengths. Null and blank texts
    have no chunk. A piece over the limit is a chunk of its own; separators are not counted.
    """
    # outer generators: for the others Spark infers a filter on the array, which would build it twice
    pieces = docs.select(F.col(id_col).alias("id"), F.explode_outer(F.array(_pieces(F.col(md_col), limit, mode))).alias("pieces"))
    packed = pieces.select("id", F.posexplode_outer(let(_starts(F.col("pieces"), limit), lambda at: _texts(F.col("pieces"), at))).alias("chunk_no", "source_text"))
    return packed.where("source_text IS NOT NULL").select(F.col("id").alias(id_col), "chunk_no", "source_text", F.char_length("source_text").alias("n_chars"))


def _texts(pieces: Column, at: Column) -> Column:
    """The chunks that start at `at`, without a blank last one."""

    def one(lo: Column, i: Column) -> Column:
        return _text(F.slice(pieces, lo + 1, F.coalesce(F.get(at, i + 1), F.size(pieces)) - lo))

    return let(F.transform(at, one), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def chunk_off(docs: DataFrame, id_col: str = "doc_id", md_col: str = "markdown") -> DataFrame:
    """One chunk for each document: its whole text."""
    return docs.select(id_col, F.lit(0).alias("chunk_no"), F.col(md_col).alias("source_text"), F.char_length(md_col).alias("n_chars"))
