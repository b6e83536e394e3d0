"""Requests for each chunk with carried context, and the replies to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docprep.functions.text import trim_ws

from .ordered import in_order

#: Section heads of an analysis reply and the sentinel for an empty section.
TERMS_HEAD, CHARACTERS_HEAD, NONE = "【術語表】：", "【角色圖譜】：", "無"
REPLY = "correctedTranslation string, newTerms array<string>, newCharacters array<string>, chunkSummary string, foundHallucinations boolean, missingContentDetected boolean"
TAIL_CHARS = 1000
#: Our own wording of a request; `{}` stands for the parts. The defaults are for context that is not there yet.
DEFAULTS = {"style": "general", "glossary": "keep names and headings the same throughout", "characters": "find the characters and keep them the same", "plot_summary": "this is the beginning"}
BEFORE = "\n\nPrevious source:\n{}\nPrevious translation:\n{}"
REQUEST = "Style: {}\nGlossary:\n{}\nCharacters:\n{}\nThe story so far:\n{}{}\n\nTranslate:\n{}"
#: Heads of the two requests that analyse a document, in our own wording; the sections of the reply have the fixed heads.
TERMS_REQUEST = f"List terms under {TERMS_HEAD} and characters under {CHARACTERS_HEAD}, a line for each.\n\n"
STYLE_REQUEST = "Describe kind, voice and readers of this text as a style guide.\n\n"
SUMMARY_LINES = 10


def _doc():
    return Window.partitionBy("doc_id").orderBy("chunk_no")


def _before():
    return _doc().rowsBetween(Window.unboundedPreceding, -1)


def parse_analysis(replies: DataFrame) -> DataFrame:
    """`glossary`, `characters` of an analysis reply; a missing section is the sentinel, an empty one stays empty."""

    def section(pattern: str) -> Column:
        return F.when(F.col("reply").rlike(pattern), trim_ws(F.regexp_extract("reply", pattern, 1))).otherwise(NONE)

    return replies.select("doc_id", section(f"(?s){TERMS_HEAD}(.*?)(?={CHARACTERS_HEAD}|\\z)").alias("glossary"), section(f"(?s){CHARACTERS_HEAD}(.*)").alias("characters"))


def parse_terms(analysis: DataFrame) -> DataFrame:
    """`doc_id`, `line_no`, `source_term`, `target_term` of glossary lines `- source: target`."""
    lines = analysis.select("doc_id", F.posexplode(F.split("glossary", "\n", -1)).alias("line_no", "line"))
    form = "^- *([^:]+?) *: *(.+?) *\\z"
    return lines.where(F.col("line").rlike(form)).select("doc_id", "line_no", F.regexp_extract("line", form, 1).alias("source_term"), F.regexp_extract("line", form, 2).alias("target_term"))


def parse_reply(replies: DataFrame) -> DataFrame:
    """The reply's fields; blank JSON is an empty reply, and bad JSON or an empty correction keeps the draft."""
    text = F.when(trim_ws(F.coalesce("reply_json", F.lit(""))) == "", "{}").otherwise(F.col("reply_json"))
    parsed = replies.withColumn("r", F.from_json(text, REPLY))
    return parsed.select("doc_id", "chunk_no", F.coalesce(F.nullif("r.correctedTranslation", F.lit("")), "draft_text").alias("translated"), F.col("r.newTerms").alias("new_terms"), F.col("r.newCharacters").alias("new_characters"), F.col("r.chunkSummary").alias("summary"), F.coalesce("r.foundHallucinations", F.lit(False)).alias("found_hallucinations"), F.coalesce("r.missingContentDetected", F.lit(False)).alias("missing_content"))


def _tail(c: str, n: int) -> Column:
    return F.coalesce(F.right(F.lag(c).over(_doc()), F.lit(n)), F.lit(""))


def _given(start: str) -> Column:
    """The initial lines as an array; the sentinel, '' and null are none."""
    return F.filter(F.array(F.nullif(F.nullif(start, F.lit(NONE)), F.lit(""))), lambda x: x.isNotNull())


def _lines(added: str) -> Column:
    """The lines that a reply adds, as one text; null if there are none."""
    kept = F.filter(F.coalesce(added, F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))


def _noted() -> Column:
    """The line of a reply's summary; null if it has none."""
    return F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("- "), "summary"))


#: What grows from chunk to chunk.
GROWING = {"terms": lambda: _lines("new_terms"), "characters": lambda: _lines("new_characters"), "summary": _noted}


def _upto(name: str) -> Column:
    """How many characters of the document's lines, each with its line end, come from the chunks before this one."""
    return F.coalesce(F.sum(F.char_length(GROWING[name]()) + 1).over(_before()), F.lit(0)).cast("int").alias(f"{name}_upto")


def document_lines(replies: DataFrame, *names: str) -> DataFrame:
    """`doc_id` and `<name>_lines`: the lines of all chunks of a document, in order, as one text."""
    return replies.groupBy("doc_id").agg(*[F.array_join(in_order(GROWING[n](), "chunk_no"), "\n").alias(f"{n}_lines") for n in names])


def _seen(name: str) -> Column:
    """The lines that a chunk sees, which begin its document's; null if there are none."""
    return F.when(F.col(f"{name}_upto") > 0, F.left(f"{name}_lines", F.col(f"{name}_upto") - 1))


def _grown(start: str, name: str) -> Column:
    return F.array_join(F.concat(_given(start), F.array(_seen(name))), "\n")


def _last_lines(name: str, n: int) -> Column:
    return F.substring_index(F.coalesce(_seen(name), F.lit("")), "\n", -n)


def _places(rows: DataFrame, wanted: DataFrame | None) -> DataFrame:
    return rows if wanted is None else rows.join(wanted.select("doc_id", "chunk_no"), ["doc_id", "chunk_no"], "left_semi")


def _running(replies: DataFrame, initial: DataFrame, name: str, column: str, wanted: DataFrame | None) -> DataFrame:
    places = _places(replies.select("doc_id", "chunk_no", _upto(name)), wanted)
    known = places.join(document_lines(replies, name), "doc_id").join(initial.select("doc_id", F.col(column).alias("start")), "doc_id", "left")
    return known.select("doc_id", "chunk_no", _grown("start", name).alias(column))


def prev_source_tail(chunks: DataFrame, n: int = TAIL_CHARS) -> DataFrame:
    return chunks.select("doc_id", "chunk_no", _tail("source_text", n).alias("prev_source"))


def prev_translation_tail(chunks: DataFrame, n: int = TAIL_CHARS) -> DataFrame:
    return chunks.select("doc_id", "chunk_no", _tail("translated", n).alias("prev_translation"))


def running_glossary(replies: DataFrame, initial: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The glossary that chunk i sees: the initial one and the new terms of all chunks before; the sentinel is empty.

    A document's terms are written once; a chunk has a length, and its text is made from both. What is made is as long as
    its parts, so for all chunks of a document it grows with their square: with `wanted` (`doc_id`, `chunk_no`), the
    pending chunks say, it is made for those only.
    """
    return _running(replies, initial, "terms", "glossary", wanted)


def running_characters(replies: DataFrame, initial: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The same for the characters."""
    return _running(replies, initial, "characters", "characters", wanted)


def rolling_summary(replies: DataFrame, lines: int = SUMMARY_LINES, wanted: DataFrame | None = None) -> DataFrame:
    """The last `lines` lines of the summaries before chunk i, each led by `- `; empty summaries are skipped."""
    places = _places(replies.select("doc_id", "chunk_no", _upto("summary")), wanted)
    return places.join(document_lines(replies, "summary"), "doc_id").select("doc_id", "chunk_no", _last_lines("summary", lines).alias("plot_summary"))


def request_context(chunks: DataFrame, replies: DataFrame, initial: DataFrame, n: int = TAIL_CHARS, lines: int = SUMMARY_LINES, wanted: DataFrame | None = None) -> DataFrame:
    """All that a chunk's request carries: both tails, the running glossary and characters, the summary.

    One window serves the tails and the lengths, so the chunks are sorted by document once; the lines of a document are
    joined to its chunks where they already are. With `wanted` only those chunks get texts.
    """
    start = initial.select("doc_id", "style", F.col("glossary").alias("start_terms"), F.col("characters").alias("start_characters"))
    known = chunks.join(replies, ["doc_id", "chunk_no"], "left")
    seen = known.select("doc_id", "chunk_no", "source_text", _tail("source_text", n).alias("prev_source"), _tail("translated", n).alias("prev_translation"), *map(_upto, GROWING))
    seen = _places(seen, wanted).join(document_lines(replies, *GROWING), "doc_id", "left").join(start, "doc_id", "left")
    return seen.select(
        "doc_id", "chunk_no", "source_text", "style", "prev_source", "prev_translation",
        _grown("start_terms", "terms").alias("glossary"), _grown("start_characters", "characters").alias("characters"),
        _last_lines("summary", lines).alias("plot_summary"),
    )


def glossary_final(analysis: DataFrame, replies: DataFrame) -> DataFrame:
    grown = replies.groupBy("doc_id").agg(F.flatten(in_order("new_terms", "chunk_no")).alias("terms"))
    return analysis.join(grown, "doc_id", "left").select("doc_id", F.array_join(F.concat(_given("glossary"), F.coalesce("terms", F.array().cast("array<string>"))), "\n").alias("glossary"))


def assemble_translation(chunks: DataFrame) -> DataFrame:
    """Accepted chunks in order, each followed by a blank line."""
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(in_order("translated", "chunk_no"), lambda x: F.concat(x, F.lit("\n\n"))), "").alias("translated_text"))


def running_translated_text(chunks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The text that is saved after each chunk, which begins the document's; with `wanted` for those chunks only."""
    upto = F.coalesce(F.sum(F.char_length("translated") + 2).over(_doc().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    places = _places(chunks.select("doc_id", "chunk_no", upto.cast("int").alias("upto")), wanted)
    return places.join(assemble_translation(chunks), "doc_id").select("doc_id", "chunk_no", F.left("translated_text", F.col("upto")).alias("saved_text"))


def requests(chunks: DataFrame, analysis: DataFrame) -> DataFrame:
    """Chunks with their document's style, glossary and characters."""
    return chunks.join(analysis.select("doc_id", "style", "glossary", "characters"), "doc_id", "left")


def replies_to_chunks(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    return chunks.join(replies, ["doc_id", "chunk_no"])


def _filled(template: str, *parts) -> Column:
    fixed = [F.lit(x) for x in template.split("{}")]
    return F.concat(fixed[0], *[x for pair in zip(parts, fixed[1:], strict=True) for x in pair])


def build_request(chunks: DataFrame) -> DataFrame:
    """One instruction text for each chunk, in our own wording, with defaults where there is no context yet."""
    given = [F.when(F.coalesce(c, F.lit("")).isin("", NONE), default).otherwise(F.col(c)) for c, default in DEFAULTS.items()]
    before = F.when(F.coalesce("prev_source", F.lit("")) == "", "").otherwise(_filled(BEFORE, F.col("prev_source"), F.coalesce("prev_translation", F.lit(""))))
    return chunks.select("doc_id", "chunk_no", _filled(REQUEST, *given, before, F.col("source_text")).alias("request"))


def request_text(context: dict[str, str], prev_source: str, prev_translation: str, source_text: str) -> str:
    """The text of `build_request` for one chunk, for the loop that learns its context as it goes."""
    given = [default if (context[c] or "") in ("", NONE) else context[c] for c, default in DEFAULTS.items()]
    return REQUEST.format(*given, BEFORE.format(prev_source, prev_translation) if prev_source else "", source_text)
