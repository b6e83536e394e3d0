"""The caller's model function on tables of requests. The only Python on the executors outside the corpus operators."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.sources.attempt_log import AttemptLog, Segment, place

from .attempts import MAX_SHORT, MAX_TRANSLATION
from .requests import NONE, SUMMARY_LINES, TAIL_CHARS, request_text

ATTEMPT = "doc_id long, chunk_no int, attempt_no int, reply string, http_status int, error_message string, ts timestamp"
#: What an attempt of the whole loop leaves: the call, and the fields of the reply that it came to.
TRANSLATION = "doc_id long, chunk_no int, attempt_no int, request_sha256 string, translated string, new_terms array<string>, new_characters array<string>, summary string, missing_content boolean, short boolean, http_status int, error_message string, ts timestamp"
#: The same for Arrow, and rows of a batch of attempts.
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("chunk_no", pa.int32()), ("attempt_no", pa.int32()), ("request_sha256", pa.string()), ("translated", pa.string()), ("new_terms", pa.list_(pa.string())),
    ("new_characters", pa.list_(pa.string())), ("summary", pa.string()), ("missing_content", pa.bool_()), ("short", pa.bool_()), ("http_status", pa.int32()), ("error_message", pa.string()), ("ts", pa.timestamp("us", "UTC")),
])
BATCH_ROWS = 500
_COLUMNS = ["doc_id", "chunk_no", "attempt_no", "reply", "http_status", "error_message", "ts"]


def _attempt(doc_id, chunk_no, call: Callable[[], str]) -> tuple:
    """One call as an attempt row; a failure's `status` attribute, if it has one, is its HTTP status."""
    reply = status = message = None
    try:
        reply = call()
    except Exception as error:  # a failure is a row
        status, message = getattr(error, "status", None), str(error)
    return doc_id, chunk_no, 1, reply, status, message, pd.Timestamp.now(tz="UTC")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS, dtype=object).astype({"http_status": "Int32", "ts": "datetime64[us, UTC]"})


def run_model(requests: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    """An attempt row, with `reply` or `error_message`, for each independent request (`doc_id`, `chunk_no`, `request`)."""

    def run(parts):
        for part in parts:
            asked = zip(part["doc_id"], part["chunk_no"], part["request"], strict=True)
            yield _frame([_attempt(doc_id, chunk_no, lambda request=request: fn(request)) for doc_id, chunk_no, request in asked])

    return requests.select("doc_id", "chunk_no", "request").mapInPandas(run, ATTEMPT)


def translate_in_order(requests: DataFrame, fn: Callable[[str, str], str]) -> DataFrame:
    """fn(request, previous reply), chunk by chunk within a document; a failure ends the document."""

    def run(doc: pd.DataFrame) -> pd.DataFrame:
        out, previous = [], ""
        for row in doc.sort_values("chunk_no").itertuples():
            out.append(_attempt(row.doc_id, row.chunk_no, lambda row=row, previous=previous: fn(row.request, previous)))
            previous = out[-1][3]
            if out[-1][5] is not None:
                break
        return _frame(out)

    return requests.select("doc_id", "chunk_no", "request").groupBy("doc_id").applyInPandas(run, ATTEMPT)


class _Short(Exception):
    pass


def _strings(found) -> list[str]:
    return [str(x) for x in found if x is not None] if isinstance(found, list) else []


def _reply(json_text: str | None, draft: str) -> dict:
    """The fields of a correction; a blank or bad one, or one without a text, keeps the draft."""
    try:
        found = json.loads(json_text) if (json_text or "").strip() else {}
    except ValueError:
        found = {}
    found = found if isinstance(found, dict) else {}
    text, summary = (x if isinstance(x, str) and x else None for x in map(found.get, ("correctedTranslation", "chunkSummary")))
    return {
        "translated": text or draft, "new_terms": _strings(found.get("newTerms")), "new_characters": _strings(found.get("newCharacters")),
        "summary": summary, "missing_content": found.get("missingContentDetected") is True,
    }


def _is_short(source: str, target: str) -> bool:
    n, m = (len(re.sub(r"\s+", "", x)) for x in (source, target))
    return n > 150 and m < n * 0.02


def _can_retry(status, message: str) -> bool:
    return status == 429 or re.search("429|quota|rate limit|suspiciously short", message.lower()) is not None


def _given(text) -> list[str]:
    return [text] if isinstance(text, str) and text not in ("", NONE) else []


def translate_with_context(requests: DataFrame, draft: Callable[[str], str], correct: Callable[[str, str], str] | None = None, wait: Callable[[float], None] = time.sleep, most: int = MAX_TRANSLATION, log: AttemptLog | None = None, known: DataFrame | None = None) -> DataFrame:
    """Every attempt at the chunks (`doc_id`, `chunk_no`, `source_text`, `style`, `glossary`, `characters`), in order within
    a document, while documents run in parallel; `attempts.translation_outcome` reads the rows.

    draft(request) gives a text and correct(request, draft) the JSON of a reply. Each request carries the tails of the
    chunk before, the glossary and characters grown by the replies so far, and the last lines of their summaries. A short
    draft, a limit of the service and missing content are tried again, `most` times in all; short drafts pass after
    MAX_SHORT retries, missing content at the last attempt. Any other failure, or the last one, ends the document there.
    Null texts are empty. A task goes through its documents one after the other and holds one chunk at a time. With a `log`
    the attempts at a chunk are committed to it once the chunk has ended, and a retried task reads what the try before it has
    committed. A chunk in `known` (`doc_id`, `chunk_no`, `rows`) is not asked for: what the next request carries is built up
    from its rows.
    """
    run_name = uuid.uuid4().hex

    def attempt(request: str, source: str, tries: int) -> dict:
        row = {"request_sha256": hashlib.sha256(request.encode("utf-8", "surrogatepass")).hexdigest(), "short": False}
        try:
            text = draft(request) or ""
            row["short"] = _is_short(source, text)
            if row["short"] and tries <= MAX_SHORT:
                raise _Short("the draft is suspiciously short")
            row |= _reply(correct(request, text), text) if correct else _reply(None, text)
        except Exception as error:  # a failure is a row
            row |= {"http_status": getattr(error, "status", None), "error_message": str(error)}
        return row | {"attempt_no": tries, "ts": pd.Timestamp.now(tz="UTC")}

    def tried(request: str, source: str) -> list[dict]:
        """The attempts until one ends the chunk."""
        rows = []
        for tries in range(1, most + 1):
            rows.append(row := attempt(request, source, tries))
            message = row.get("error_message")
            again = _can_retry(row["http_status"], message) if message is not None else row["missing_content"]
            if not again:
                break
            if message is not None and tries < most:
                wait(1 if "suspiciously short" in message.lower() else 5 * tries)
        return rows

    def document(chunks: Iterable[dict], known_rows: Callable[[dict], list[dict] | None], segment: Segment | None) -> Iterator[dict]:
        """The attempts at a document's chunks, in order."""
        before, notes, first = ("", ""), [], None
        for chunk in chunks:
            if first is None:
                first = chunk
                terms, people = _given(first["glossary"]), _given(first["characters"])
            source, ids = chunk["source_text"] or "", {c: chunk[c] for c in ("doc_id", "chunk_no")}
            story = "\n".join("\n".join(notes).split("\n")[-SUMMARY_LINES:])
            context = {"style": first["style"] or "", "glossary": "\n".join(terms), "characters": "\n".join(people), "plot_summary": story}
            rows = known_rows(chunk)
            if not rows:
                rows = [ids | row for row in tried(request_text(context, *before, source), source)]
                if segment:
                    segment.add(**ids, rows=rows)
            yield from rows
            row = rows[-1]
            if row.get("error_message") is not None:
                break
            terms, people = terms + row["new_terms"], people + row["new_characters"]
            notes += [f"- {row['summary']}"] if row["summary"] else []
            before = source[-TAIL_CHARS:], row["translated"][-TAIL_CHARS:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = f"{run_name}-{TaskContext.get().partitionId()}"
        segment, earlier = (log.segment(part), log.earlier(part)) if log else (None, iter(()))
        ahead = next(earlier, None)

        def known_rows(chunk: dict) -> list[dict] | None:
            nonlocal ahead
            here = place(chunk["doc_id"], chunk["chunk_no"])
            while ahead and ahead[0] < here:
                ahead = next(earlier, None)
            return chunk["known"] or (ahead[1] if ahead and ahead[0] == here else None)

        chunks = (row for batch in batches for row in batch.to_pylist())
        found = (row for _, doc in itertools.groupby(chunks, key=lambda c: c["doc_id"]) for row in document(doc, known_rows, segment))
        while rows := list(itertools.islice(found, BATCH_ROWS)):
            yield pa.RecordBatch.from_pylist([row | {"ts": pd.Timestamp(row["ts"])} for row in rows], _ARROW)
        if segment:
            segment.close()

    asked = requests.select("doc_id", "chunk_no", "source_text", "style", "glossary", "characters")
    if known is None:
        asked = asked.withColumn("known", F.lit(None).cast("string"))
    else:
        asked = asked.join(known.select("doc_id", "chunk_no", F.col("rows").alias("known")), ["doc_id", "chunk_no"], "left")
    return asked.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_no").mapInArrow(run, TRANSLATION)
