"""Quality rules (operator 9): per-text base rules and the cross-document frequency of normalised lines within a host.

One pass over the whole texts gives the base counts and a hash and the words of every normalised line; texts are not read
again but to take lines out. How many documents of a host hold a line is counted over distinct ids, in two steps, so that
a line that every document of the largest host holds is one row a task. Lines above the limits go; a document that loses
most of its words to them is rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, named, split_join, without_lines
from .wordhash import Batch, batches, mix

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A line goes if more than LINE_MIN_DOCS documents of its host hold it and more than LINE_MAX_SHARE of them.
LINE_MIN_DOCS = 10
LINE_MAX_SHARE = 0.01
#: A document goes if lines above the limits hold more than this share of its words.
MAX_LOST_SHARE = 0.5

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_WORD_CHAR = np.ones(256, dtype=np.int64)
_WORD_CHAR[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = 0
_BLANKS = " \t\n\x0b\x0c\r"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _total(batch: Batch, weight: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(weight)])[batch.first_word])


def _repeat_words(batch: Batch) -> np.ndarray:
    """Words of each text within windows that its own text holds twice or more."""
    at, h = batch.windows(REPEAT_WINDOW)
    h = mix(h + batch.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return _total(batch, batch.covered(at[twice], REPEAT_WINDOW).astype(np.int64))


def _normal(text: str | None) -> str | None:
    """Lower case, digits as one zero; white space is read as single blanks."""
    return re.sub("[0-9]+", "0", text.lower()) if isinstance(text, str) else None


def _line_hashes(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, two hashes and words of each line with a word."""
    if not len(b.words):
        return tuple(np.zeros(0, dtype=kind) for kind in (np.int64, np.uint64, np.uint64, np.int64))
    line = np.cumsum(b.data == 10)[b.starts]
    head = np.flatnonzero(np.concatenate([[True], (np.diff(line) != 0) | (np.diff(b.doc) != 0)]))
    words = np.diff(np.append(head, len(line)))
    place = mix((np.arange(len(line)) - np.repeat(head, words)).astype(np.uint64))
    return b.doc[head], np.add.reduceat(mix(b.words + place), head), np.add.reduceat(mix(b.words ^ mix(place)), head), words


def _read():
    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, h1 array<long>, h2 array<long>, w array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(texts), 5), dtype=np.int64)
        for b in batches(texts):
            chars = np.concatenate([[0], np.cumsum(_WORD_CHAR[b.data])])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[b.data])])
            out[b.rows, 0] = np.diff(b.first_word)
            word_chars = chars[b.ends] - chars[b.starts]
            out[b.rows, 1], out[b.rows, 2], out[b.rows, 4] = _total(b, word_chars), _total(b, symbols[b.ends] - symbols[b.starts]), _repeat_words(b)
        lines = [[], [], []]
        for row, text in enumerate(texts):
            if isinstance(text, str):
                worded = [x for x in text.split("\n") if x.strip(_BLANKS)]
                out[row, 3] = len(worded) - len(set(worded))
        for b in batches(map(_normal, texts)):
            doc, *found = _line_hashes(b)
            cut = np.searchsorted(doc, np.arange(len(b.rows) + 1))
            for column, values, kind in zip(lines, found, (np.int64, np.int64, np.int32), strict=True):
                column += [values[lo:hi].astype(kind) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
        return pd.DataFrame(out, columns=_COUNTS).assign(h1=lines[0], h2=lines[1], w=lines[2])

    return run


def _marked(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(named(text_col), F.lit(""))
    host = F.coalesce(named(host_col).cast("string"), F.lit(""))
    return durable(docs.select(named(id_col).alias("id"), F.xxhash64(text).alias("th"), host.alias("host"), _read()(text).alias("n")).select("id", "th", "host", "n.*"))


def _each_line(marked: DataFrame) -> DataFrame:
    return marked.select("id", "th", "host", F.posexplode(F.arrays_zip("h1", "h2", "w")).alias("p", "l")).select("id", "th", "host", "p", "l.*")


def frequent_lines(marked: DataFrame, min_docs: int = LINE_MIN_DOCS, max_share: float = LINE_MAX_SHARE) -> DataFrame:
    """`host`, `h1`, `h2` of the normalised lines that more documents of their host hold than the limits say."""
    documents = F.count_distinct(F.struct("id"))  # a struct, so that rows without an id count, as one document
    counts = _each_line(marked).groupBy("host", "h1", "h2").agg(documents.alias("n")).where(F.col("n") > min_docs)
    hosts = marked.groupBy("host").agg(documents.alias("docs"))
    return split_join(counts, hosts, ["host"]).where(F.col("n") > F.col("docs") * max_share).select("host", "h1", "h2")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """`id`, `th`, `host`, the base counts, `gone` (numbers of the lines above the limits, counted over lines with a word),
    `base_failed`, `n_lost_words`, `kept` for every row."""
    marked = _marked(docs, id_col, text_col, host_col)
    hits = split_join(_each_line(marked), frequent_lines(marked, **limits), ["host", "h1", "h2"])
    lost = hits.groupBy("id", "th", "host").agg(F.collect_set(F.struct("p", "w")).alias("lost"))
    lost = lost.select(F.col("id").alias("i"), F.col("th").alias("t"), F.col("host").alias("o"), "lost")
    rows = marked.drop("h1", "h2", "w")
    joined = rows.join(lost, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")) & (F.col("host") == F.col("o")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    n_lost = F.coalesce(F.aggregate("lost", F.lit(0).cast("long"), lambda a, x: a + x["w"]), F.lit(0).cast("long"))
    out = joined.select("id", "th", "host", *_COUNTS, F.col("lost.p").alias("gone"), failed.alias("base_failed"), n_lost.alias("n_lost_words"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= F.col("n_words") * MAX_LOST_SHARE))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """`<id>`, the base counts, `base_failed`, `n_lost_words` (in lines above the limits), `kept` for every row.

    kept: not base_failed, and lines above the limits hold at most half of the words. Null text has no words and fails;
    long texts are read whole. Rows of one id, repeated rows among them, are one document in the count of a line's
    documents, and so are rows without an id; each has a row here. A null host is the host "". Other columns are not read.
    """
    found = judged(docs, id_col, text_col, host_col, **limits)
    return found.select(F.col("id").alias(id_col), *_COUNTS, "base_failed", "n_lost_words", "kept")


def without_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The kept rows of `docs`, whose texts have lost the lines above the limits; other columns, whatever their names, stay."""
    found = judged(docs, id_col, text_col, host_col, **limits).where("kept").select("id", "th", "host", "gone").dropDuplicates(["id", "th", "host"])
    rows = docs.select(*[named(c).alias(f"c{n}") for n, c in enumerate(docs.columns)])
    key, text, host = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col, host_col))
    same = key.eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("th")) & (F.coalesce(host.cast("string"), F.lit("")) == F.col("host"))
    cut = F.when(F.col("gone").isNull(), text).otherwise(without_lines(text, F.col("gone")))
    return rows.join(found, same).select(*[(cut if c == text_col else F.col(f"c{n}")).alias(c) for n, c in enumerate(docs.columns)])


ORACLE_SQL = rf"""
    WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    base AS (SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM w),
    win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + {REPEAT_WINDOW - 1}], ' ')) AS c
            FROM w, unnest(range(1, len(ws) - {REPEAT_WINDOW - 2})) AS t(i)),
    rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM win, unnest(range(0, {REPEAT_WINDOW})) AS t(j) WHERE c > 1 GROUP BY 1),
    line AS (SELECT doc_id, host, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
             FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM line GROUP BY 1),
    hosts AS (SELECT host, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1),
    freq AS (SELECT host, norm FROM line JOIN hosts USING (host) GROUP BY host, norm, docs
             HAVING count(DISTINCT doc_id) > {LINE_MIN_DOCS} AND count(DISTINCT doc_id) > docs * {LINE_MAX_SHARE}::DOUBLE),
    lost AS (SELECT doc_id, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS lost FROM line JOIN freq USING (host, norm) GROUP BY 1),
    every AS (SELECT base.*, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost_words
              FROM base LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)),
    judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM every)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost_words,
           NOT base_failed AND n_lost_words <= n_words * {MAX_LOST_SHARE}::DOUBLE AS kept
    FROM judged"""
