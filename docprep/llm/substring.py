"""Substring deduplication on a De Bruijn graph of word k-mers (operator 7).

Every run of `k` words is an edge of the graph; its source coordinates are the places (row, word) where it stands. Most
edges have one, so the work is split, all of it in rows that Spark groups and joins:

1. an edge's anchor is the least hash among the `ANCHOR_WORDS`-word runs inside it. Equal edges have equal anchors and
   neighbouring edges share them, so there are some four times fewer anchors than edges; those of one document go.
2. the remaining edges are grouped by their hash and joined with their first source coordinate.
3. first coordinates that follow one another are nonbranching paths of the graph; each path's words are read once, at its
   source, in pieces of `PIECE` edges. Edges that follow one another both in a document and at their source are compacted to
   spans, joined with the pieces that they overlap and compared with the document's own words, so that the work is that of
   the spans, however long the source. Only what is equal word for word is removed.

Rows get numbers in the order of their ids, so that a place (row and word) is one long: the first of a group is a minimum that
is hashed, not sorted for, and hits, paths and spans are pairs of longs.

Keys that many rows share (a passage in a third of all documents) are combined before the exchange, and the joins put the
aggregate on the side that lets Spark split the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, named, split_join
from .wordhash import Batch, batches, hash_windows, mix

WINDOW = 13
ANCHOR_WORDS = 6
#: Passes, by hash, in which edges are grouped; the shuffle files of one are on disk at a time.
PASSES = 4
#: Edges of a piece of a path; a piece's words are those of its edges, so pieces share k - 1 words with the next.
PIECE = 512
#: Bits of a word's number in a place, which is row << WORD_BITS | word; rows are under 2 ** 32.
WORD_BITS = 31
_WORD = (1 << WORD_BITS) - 1
#: Stands for a null id: before all others, and never smaller than itself.
_NO_ID = -(1 << 63)


def _anchors(b: Batch, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and anchor of each window of k words."""
    at, _ = b.windows(k)
    runs = np.full(len(b.words), np.iinfo(np.uint64).max, dtype=np.uint64)
    h = mix(hash_windows(b.words, m))
    runs[: len(h)] = h
    n = len(runs) - (k - m)
    least = runs[: max(n, 0)].copy()
    for t in range(1, k - m + 1):
        np.minimum(least, runs[t : t + n], out=least)
    return at, least[at]


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: pa.array(values) for name, values in columns.items()})


def _integers(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(name).to_numpy(zero_copy_only=False)


def _word(b: Batch, at: np.ndarray) -> np.ndarray:
    """Within its text, the number of each word numbered `at` in a batch."""
    return (at - b.first_word[b.doc[at]]).astype(np.int64)


def anchor_runs(rows: DataFrame, k: int) -> DataFrame:
    """`id`, `th`, `run` (at << WORD_BITS | n), `a`: each run of n windows, from word `at` on, under one anchor."""

    def run(parts):
        for part in parts:
            ids, ths = _integers(part, "id"), _integers(part, "th")
            for b in batches(part.column("text").to_pylist()):
                at, anchor = _anchors(b, k, min(ANCHOR_WORDS, k))
                if len(at):
                    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1)]))
                    n = np.diff(np.append(head, len(at))).astype(np.int64)
                    row = np.asarray(b.rows)[b.doc[at[head]]]
                    yield _batch({"id": ids[row], "th": ths[row], "run": _word(b, at[head]) << WORD_BITS | n, "a": anchor[head].view(np.int64)})

    return rows.mapInArrow(run, "id long, th long, run long, a long")


def numbered(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """`id`, `th`, `row`, `low`: the keys' numbers from 0, ordered by id and th, and the least number of the same id."""
    dealt = keys.repartitionByRange("id", "th").sortWithinPartitions("id", "th").withColumn("m", F.monotonically_increasing_id())
    ordered = scratch.write("ordered", dealt).withColumn("block", F.shiftright("m", 33))
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # of a row a partition
    before = ordered.groupBy("block").count().select("block", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    rows = ordered.join(F.broadcast(before), "block").select("id", "th", (F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("row"))
    rows = scratch.write("rows", split_join(rows, rows.groupBy("id").agg(F.min("row").alias("low")), ["id"]))
    scratch.drop("ordered")
    return rows


def edges(rows: DataFrame, k: int) -> DataFrame:
    """`p`, `b`, `h1`, `h2`: the windows in the `runs` of each row, their places and the least place of a row of the same id."""

    def run(parts):
        for part in parts:
            base, low = (_integers(part, c) << WORD_BITS for c in ("row", "low"))
            runs = part.column("runs")
            upto = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(runs).to_numpy(zero_copy_only=False))])
            flat = runs.flatten().to_numpy(zero_copy_only=False)
            at, n = flat >> WORD_BITS, flat & _WORD
            for b in batches(part.column("text").to_pylist()):
                first, last = b.rows[0], b.rows[-1] + 1
                mine = slice(upto[first], upto[last])
                lo = np.repeat(b.first_word[:-1], np.diff(upto[first : last + 1])) + at[mine]
                size = len(b.words) + 1
                wanted = np.cumsum(np.bincount(lo, minlength=size) - np.bincount(lo + n[mine], minlength=size)) > 0
                word, h1 = b.windows(k)
                pick = wanted[word]
                if pick.any():
                    h2 = b.windows(k, second=True)[1][pick] >> np.uint64(32)
                    row = np.asarray(b.rows)[b.doc[word[pick]]]
                    yield _batch({"p": base[row] + _word(b, word[pick]), "b": low[row], "h1": h1[pick].view(np.int64), "h2": h2.astype(np.uint32).view(np.int32)})

    return rows.mapInArrow(run, "p long, b long, h1 long, h2 int")


def _joined(text: str | None) -> tuple[list[bytes], bytes, np.ndarray]:
    """A text's words, the words joined by one space, and where each begins there (and one past the end)."""
    words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
    begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)])
    return words, b" ".join(words), begin


def _as_text(data: bytes) -> str:
    return data.decode("utf-8", "surrogatepass")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _path_words(texts: pd.Series, at: pd.Series, n: pd.Series) -> pd.Series:
    out = []
    for text, starts, counts in zip(texts, at, n, strict=True):
        _, line, begin = _joined(text)
        out.append([_as_text(line[begin[a] : begin[a + c] - 1]) for a, c in zip(starts, counts, strict=True)])
    return pd.Series(out)


def _equal_words(words: list[bytes], line: bytes, begin: np.ndarray, at: int, source: str, k: int) -> list[tuple[int, int]]:
    """The parts (first, past the last) of the span from word `at` on whose windows are those of the source's words."""
    data = source.encode("utf-8", "surrogatepass")
    if line[begin[at] : begin[at] + len(data)] == data and (n := data.count(b" ") + 1) and begin[at + n] - 1 == begin[at] + len(data):
        return [(at, at + n)]
    same = [a == b for a, b in zip(words[at:], data.split(b" "), strict=False)]
    return [(at + i, at + i + k) for i in range(len(same) - k + 1) if all(same[i : i + k])]


def _cut(k: int):
    @F.pandas_udf("n_words long, n_removed long, kept string")
    def run(texts: pd.Series, at: pd.Series, sources: pd.Series) -> pd.DataFrame:
        out = []
        for text, starts, source in zip(texts, at, sources, strict=True):
            words, line, begin = _joined(text)
            if starts is None:
                out.append((len(words), 0, _as_text(line)))
                continue
            parts = sorted(p for a, s in zip(starts, source, strict=True) for p in _equal_words(words, line, begin, int(a), s, k))
            stay, upto, removed = [], 0, 0
            for lo, hi in parts:
                if lo > upto:
                    stay.append(line[begin[upto] : begin[lo] - 1])
                removed += max(0, hi - max(lo, upto))
                upto = max(upto, hi)
            if upto < len(words):
                stay.append(line[begin[upto] :])
            out.append((len(words), removed, _as_text(b" ".join(stay))))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return run


def _keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = named(text_col)
    return [F.coalesce(named(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text")]


def _one_a_key(rows: DataFrame) -> DataFrame:
    """Repeated rows are read once; they meet before the exchange."""
    return rows.groupBy("id", "th").agg(F.first("text").alias("text"))


def _row(place: str) -> Column:
    return F.shiftright(place, WORD_BITS)


def _at(place: str) -> Column:
    return F.col(place).bitwiseAND(F.lit(_WORD)).cast("int")


def sourced_spans(docs: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """`row`, `span`, `at`, `n` (words), `s` (the source's place), `words` (at the source): the compacted spans, not yet
    compared, a row for each piece of their path that they overlap; `span` is the first word of the whole span. And the
    numbers of rows, `id`, `th`, `row`."""
    scratch, rows = Scratch(docs.sparkSession), docs.select(*_keys(docs, id_col, text_col))
    runs = scratch.write("runs", anchor_runs(rows, k))
    shared = scratch.write("shared", runs.groupBy("a").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("a"))
    found = scratch.write("found", split_join(runs, shared, ["a"]).groupBy("id", "th").agg(F.collect_set("run").alias("runs")))
    scratch.drop("runs", "shared")
    keys = numbered(found.select("id", "th"), scratch)
    part = F.pmod("h1", F.lit(PASSES)).cast("int").alias("part")
    every = scratch.write("edges", edges(_one_a_key(rows).join(found.join(keys, ["id", "th"]), ["id", "th"]), k).select("*", part), by="part", parts=PASSES)
    scratch.drop("found")
    for p in range(PASSES):
        mine = every.where(F.col("part") == p).drop("part")
        first_of = mine.groupBy("h1", "h2").agg(F.min("p").alias("s"), F.max("b").alias("hi")).where("s < hi").drop("hi")
        seen = scratch.write(f"first{p}", first_of)
        hits = scratch.write("hits", split_join(mine, seen, ["h1", "h2"]).where("s < b").select("p", "s"))
        places = scratch.write("places", seen.select("s"))
        scratch.drop(f"first{p}")
    scratch.drop("edges")

    source = Window.partitionBy("row").orderBy("s")
    starts = F.when(F.coalesce(F.col("s") - F.lag("s").over(source), F.lit(0)) != 1, F.col("s"))
    first = places.withColumn("row", _row("s")).withColumn("head", starts)
    first = scratch.write("first", first.select("s", F.last("head", ignorenulls=True).over(source).alias("path")))
    scratch.drop("places")
    here = Window.partitionBy("row").orderBy("p")
    follows = F.coalesce((F.col("p") - F.lag("p").over(here) == 1) & (F.col("s") - F.lag("s").over(here) == 1), F.lit(False))
    marked = hits.withColumn("row", _row("p")).withColumn("head", F.when(~follows, F.col("p"))).withColumn("span", F.last("head", ignorenulls=True).over(here))
    spans = marked.groupBy("row", "span").agg(F.min("s").alias("s"), (F.count("*") + k - 1).cast("int").alias("n"))
    spans = scratch.write("spans", split_join(spans, first, ["s"]))
    scratch.drop("hits")

    paths = first.groupBy("path").agg((F.max("s") - F.col("path") + 1).alias("edges"))
    piece = F.explode(F.sequence(F.lit(0).cast("int"), F.floor((F.col("edges") - 1) / PIECE).cast("int"))).alias("piece")
    pieces = paths.select("path", "edges", piece).withColumn("n", (F.least(F.lit(PIECE), F.col("edges") - F.col("piece") * PIECE) + k - 1).cast("int"))
    pieces = pieces.withColumn("begin", _at("path") + F.col("piece") * PIECE)
    wanted = pieces.groupBy(_row("path").alias("row")).agg(F.collect_list(F.struct("path", "piece", "begin", "n")).alias("p"))
    read = _one_a_key(rows).join(wanted.join(keys, "row"), ["id", "th"]).select("p", _path_words(F.col("text"), F.col("p.begin"), F.col("p.n")).alias("words"))
    read = read.select(F.explode(F.arrays_zip("p.path", "p.piece", "words")).alias("z")).select("z.path", "z.piece", "z.words")

    # edges of the span, counted from the start of the path, and those of them in each piece
    lo, hi = F.col("s") - F.col("path"), F.col("s") - F.col("path") + F.col("n") - k
    mine = spans.withColumn("piece", F.explode(F.sequence(F.floor(lo / PIECE).cast("int"), F.floor(hi / PIECE).cast("int"))))
    from_, upto = F.greatest(lo, F.col("piece") * PIECE), F.least(hi, F.col("piece") * PIECE + PIECE - 1)
    mine = mine.select("row", _at("span").alias("span"), (_at("span") + from_ - lo).cast("int").alias("at"), (upto - from_ + k).cast("int").alias("n"), (F.col("s") + from_ - lo).alias("s"), "path", "piece")
    # a word holds no space, so a piece's words split at spaces
    taken = F.array_join(F.slice(F.split("words", " "), (F.col("s") - F.col("path") - F.col("piece") * PIECE + 1).cast("int"), F.col("n")), " ")
    return scratch.write("sourced", split_join(mine, read, ["path", "piece"]).select("row", "span", "at", "n", "s", taken.alias("words"))), keys.select("id", "th", "row")


def _judged(docs: DataFrame, id_col: str, text_col: str, k: int, carry: bool) -> DataFrame:
    """`id`, `cut` (n_words, n_removed, kept) and, if `carry`, the columns of docs as c0, c1, .. of every row."""
    found, keys = sourced_spans(docs, id_col, text_col, k)
    spans = found.groupBy("row").agg(F.collect_list(F.struct("at", "words")).alias("s")).join(keys, "row").drop("row")
    rows = docs.select(*_keys(docs, id_col, text_col), *[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if carry])
    # not deterministic where rows are carried, or a filter of them and their columns would each cut every text
    cut = _cut(k).asNondeterministic() if carry else _cut(k)
    return split_join(rows, spans, ["id", "th"], "left").withColumn("cut", cut(F.col("text"), F.col("s.at"), F.col("s.words")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW) -> DataFrame:
    """`<id>`, `n_words`, `n_removed`, `kept` (remaining words joined by one space) for every row.

    A word goes if a window of k words around it also starts in a document with a smaller id. Null text has no words.
    Rows that share an id, repeated rows among them, are one document for that rule: neither is smaller. Null ids
    come before all others. Texts under k words stay whole; long texts are read whole. Other columns, whatever their
    names, are not read.
    """
    out = _judged(docs, id_col, text_col, k, carry=False)
    return out.select(F.nullif("id", F.lit(_NO_ID)).alias(id_col), "cut.n_words", "cut.n_removed", "cut.kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW) -> DataFrame:
    """`docs` with the kept words as text. A text that loses nothing keeps its white space; a row that loses all its
    words goes; rows and other columns, whatever their names, stay as they are otherwise."""
    out = _judged(docs, id_col, text_col, k, carry=True).where("cut.n_removed = 0 OR cut.n_removed < cut.n_words")
    text = F.when(F.col("cut.n_removed") > 0, F.col("cut.kept")).otherwise(F.col("text"))
    return out.select(*[(text if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW) -> DataFrame:
    """Compacted spans: `<id>`, `first_word`, `n_words`, `source_id`, `source_word`, one row for each maximal run of
    repeated windows that follow one another both in the document and at their first source, equal word for word."""

    @F.pandas_udf("array<boolean>")
    def equal(texts: pd.Series, at: pd.Series, sources: pd.Series) -> pd.Series:
        out = []
        for text, starts, source in zip(texts, at, sources, strict=True):
            words, line, begin = _joined(text)
            out.append([_equal_words(words, line, begin, int(a), s, k) == [(a, a + s.count(" ") + 1)] for a, s in zip(starts, source, strict=True)])
        return pd.Series(out)

    found, keys = sourced_spans(docs, id_col, text_col, k)
    spans = found.groupBy("row").agg(F.collect_list(F.struct("span", "at", "n", "s", "words")).alias("spans")).join(keys, "row").drop("row")
    rows = _one_a_key(docs.select(*_keys(docs, id_col, text_col))).join(spans, ["id", "th"])
    each = rows.select("id", "th", F.explode(F.arrays_zip("spans", equal(F.col("text"), F.col("spans.at"), F.col("spans.words")).alias("equal"))).alias("z")).select("id", "th", "z.spans.*", "z.equal")
    whole = each.groupBy("id", "th", "span", _row("s").alias("row")).agg(F.min("s").alias("s"), (F.sum(F.col("n") - k + 1) + k - 1).cast("int").alias("n"), F.bool_and("equal").alias("equal")).where("equal")
    whole = whole.join(keys.select("row", F.col("id").alias("sid")), "row")
    ids = lambda c: F.nullif(F.col(c), F.lit(_NO_ID))
    return whole.select(ids("id").alias(id_col), F.col("span").alias("first_word"), F.col("n").alias("n_words"), ids("sid").alias("source_id"), _at("s").alias("source_word"))


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW) -> DataFrame:
    done = deduplicate(docs, id_col, text_col, k)
    return done.select(named(id_col), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
