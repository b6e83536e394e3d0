"""Byte-level BPE encoding and decoding by a public rank file (operator 3).

Long texts are cut into chunks that overlap and are dealt out one by one. Each chunk is pre-tokenised from its own start.
The pattern looks only forward, so two scans that share a boundary agree from there on: the first boundary that a chunk's
scan shares with the scan of the chunk before is a true one. Pieces between such boundaries are encoded in parallel.
Where two scans do not meet within an overlap (an unbroken run of thousands of characters), the chunk is joined to the
one before it and scanned again with it; only a text whose joined chunks do not meet either is one piece.

The scan for boundaries uses the package `regex`, as tiktoken does not tell boundaries. The two hold different versions of
Unicode, so characters that tiktoken classes otherwise are replaced by one of tiktoken's class before the scan.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import durable, with_row_key

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 11
#: A boundary this near to a cut may be an effect of the cut (a contraction is up to three characters).
CUT_MARGIN = 8
_SLICE_TOKENS = 1 << 17


class Vocabulary:
    """The rank file's bytes, sent to the executors once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            self.file = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern


def _ranks(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}


@functools.lru_cache(maxsize=2)
def _encoding(file: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(file), special_tokens={})


@functools.lru_cache(maxsize=2)
def _tokens(file: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, their offsets and lengths, by id."""
    ranks = _ranks(file)
    length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        length[i] = len(token)
    by_id = sorted(ranks.items(), key=lambda x: x[1])
    return np.frombuffer(b"".join(t for t, _ in by_id), dtype=np.uint8), np.cumsum(length) - length, length


def encode_text(text: Column, vocabulary: Vocabulary) -> Column:
    """Ids of one piece of text; none for null."""
    file, pattern = vocabulary.file, vocabulary.pattern

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def run(texts: pa.Array) -> pa.Array:
        encode, ids, ends = _encoding(file.value, pattern).encode_to_numpy, bytearray(), [0]
        for text in texts:  # one at a time, into one buffer
            ids += encode(text.as_py() or "", disallowed_special=()).astype(np.int32).tobytes()
            ends.append(len(ids) // 4)
        values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(ids)])
        return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), values)

    return run(text)


def decode_ids(ids: Column, vocabulary: Vocabulary) -> Column:
    """The tokens' raw bytes, one after the other; empty for null."""
    file = vocabulary.file

    @F.arrow_udf(T.BinaryType())
    def run(lists: pa.Array) -> pa.Array:
        data, start, length = _tokens(file.value)
        rows = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        values, out, ends = lists.flatten().to_numpy(zero_copy_only=False), bytearray(), np.zeros(len(lists) + 1, dtype=np.int32)
        for lo in range(0, len(values), _SLICE_TOKENS):
            part = values[lo : lo + _SLICE_TOKENS]
            n = length[part]
            upto = np.cumsum(n)
            here = np.flatnonzero((rows > lo) & (rows <= lo + len(part)))
            ends[here + 1] = len(out) + upto[rows[here] - lo - 1]
            out += data[np.arange(upto[-1]) + np.repeat(start[part] - (upto - n), n)].tobytes()
        return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(out)])

    return run(ids)


@functools.lru_cache(maxsize=1)
def _reclassed() -> dict[int, str]:
    """Characters that `regex` puts in another class of letters, numbers, white space and others than tiktoken does, each
    with one that both put in tiktoken's class. The stand-ins take part in no contraction."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    one_byte = {bytes([i]): i for i in range(256)}

    def theirs(pattern: str) -> str:
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=one_byte, special_tokens={})
        return found.decode_bytes(found.encode_ordinary(every)).decode("utf-8")

    out = {}
    for pattern, stand_in in ((r"\p{L}", "\u00e9"), (r"\p{N}", "1"), (r"\s", "\u2003"), (r"[^\s\p{L}\p{N}]", "!")):
        out |= {ord(c): stand_in for c in set(theirs(pattern)).difference(regex.findall(pattern, every))}
    return out


def _boundaries(chunk: Column, more: Column, body: Column, pattern: str, overlap: int, classes: Broadcast) -> Column:
    """`head`: starts of pre-tokens, but for those after white space, within the first `overlap` characters; `tail`: those
    within the `overlap` characters after the first `body` ones, counted from there."""
    ints = T.ArrayType(T.IntegerType(), False)

    @F.arrow_udf(T.StructType([T.StructField("head", ints), T.StructField("tail", ints)]))
    def run(chunks: pa.Array, followed: pa.Array, bodies: pa.Array) -> pa.Array:
        scan, reclassed = regex.compile(pattern).finditer, classes.value
        heads, tails = [], []
        for text, more_follows, size in zip(chunks.to_pylist(), followed.to_pylist(), bodies.to_pylist(), strict=True):
            text = text if text.isascii() else text.translate(reclassed)
            last = len(text) - CUT_MARGIN if more_follows else len(text)
            at = np.fromiter((m.start() for m in scan(text)), dtype=np.int32)
            at = at[at <= last]
            # a run of white space is split by what follows it, so no piece may end in one
            at = at[[s == 0 or not text[s - 1].isspace() for s in at.tolist()]]
            heads.append(at[at < overlap])
            tails.append(at[at >= size] - size)
        return pa.StructArray.from_arrays([pa.array(heads, type=pa.list_(pa.int32())), pa.array(tails, type=pa.list_(pa.int32()))], names=["head", "tail"])

    return run(chunk, more, body)


def _of_text():
    return Window.partitionBy("__id", "__th")


def _met(chunks: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """`__id`, `__th`, `k`, `body`, `begin` (the first boundary shared with the chunk before; null without one)."""
    classes = chunks.sparkSession.sparkContext.broadcast(_reclassed())  # some ten thousand entries, whatever the texts
    seen = chunks.select("__id", "__th", "k", "body", _boundaries(F.col("chunk"), F.col("more"), F.col("body"), pattern, overlap, classes).alias("b"))
    meets = F.array_min(F.array_intersect("b.head", F.lag("b.tail").over(_of_text().orderBy("k"))))
    return durable(seen.select("__id", "__th", "k", "body", F.when(F.col("k") == 0, 0).otherwise(meets).alias("begin")))


def _joined(chunks: DataFrame, begins: DataFrame, group: Column) -> DataFrame:
    """Chunks with those of one group joined; k is that of the first."""
    placed = begins.select(F.col("__id").alias("i"), F.col("__th").alias("t"), F.col("k").alias("n"), group.alias("g"))
    same = F.col("__id").eqNullSafe(F.col("i")) & (F.col("__th") == F.col("t")) & (F.col("k") == F.col("n"))
    parts = F.array_sort(F.collect_list(F.struct("k", "body", "more", "chunk")))
    rows = chunks.join(placed, same).groupBy("__id", "__th", "g").agg(parts.alias("p"), F.max("copies").alias("copies"))
    last = F.element_at("p", -1)
    firsts = F.transform(F.slice("p", 1, F.size("p") - 1), lambda x: x["chunk"].substr(F.lit(1), x["body"]))
    body = F.aggregate("p", F.lit(0), lambda n, x: n + x["body"])
    return rows.select("__id", "__th", F.get("p", F.lit(0))["k"].alias("k"), last["more"].alias("more"), body.alias("body"), F.concat(F.array_join(firsts, ""), last["chunk"]).alias("chunk"), "copies")


def _cut(chunks: DataFrame, begins: DataFrame) -> DataFrame:
    """The pieces of texts whose chunks all meet: from the boundary shared with the chunk before to that with the next."""
    placed = begins.select(F.col("__id").alias("i"), F.col("__th").alias("t"), F.col("k").alias("n"), "begin", F.lead("begin").over(_of_text().orderBy("k")).alias("end"))
    same = F.col("__id").eqNullSafe(F.col("i")) & (F.col("__th") == F.col("t")) & (F.col("k") == F.col("n"))
    length = F.when(F.col("end").isNotNull(), F.col("body") + F.col("end") - F.col("begin")).otherwise(F.char_length("chunk"))
    return chunks.join(placed, same).select("__id", "__th", "k", F.substring("chunk", F.col("begin") + 1, length).alias("piece"), "copies")


def pieces(rows: DataFrame, pattern: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """`__id`, `__th`, `k`, `piece`, `copies`: the pieces of long texts, in order of k; repeated rows are counted."""
    last = F.ceil(F.char_length("__text") / size).cast("int") - 1
    cut = rows.select("__id", "__th", "__text", F.explode(F.sequence(F.lit(0), last)).alias("k"), last.alias("last"))
    cut = cut.select("__id", "__th", "k", (F.col("k") < F.col("last")).alias("more"), F.lit(size).alias("body"), F.substring("__text", F.col("k") * size + 1, F.lit(size + overlap)).alias("chunk"))
    chunks = cut.groupBy("__id", "__th", "k", "more", "body").agg(F.first("chunk").alias("chunk"), F.count("*").alias("copies"))
    out = None
    for joining in (True, False):
        begins = _met(chunks, pattern, overlap).withColumn("whole", F.bool_and(F.col("begin").isNotNull()).over(_of_text()))
        done, left = begins.where("whole"), begins.where("not whole")
        found = _cut(chunks, done)
        out = found if out is None else out.unionByName(found)
        if left.isEmpty():
            return out
        met = F.count("begin").over(_of_text().orderBy("k"))  # up to and with the chunk
        chunks = _joined(chunks, left, met if joining else F.lit(0))
    return out.unionByName(chunks.select("__id", "__th", "k", F.col("chunk").alias("piece"), "copies"))


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """`__id`, `ids` for every row, as encoding the whole text would give; null is empty. Other columns are not read."""
    rows = with_row_key(docs, id_col, text_col)
    short = rows.where(F.char_length("__text") <= size).select("__id", encode_text(F.col("__text"), vocabulary).alias("ids"))
    cut = pieces(rows.where(F.char_length("__text") > size), vocabulary.pattern, size, overlap)
    apart = cut.select("__id", "__th", "k", "copies", encode_text(F.col("piece"), vocabulary).alias("ids"))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]))
    whole = apart.groupBy("__id", "__th").agg(ordered.alias("ids"), F.max("copies").cast("int").alias("copies"))
    return short.unionByName(whole.select("__id", "ids", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("__id", "ids"))


def round_trip_digest(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    done = encode(docs, vocabulary, id_col, text_col, **options)
    return done.select(
        F.col("__id").alias(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decode_ids(F.col("ids"), vocabulary), 256).alias("decoded_sha256"),
    )
