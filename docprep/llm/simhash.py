"""SimHash near-duplicates by multi-index hashing (operator 8).

64-bit fingerprints are cut into segments. Two fingerprints within `max_distance` bits agree in one segment up to
max_distance // segments bits, so each fingerprint looks up the small Hamming ball around each of its segments in the
table of that segment and the matches are verified on all 64 bits. Equal fingerprints are one entry. A table slot that
holds many fingerprints (a large group of near copies) is searched in blocks that return a spanning forest of their
links, so a group of g fingerprints gives in the order of g rows, not g squared, and no connection is lost.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, named, split_join
from .components import connected_components

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
HASH_SEED = 42
#: Fingerprints of a slot from which it is searched in blocks, and fingerprints of a block.
DENSE_SLOT = 256
BLOCK = 1024
#: Distinct fingerprints from which two segments of 32 bits with balls of radius 2 replace three of about 21 with radius 1.
MANY = 1 << 25
_SLICE = 1 << 16


def fingerprint_of(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint; zero without words; the whole sequence is one shingle if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) < shingle:
        begin, end = [0], [len(line)]
    else:
        begin, end = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, dtype=np.int64), len(begin)
    for lo in range(0, n, _SLICE):
        h = np.array([digest(line[s:e], HASH_SEED) for s, e in zip(begin[lo : lo + _SLICE], end[lo : lo + _SLICE], strict=True)], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return run(text)


def segment_plan(n: int, max_distance: int = MAX_DISTANCE) -> list[tuple[int, int, list[int]]]:
    """(shift, width, masks of the Hamming ball) of each segment; both plans find every pair."""
    widths = [32, 32] if n >= MANY else [22, 21, 21]
    radius, plan, shift = max_distance // len(widths), [], 0
    for width in widths:
        masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(width), r)]
        plan.append((shift, width, masks))
        shift += width
    return plan


def _slot(fp: Column, number: int, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(number << 33)


def _ball(slot: Column, masks: list[int]) -> Column:
    return F.transform(F.lit(masks), lambda m: slot.bitwiseXOR(m.cast("long")))


def _forest(left: np.ndarray, right: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Links between two blocks of fingerprints that connect what all their links connect."""
    label = np.arange(len(left) + len(right))
    place = {v: i for i, v in enumerate(left.tolist())}
    for j, v in enumerate(right.tolist()):  # a value on both sides is one node
        if v in place:
            label[len(left) + j] = place[v]
    found = []
    for i, v in enumerate(left):
        near = np.flatnonzero(np.bitwise_count(right ^ v) <= max_distance)
        groups, first = np.unique(label[len(left) + near], return_index=True)
        other = groups != label[i]
        if other.any():
            found += [(int(v), int(right[near[f]])) for f in first[other]]
            label[np.isin(label, groups)] = label[i]
    return found


def _dense_links(slots: DataFrame, probes: DataFrame, dense: DataFrame, max_distance: int) -> DataFrame:
    sized = (
        probes.join(dense, "slot", "left_semi").groupBy("slot").count().withColumnRenamed("count", "np")
        .join(dense, "slot").select("slot", F.ceil(F.col("nt") / BLOCK).cast("int").alias("tb"), F.ceil(F.col("np") / BLOCK).cast("int").alias("pb"))
    )
    pick = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    table = slots.join(sized, "slot").select("slot", F.col("fp").alias("right"), pick("tb").alias("t"), span("pb").alias("p"))
    search = probes.join(sized, "slot").select(F.col("slot").alias("s"), F.col("fp").alias("left"), pick("pb").alias("u"), span("tb").alias("v"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left, right = a.left.unique().astype("int64").view("uint64"), b.right.unique().astype("int64").view("uint64")
        links = np.array(_forest(left, right, max_distance), dtype="uint64").reshape(-1, 2).view("int64")
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    return search.groupBy("s", "v", "u").cogroup(table.groupBy("slot", "t", "p")).applyInPandas(run, "a long, b long")


def links(fingerprints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """`a`, `b`: links between distinct values of `fp`, enough to connect all that are linked; each is a true link."""
    n = fingerprints.count()
    plan = segment_plan(n, max_distance)
    fp = F.col("fp")
    slots = fingerprints.select("fp", F.explode(F.array(*[_slot(fp, i, s, w) for i, (s, w, _) in enumerate(plan)])).alias("slot"))
    balls = [_ball(_slot(fp, i, s, w), masks) for i, (s, w, masks) in enumerate(plan)]
    probes = fingerprints.select("fp", F.explode(F.concat(*balls)).alias("slot"))
    dense = durable(slots.groupBy("slot").count().where(F.col("count") > DENSE_SLOT).withColumnRenamed("count", "nt"))
    some = not dense.isEmpty()
    thin_slots, thin_probes = (x.join(dense, "slot", "left_anti") if some else x for x in (slots, probes))
    right = thin_slots.select("slot", F.col("fp").alias("b"))
    near = F.bit_count(fp.bitwiseXOR(F.col("b"))) <= max_distance
    found = thin_probes.join(right, (thin_probes.slot == right.slot) & (fp < F.col("b")) & near).select(fp.alias("a"), "b")
    return found.unionByName(_dense_links(slots, probes, dense, max_distance)) if some else found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """`<id>`, `fingerprint` (16 hex digits), `component_id` (smallest id reachable over links) for every row.

    Null or wordless texts have fingerprint zero and are linked like any other. Rows with a null id take part; a
    component of such rows alone has a null component_id. Repeated rows and ids give a row each. Other columns are not read.
    """
    marked = durable(docs.select(named(id_col).alias("id"), fingerprint(named(text_col), shingle).alias("fp")))
    classes = durable(marked.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(links(classes.select("fp"), max_distance))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    labelled = split_join(rooted, rooted.groupBy("root").agg(F.min("first").alias("component_id")), ["root"]).select("fp", "component_id")
    return marked.join(labelled, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component; rows with a null id stay."""
    found = near_duplicates(docs.select(named(id_col).alias("__id"), named(text_col).alias("__text")), "__id", "__text", **options)
    later = found.where(F.col("__id") != F.col("component_id")).select("__id").distinct()
    return docs.join(later, named(id_col) == F.col("__id"), "left_anti")
