"""Near copies by min-max hashing (operator 11, and with other settings the pipeline's stage).

Each permutation of the shingles gives two values of a signature, its least and its greatest image, so that 160 values cost
80 evaluations; the share of equal values is an unbiased estimate of the Jaccard similarity. Least values of five
permutations are one band and their greatest values another, and documents that share a band are candidates. A pair at the
limit shares one of 32 bands with a probability of 1 - 7e-9 at similarity 0.85 and of 1 - 3e-6 at 0.8.

Work grows with the members of a group, not with their pairs:

1. Equal sets are one entry, a class. Candidates carry names and one byte of each signature value, which rules out pairs
   whose agreement lies more than five standard deviations under the limit. What is left of a band's bucket is not listed
   as pairs, only connected: all members with the least one, then, where members stay apart, within pairs of blocks.
2. The components of that are clusters, the second part being searched among the roots of the first; a pair that is
   similar enough lies in one cluster. Each text is sent to its cluster once, or in a cluster of more than BLOCK_BYTES once
   for each block. There members that are not connected yet are compared on their whole sets, and what true links connect
   comes out as stars around the least name, which are the components already unless a cluster has several blocks.
3. The components of the true links are the result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, named, split_join
from .components import connected_components
from .wordhash import batches, hash_windows, mix

SHINGLE_WORDS = 3
PERCENT = 85
BAND_ROWS = 5
PERMUTATIONS = 80
BANDS = 2 * PERMUTATIONS // BAND_ROWS
#: Members of a bucket from which it is searched in blocks, and members of such a block.
DENSE_BUCKET = 32
BLOCK = 2048
#: Text of a cluster, or of one of its blocks, that one task compares.
BLOCK_BYTES = 8 << 20
#: Candidates of one member from which their overlaps are counted together.
MANY = 64
_SLICE = 1 << 11
_rng = np.random.default_rng(20241128)
_FACTOR = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERM = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(texts, shingle: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Sorted hashes of each text's distinct shingles, ASCII letters lower-cased; a shorter text is one shingle, no words none."""
    for b in batches(t.encode("utf-8", "surrogatepass").lower() if isinstance(t, str) else None for t in texts):
        at, hashes = b.windows(shingle)
        cut = np.searchsorted(b.doc[at], np.arange(len(b.rows) + 1))
        for t in range(len(b.rows)):
            lo, hi = b.first_word[t], b.first_word[t + 1]
            if 0 < hi - lo < shingle:
                yield hash_windows(b.words[lo:hi], int(hi - lo)) + np.uint64(hi - lo)
            else:
                yield np.unique(hashes[cut[t] : cut[t + 1]])


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least, then the greatest image of the set under each permutation, mixed."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(PERMUTATIONS, dtype=np.uint64)
    for lo in range(0, len(shingles), _SLICE):
        images = shingles[lo : lo + _SLICE, None] * _FACTOR + _TERM
        np.minimum(low, images.min(axis=0), out=low)
        np.maximum(high, images.max(axis=0), out=high)
    return mix(np.concatenate([low, high]))


def bands_of(values: np.ndarray) -> np.ndarray:
    """A hash of each band; least and greatest values never share a band."""
    rows, out = values.reshape(BANDS, BAND_ROWS), np.arange(BANDS, dtype=np.uint64)
    for t in range(BAND_ROWS):
        out = mix(out + rows[:, t])
    return out.view(np.int64)


def _sketch(shingle: int):
    @F.pandas_udf("name long, n long, bands array<long>, bytes binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for s in shingle_sets(texts, shingle):
            values = signature(s)
            name = mix(mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0]
            out.append((int(name), len(s), bands_of(values), values.astype(np.uint8).tobytes()))
        return pd.DataFrame(out, columns=["name", "n", "bands", "bytes"])

    return run


def least_agreement(percent: int) -> int:
    """Equal values, of all, under which a pair is ruled out."""
    n, share = 2 * PERMUTATIONS, percent / 100
    return int(np.ceil(n * (share - 5 * (share * (1 - share) / n) ** 0.5)))


def _rows(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), -1)


def _likely(percent: int):
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((_rows(a) == _rows(b)).sum(axis=1) >= least_agreement(percent) if len(a) else np.zeros(0, dtype=bool))

    return run


def _with_sketches(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs `a`, `b`, with their further columns, that sizes and sketches do not rule out."""
    left, right = (sketches.select(F.col("name").alias(c), F.col("n").alias(f"n{c}"), F.col("bytes").alias(f"bytes{c}")) for c in "ab")
    both = split_join(split_join(pairs, right, ["b"]), left, ["a"]).where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return both.where(_likely(percent)(F.col("bytesa"), F.col("bytesb"))).select(*pairs.columns)


def _joined_in_blocks(many: DataFrame, percent: int) -> DataFrame:
    """`a`, `b`: for the members (`slot`, `m`, `name`, `root`, `n`, `bytes`) of large buckets the roots of a forest over the
    pairs that are not ruled out, by pairs of blocks."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = many.withColumn("mine", F.pmod(F.xxhash64("name"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    own = ("root", "n", "bytes")
    low = dealt.where("mine <= other").select("slot", "mine", "other", *own)
    high = dealt.where("other <= mine").select(F.col("slot").alias("s"), F.col("other").alias("o"), F.col("mine").alias("i"), *[F.col(c).alias(c) for c in own])

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            roots = np.concatenate([x.root, y.root])
            label = np.unique(roots, return_inverse=True)[1]
            bytes_y, n_y, right = _rows(y.bytes), y.n.to_numpy(), len(x)
            for i, (row, n) in enumerate(zip(_rows(x.bytes), x.n, strict=True)):
                near = np.flatnonzero((label[right:] != label[i]) & (np.minimum(n_y, n) * 100 >= np.maximum(n_y, n) * percent))
                near = near[(bytes_y[near] == row).sum(axis=1) >= least_agreement(percent)]
                groups, first = np.unique(label[right + near], return_index=True)
                out += [(int(roots[i]), int(roots[right + j])) for j in near[first]]
                label[np.isin(label, groups)] = label[i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return low.groupBy("slot", "mine", "other").cogroup(high.groupBy("s", "o", "i")).applyInPandas(run, "a long, b long")


class _Side:
    """Members of a cluster in one task: names, sketches and whole sets."""

    def __init__(self, names, sketches, texts, shingle: int):
        self.names, self.bytes, self.sets = list(names), _rows(pd.Series(sketches)), list(shingle_sets(texts, shingle))
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        self._index = None

    def overlaps(self, shingles: np.ndarray) -> np.ndarray:
        """How many of the shingles each member has."""
        if self._index is None:
            values, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.sizes)
            order = np.argsort(values, kind="stable")
            self._index = values[order], owner[order]
        values, owner = self._index
        lo, hi = np.searchsorted(values, shingles, "left"), np.searchsorted(values, shingles, "right")
        size = hi - lo
        at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        return np.bincount(owner[at], minlength=len(self.sets))


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def _stars(names, label: np.ndarray) -> list[tuple[int, int]]:
    """The least name of each group of one label with each other name of it."""
    names = np.array(names, dtype=np.int64)
    order = np.lexsort((names, label))
    first = np.flatnonzero(np.append(True, np.diff(label[order]) != 0)[: len(order)])
    least = np.repeat(names[order][first], np.diff(np.append(first, len(order))))
    return [(int(a), int(b)) for a, b in zip(least, names[order], strict=True) if a != b]


def linked(left: _Side, right: _Side, percent: int) -> list[tuple[int, int]]:
    """Stars of what the true links between two sides connect, or those within one if both are the same."""
    same = left is right
    label = np.arange(len(left.names)) if same else np.arange(len(left.names) + len(right.names))
    there = label if same else label[len(left.names) :]  # a view, so that it changes with the labels
    for i, mine in enumerate(left.sets):
        n = left.sizes[i]
        near = np.flatnonzero((there != label[i]) & (np.minimum(right.sizes, n) * 100 >= np.maximum(right.sizes, n) * percent))
        near = near[near > i] if same else near
        agree = (right.bytes[near] == left.bytes[i]).sum(axis=1)
        likely = agree >= least_agreement(percent)
        near = near[likely][np.argsort(-agree[likely], kind="stable")]
        tried, counts = 0, None
        while len(near):
            j = near[0]
            if counts is None and tried >= MANY:
                counts = right.overlaps(mine)
            both = int(counts[j]) if counts is not None else _overlap(mine, right.sets[j])
            tried += 1
            if both * 100 >= (int(n) + int(right.sizes[j]) - both) * percent:
                label[label == there[j]] = label[i]
                near = near[there[near] != label[i]]
            else:
                near = near[1:]
    return _stars(left.names if same else left.names + right.names, label)


def _verified(members: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """`a`, `b`: stars of what true links connect in each `cluster` of members (`name`, `size`, `bytes`, `text`)."""
    total = members.groupBy("cluster").agg(F.sum("size").alias("total"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK_BYTES)).cast("int")
    sized = scratch.write("members", split_join(members, total, ["cluster"]).withColumn("blocks", blocks).select("cluster", "blocks", "name", "bytes", "text"))

    def small(parts):
        rows = (row for p in parts for row in zip(p["cluster"], p["name"], p["bytes"], p["text"], strict=True))
        for _, group in itertools.groupby(rows, key=lambda row: row[0]):
            _, names, sketches, texts = zip(*group, strict=True)
            side = _Side(names, sketches, texts, shingle)
            yield pd.DataFrame(linked(side, side, percent), columns=["a", "b"]).astype("int64")

    whole = sized.where("blocks = 1").select("cluster", "name", "bytes", "text").repartition("cluster").sortWithinPartitions("cluster")
    links = scratch.write("links", whole.mapInPandas(small, "a long, b long"))
    large = sized.where("blocks > 1")
    if large.isEmpty():
        return links
    dealt = large.withColumn("mine", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = ("name", "bytes", "text")
    low = dealt.where("mine <= other").select("cluster", "mine", "other", *own)
    high = dealt.where("other < mine").select(F.col("cluster").alias("c"), F.col("other").alias("o"), F.col("mine").alias("i"), *[F.col(c).alias(c) for c in own])

    def run(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and (len(y) or key[1] == key[2]):
            left = _Side(x.name, x.bytes, x.text, shingle)
            out = linked(left, left if key[1] == key[2] else _Side(y.name, y.bytes, y.text, shingle), percent)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return scratch.write("links", low.groupBy("cluster", "mine", "other").cogroup(high.groupBy("c", "o", "i")).applyInPandas(run, "a long, b long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """`id`, `th` (hash of the text), `n` (size of the set), `component_id` (the smallest id reachable over pairs of at
    least that similarity) for every row.

    Null and wordless texts have no shingles; they are equal to each other and to nothing else. Rows with a null id take
    part; a component of such rows alone has a null component_id. Repeated rows and equal sets are one entry; rows of one
    id are apart by their text. Long texts are read whole. Other columns, whatever their names, are not read. An empty
    table gives an empty table. Sets are told apart by 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    marked = scratch.write("marked", rows.select("id", th.alias("th"), size.alias("size"), _sketch(shingle)(F.col("text")).alias("s")).select("id", "th", "size", "s.*"))
    one = marked.groupBy("name").agg(F.min("id").alias("first"), F.min(F.struct("id", "th", "size")).alias("row"), F.min("n").alias("n"), F.min("bands").alias("bands"), F.min("bytes").alias("bytes"))
    classes = scratch.write("classes", one)
    sketches = classes.select("name", "n", "bytes")

    slots = classes.where("n > 0").select("name", F.explode("bands").alias("slot"))
    heads = slots.groupBy("slot").agg(F.min("name").alias("head"), F.count("*").alias("m")).where("m > 1")
    slots = scratch.write("slots", split_join(slots, heads, ["slot"]))
    stars = slots.where("name <> head").select(F.col("head").alias("a"), F.col("name").alias("b")).distinct()
    near = scratch.write("near", _with_sketches(stars, sketches, percent))
    roots = connected_components(near).select(F.col("node").alias("name"), "root")
    placed = slots.select("slot", "m", "name").join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    mixed = placed.groupBy("slot").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("slot")
    placed = scratch.write("placed", split_join(placed, mixed, ["slot"]))
    scratch.drop("slots")
    left, right = (placed.where(F.col("m") <= DENSE_BUCKET).select("slot", F.col("name").alias(c), F.col("root").alias(f"root{c}")) for c in "ab")
    few = left.join(right, "slot").where("a < b AND roota <> rootb").select("a", "b", "roota", "rootb").distinct()
    joins = scratch.write("joins", _with_sketches(few, sketches, percent).select(F.col("roota").alias("a"), F.col("rootb").alias("b")))
    many = placed.where(F.col("m") > DENSE_BUCKET)
    if not many.isEmpty():
        joins = scratch.write("joins", _joined_in_blocks(many.join(sketches, "name"), percent))
    scratch.drop("placed")

    tops = connected_components(joins).select(F.col("node").alias("root"), F.col("root").alias("top"))
    clusters = roots.join(tops, "root", "left").select("name", F.coalesce("top", "root").alias("cluster"))
    single = tops.select(F.col("root").alias("name"), F.col("top").alias("cluster")).join(roots, "name", "left_anti")
    clusters = clusters.unionByName(single)
    keys = classes.join(clusters, "name").select("name", "cluster", "bytes", F.col("row.size").alias("size"), F.col("row.id").alias("key"), F.col("row.th").alias("key_th"))
    found = rows.withColumn("th", th).join(keys, F.col("id").eqNullSafe(F.col("key")) & (F.col("th") == F.col("key_th")))
    links = _verified(found.select("cluster", "name", "size", "bytes", "text").dropDuplicates(["name"]), shingle, percent, scratch)
    scratch.drop("near", "joins", "members")

    true = connected_components(links).select(F.col("node").alias("name"), "root")
    rooted = classes.select("name", "first").join(true, "name", "left").withColumn("root", F.coalesce("root", "name"))
    labelled = split_join(rooted, rooted.groupBy("root").agg(F.min("first").alias("component_id")), ["root"]).select("name", "component_id")
    return split_join(marked.select("id", "th", "n", "name"), labelled, ["name"]).select("id", "th", "n", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`<id>`, `n_shingles`, `component_id`, `kept` (the row has the smallest id of its component) for every row.

    As `near_copies`, but a row without a word is linked with nothing: it is its own component and stays.
    """
    found = near_copies(docs, id_col, text_col, **options)
    root = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"), F.col("id").eqNullSafe(root).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component; rows with a null id stay, and so do all columns. Rows
    without a word are equal to each other here."""
    found = near_copies(docs, id_col, text_col, **options)
    later = found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct()
    same = (named(id_col) == F.col("__id")) & (F.xxhash64(F.coalesce(named(text_col), F.lit(""))) == F.col("__th"))
    return docs.join(later, same, "left_anti")


#: From the definition: all pairs of sets that share a shingle of their rarest ones, counted whole.
ORACLE_SQL = rf"""
    WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {SHINGLE_WORDS - 1}], ' ') AS sh FROM w, unnest(range(1, greatest(len(ws) - {SHINGLE_WORDS - 1}, 1) + 1)) AS t(i) WHERE len(ws) > 0),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    ranked AS MATERIALIZED (SELECT doc_id, sh, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, sh) AS r FROM s JOIN (SELECT sh, count(*) AS df FROM s GROUP BY 1) USING (sh) JOIN n USING (doc_id)),
    head AS MATERIALIZED (SELECT doc_id, sh, n FROM ranked WHERE r <= n - ceil(n * {PERCENT / 100}::DOUBLE) + 1),
    pair AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM head a JOIN head b USING (sh) WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)),
    link AS MATERIALIZED (SELECT a, b FROM pair JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.sh = x.sh GROUP BY a, b, na, nb HAVING 100 * count(*) >= {PERCENT} * (na + nb - count(*))),
    edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (SELECT doc_id, doc_id AS seen FROM w UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.seen)
    SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(seen) AS component_id, w.doc_id = min(seen) AS kept
    FROM w JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id"""
