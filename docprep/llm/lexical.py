"""Ranked lexical search (operator 12): best-first intervals of documents, bounded by range maxima over posting lists.

The documents are read once into a table of postings of the query terms. A batch of its rows is a shard: documents by id,
for each term a posting list with the term's score in each document, and over the lists a sparse table that gives the place
of the greatest score in any range with two lookups. A query starts with the interval of all documents of the shard. The
bound of an interval is the sum of its lists' range maxima. The interval with the greatest bound is split at the document
that holds the greatest summand: that document is scored whole, the parts to its left and right get bounds of their own.
An interval of few postings is scored at once. The search ends when no bound can reach the k-th best score, which is carried
from shard to shard of a task; then the best of all tasks are merged in two steps.

Queries are taken in blocks of bounded size, so what is sent to tasks is bounded: terms, weights and query vectors of a block.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, named

TOP = 20
#: Characters of query texts in one block.
BLOCK_CHARS = 1 << 22
#: Postings of an interval up to which it is scored at once.
LEAF = 8192
#: Parts in which a query's candidates are merged first.
PARTS = 32
#: Ids after all others, for rows without one.
_LAST = (1 << 63) - 1
_SEPARATORS = bytes(0x20 if b < 0x80 and not chr(b).isalnum() else b for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split() if isinstance(text, str) else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def damped(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The measure of a document's length in a score, 100 for the average one."""
    return 75 + (25 * n * n_docs) // max(1, n_terms)


class Shard:
    """The postings of some documents (`key` ascending), by term and document, and the sparse table over them."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.keys, self.n = keys, len(keys)
        doc = np.repeat(np.arange(self.n), counts)
        score = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * damped(sizes, n_docs, n_terms)[doc]))
        held = np.flatnonzero(score > 0)
        order = held[np.argsort(terms[held], kind="stable")]
        self.doc, self.score = doc[order], score[order]
        self.place = terms[order] * self.n + self.doc
        self.begin = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        longest = int(np.diff(self.begin).max(initial=0))
        self.best = [np.arange(len(order))]
        while 2 << (len(self.best) - 1) <= longest:
            half, last = 1 << (len(self.best) - 1), self.best[-1]
            left, right = last[:-half], last[half:]
            self.best.append(np.where(self.score[left] >= self.score[right], left, right))
        self.levels = len(self.best)
        width = len(order)
        self.table = np.zeros((self.levels, width), dtype=np.int64)
        for level, row in enumerate(self.best):
            self.table[level, : len(row)] = row
        del self.best

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Places of the greatest scores in the ranges lo to hi of the lists; the ranges are not empty."""
        level = np.frexp(hi - lo)[1] - 1
        left, right = self.table[level, lo], self.table[level, hi - (1 << level)]
        return np.where(self.score[left] >= self.score[right], left, right)

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, top: list[tuple[int, int]]) -> None:
        """Put the shard's documents into the heap `top` of (score, -key), which holds the k best."""
        open_intervals: list[tuple] = []

        def consider(score: int, doc: int) -> None:
            entry = (score, -int(self.keys[doc]))
            if len(top) < k:
                heapq.heappush(top, entry)
            elif entry > top[0]:
                heapq.heapreplace(top, entry)

        def opened(a: int, b: int, lo: np.ndarray, hi: np.ndarray, which: np.ndarray) -> None:
            some = hi > lo
            if not some.any():
                return
            lo, hi, which = lo[some], hi[some], which[some]
            at = self.maxima(lo, hi)
            parts = times[which] * self.score[at]
            bound = int(parts.sum())
            if len(top) < k or (bound, -int(self.keys[a])) > top[0]:
                heapq.heappush(open_intervals, (-bound, a, b, lo, hi, which, int(self.doc[at[parts.argmax()]])))

        every = np.arange(len(terms))
        opened(0, self.n, self.begin[terms], self.begin[terms + 1], every)
        while open_intervals:
            bound, a, b, lo, hi, which, split = heapq.heappop(open_intervals)
            if len(top) == k and (-bound, -int(self.keys[a])) <= top[0]:
                if -bound < top[0][0]:
                    return
                continue
            size = hi - lo
            if size.sum() <= LEAF:
                at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
                total = np.zeros(b - a, dtype=np.int64)
                np.add.at(total, self.doc[at] - a, np.repeat(times[which], size) * self.score[at])
                for i in np.flatnonzero(total >= (top[0][0] if len(top) == k else 1)):
                    consider(int(total[i]), a + int(i))
                continue
            place = terms[which] * self.n + split
            mid = np.searchsorted(self.place, place)
            has = (mid < hi) & (self.place[np.minimum(mid, len(self.place) - 1)] == place)
            consider(int((times[which[has]] * self.score[mid[has]]).sum()), split)
            opened(a, split, lo, mid, which)
            opened(split + 1, b, mid + has, hi, which)


def _postings(docs: DataFrame, id_col: str, text_col: str, numbers: dict[bytes, int]) -> DataFrame:
    """`id`, `n` (terms), `t`, `f`: numbers of the query terms that each text holds, ascending, and how often."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)  # of one block of queries

    def run(parts):
        number = sent.value.get
        for part in parts:
            n, t, f = [], [], []
            for text in part.column("text").to_pylist():
                words = terms_of(text)
                held = Counter(map(number, words))
                held.pop(None, None)
                known = sorted(held.items())
                n.append(len(words))
                t.append([x for x, _ in known])
                f.append([x for _, x in known])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(t, pa.list_(pa.int32())), pa.array(f, pa.list_(pa.int64()))], ["id", "n", "t", "f"])

    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, t array<int>, f array<long>")


def _block(docs: DataFrame, queries: list[tuple[int, list[bytes]]], k: int, id_col: str, text_col: str) -> DataFrame:
    """`q`, `id`, `score`: the k best of each task for each query (number and terms) of a block."""
    spark = docs.sparkSession
    numbers = {term: i for i, term in enumerate(sorted({t for _, terms in queries for t in terms}))}
    postings = Scratch(spark).write("postings", _postings(docs, id_col, text_col, numbers))
    sizes = postings.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = sizes[0], sizes[1] or 0
    df = {r["t"]: r["count"] for r in postings.select(F.explode("t").alias("t")).groupBy("t").count().collect()}
    weights = np.array([weight(n_docs, df[i]) if i in df else 0 for i in range(len(numbers))], dtype=np.int64)
    asked = []
    for q, terms in queries:
        times = sorted((numbers[t], c) for t, c in Counter(terms).items() if weights[numbers[t]] > 0)
        if times:
            asked.append((q, np.array([t for t, _ in times]), np.array([c for _, c in times])))
    sent = spark.sparkContext.broadcast((asked, weights, n_docs, n_terms))  # of one block of queries

    def run(parts):
        asked, weights, n_docs, n_terms = sent.value
        best: dict[int, list[tuple[int, int]]] = {q: [] for q, _, _ in asked}
        for part in parts:
            part = part.filter(pa.compute.greater(part.column("n"), 0))
            ids = part.column("id").fill_null(_LAST)
            part = part.take(pa.compute.sort_indices(ids))
            counts = pa.compute.list_value_length(part.column("t")).to_numpy(zero_copy_only=False)
            flat = [part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "f")]
            shard = Shard(part.column("id").fill_null(_LAST).to_numpy(zero_copy_only=False), part.column("n").to_numpy(), counts, *flat, weights, n_docs, n_terms)
            for q, terms, times in asked:
                shard.search(terms, times, k, best[q])
        rows = [(q, -key, score) for q, top in best.items() for score, key in top]
        q, id_, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(id_, pa.int64()), pa.array(score, pa.int64())], ["q", "key", "score"])

    return postings.mapInArrow(run, "q long, key long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """`<item>`, `rank` (from 1), `<id>`, `score`: the k rows of `docs` with the highest scores above 0 for each item.

    Every row of either table counts for itself, repeated rows and ids too; equal scores are in the order of ids, rows
    without an id last. Null and empty texts have no terms: such a row is in no result, such an item has none. Long texts
    are read whole. Other columns, whatever their names, are not read. If either table is empty, so is the result.
    """
    spark = docs.sparkSession
    asked = items.select(named(item_col).cast("long").alias("item"), named(item_text_col).alias("text")).where(F.length("text") > 0)
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-chars // BLOCK_CHARS))
    best = None
    for block in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block).collect()
        rows.sort(key=lambda r: (r["item"] is None, r["item"] or 0, r["text"]))
        found = _block(docs, [(i, terms_of(r["text"])) for i, r in enumerate(rows)], k, id_col, text_col)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], "n long, item long")
        here = found.join(names, F.col("q") == F.col("n")).select(F.lit(block).alias("block"), "q", "item", "key", "score")
        best = here if best is None else best.unionByName(here)
    order = (F.desc("score"), F.asc("key"))
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS))
    first = Window.partitionBy("block", "q", part).orderBy(*order)
    last = Window.partitionBy("block", "q").orderBy(*order)
    some = best.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    ranked = some.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.nullif("key", F.lit(_LAST)).alias(id_col), "score")


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
    WITH d AS MATERIALIZED (SELECT doc_id, {_TERMS.format("coalesce(text, '')")} AS ws FROM documents),
    size AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d),
    q AS MATERIALIZED (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("coalesce(text, '')")}) AS t FROM benchmark) GROUP BY 1, 2),
    p AS MATERIALIZED (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ws)::BIGINT AS n, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
    w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY 1), size),
    s AS MATERIALIZED (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS s FROM p JOIN w USING (t), size),
    total AS (SELECT item_id, doc_id, sum(times * s)::BIGINT AS score FROM q JOIN s USING (t) GROUP BY 1, 2 HAVING sum(times * s) > 0)
    SELECT item_id, rank, doc_id, score FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM total) WHERE rank <= {TOP}"""
