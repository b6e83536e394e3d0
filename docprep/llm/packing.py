"""Length-bucketed packing (operator 5): boundaries by dynamic programming over the global histogram of lengths.

The only thing the driver gathers is that histogram, of at most `max_len` + 1 rows, as texts over `max_len` tokens are
cut into pieces first. Texts are read once. Batches are numbered from exact running counts: pieces are sorted by bucket and
id over ranges that Spark samples, so that however ids are spaced the parts are alike in size; the parts' counts are summed
within a bucket, and pieces are numbered within their part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, n_words, named

MAX_LEN = 2048
N_BUCKETS = 8
BATCH_TOKENS = 65_536


def optimal_bounds(lengths: list[int], counts: list[int], n_buckets: int = N_BUCKETS) -> list[int]:
    """Upper bounds of the buckets with the least padding in total; of equal choices the one with the smaller cut."""
    if not lengths:
        return []
    length, below = np.asarray(lengths, dtype=np.int64), np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))])
    n = len(length)
    cost, cuts = length * below[1:], []
    for k in range(1, min(n_buckets, n)):
        best, cut = np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64)
        for j in range(k, n):
            total = cost[k - 1 : j] + length[j] * (below[j + 1] - below[k : j + 1])
            i = int(total.argmin())
            best[j], cut[j] = total[i], i + k - 1
        cost = best
        cuts.append(cut)
    at, bounds = n - 1, []
    for cut in reversed(cuts):
        bounds.append(int(length[at]))
        at = int(cut[at])
    return [*reversed([*bounds, int(length[at])])]


def pack(docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """`<id>`, `piece_no`, `n_tokens`, `bucket_len`, `batch_no`: where each piece of each row goes.

    `length` is the tokens of a row, by default its words. A batch holds up to batch_tokens // bucket_len pieces of one
    bucket, in order of id and piece; only the last of a bucket is not full. A row without tokens is one piece of
    length zero in the smallest bucket. Null ids come first; equal ids and repeated rows keep a piece each, in either order.
    Long texts are counted whole. Other columns, whatever their names, are not read, but by `length`.
    """
    count = n_words(named(text_col)) if length is None else length
    sized = durable(docs.select(named(id_col).alias("id"), F.coalesce(count, F.lit(0)).cast("long").alias("n"), F.monotonically_increasing_id().alias("u")))
    parts = sized.select("id", "u", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / max_len), F.lit(1)).cast("int") - 1)).alias("piece_no"))
    parts = parts.select("id", "u", "piece_no", F.least(F.lit(max_len), F.col("n") - F.col("piece_no") * max_len).cast("int").alias("n_tokens"))
    histogram = sorted((r["n_tokens"], r["count"]) for r in parts.groupBy("n_tokens").count().collect())
    bounds = optimal_bounds([x for x, _ in histogram], [c for _, c in histogram], n_buckets) or [0]
    bucket = F.array_min(F.filter(F.lit(bounds), lambda b: b >= F.col("n_tokens")))
    order = ["bucket_len", "id", "piece_no", "n_tokens", "u"]  # u, a row's number in the scan, parts rows that are alike
    ordered = durable(parts.withColumn("bucket_len", bucket).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("part", F.shiftright("at", 33))  # the number of the partition
    counts = ordered.groupBy("bucket_len", "part").agg(F.count("*").alias("n"), F.min("at").alias("lo"))
    before = Window.partitionBy("bucket_len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("bucket_len", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("lo")).alias("shift"))
    numbered = ordered.join(shifts, ["bucket_len", "part"])
    capacity = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest("bucket_len", F.lit(1))))
    return numbered.select(F.col("id").alias(id_col), "piece_no", "n_tokens", "bucket_len", F.floor((F.col("at") + F.col("shift")) / capacity).cast("long").alias("batch_no"))


def oracle_sql(n_buckets: int = N_BUCKETS) -> str:
    """The same boundaries, one common table expression for each bucket of the dynamic programme."""
    step = """
        dp{k} AS (SELECT j, len, below, best['c'] AS cost, best['i'] AS i
                  FROM (SELECT b.j, b.len, b.below, min({{'c': a.cost + b.len * (b.below - a.below), 'i': a.j}}) AS best
                        FROM dp{p} a JOIN cum b ON a.j < b.j GROUP BY b.j, b.len, b.below))"""
    levels = ",".join(step.format(k=k, p=k - 1) for k in range(2, n_buckets + 1))
    back = ",".join(f" e{k} AS (SELECT d.i AS j FROM dp{k + 1} d JOIN e{k + 1} USING (j))" for k in range(n_buckets - 1, 0, -1))
    ends = " UNION ALL ".join(f"SELECT len FROM e{k} JOIN cum USING (j)" for k in range(1, n_buckets + 1))
    return rf"""
        WITH doc AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
        piece AS (SELECT doc_id, p::INT AS piece_no, least({MAX_LEN}, n - p * {MAX_LEN})::INT AS n_tokens
                  FROM doc, unnest(range(0, greatest(1, ceil(n / {MAX_LEN})::BIGINT))) AS t(p)),
        hist AS (SELECT n_tokens AS len, count(*) AS c FROM piece GROUP BY 1),
        cum AS (SELECT row_number() OVER (ORDER BY len) AS j, len, (sum(c) OVER (ORDER BY len))::BIGINT AS below FROM hist),
        dp1 AS (SELECT j, len, below, len * below AS cost FROM cum),{levels},
        e{n_buckets} AS (SELECT max(j) AS j FROM cum),{back},
        bound AS ({ends}),
        placed AS (SELECT doc_id, piece_no, n_tokens, (SELECT min(len) FROM bound WHERE len >= n_tokens) AS bucket_len FROM piece)
        SELECT doc_id, piece_no, n_tokens, bucket_len,
               ((row_number() OVER (PARTITION BY bucket_len ORDER BY doc_id, piece_no) - 1) // greatest(1, {BATCH_TOKENS} // greatest(1, bucket_len)))::BIGINT AS batch_no
        FROM placed"""
