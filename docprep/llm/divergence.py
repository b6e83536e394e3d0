"""Source divergence audit (operator 13): how far the sources of a language are apart in the words they use.

Terms are counted once in a pass over the texts, summed by (language, source, term), and those that enough documents of a
language hold are kept. A kept term has a number within one of several blocks of its language, so that a group's sorted
(number, count) arrays are bounded however many terms there are. For each unordered pair of a language's sources and each
block the two arrays are co-grouped into one task, where the shorter one gallops through the longer one: overlaps and terms
of one side are priced there, and terms that neither side has are one price times their number. The price is symmetric, so a
merge serves both directions.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, named, split_join

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Kept terms of a language in one block, on average.
BLOCK_TERMS = 1 << 16
#: Distinct terms that a task holds before it passes its counts on.
HELD_TERMS = 200_000
#: Terms of the shorter array that are looked for between two gallops.
STRIDE = 256
_SEPARATORS = bytes(0x20 if b < 0x80 and not chr(b).isalpha() else b for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and all characters beyond ASCII, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split() if isinstance(text, str) else []


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two ascending arrays without repeats of the numbers that both hold."""
    at, here, there = 0, [], []
    for lo in range(0, len(short), STRIDE):
        wanted, step = short[lo : lo + STRIDE], 1
        while at + step < len(long) and long[at + step] < wanted[-1]:
            step *= 2
        part = long[at : at + step + 1]
        place = np.searchsorted(part, wanted)
        met = np.flatnonzero(part[np.minimum(place, len(part) - 1)] == wanted) if len(part) else np.zeros(0, dtype=np.int64)
        here.append(lo + met)
        there.append(at + place[met])
        at += int(place[-1])
    return (np.concatenate(here), np.concatenate(there)) if here else (np.zeros(0, dtype=np.int64),) * 2


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), exact for counts of any size."""
    if len(count) and int(count.max()) + 2 >= (1 << 63) // SCALE:
        return np.array([1 + SCALE * (int(c) + 2) // total for c in count], dtype=np.int64)
    return 1 + (SCALE * (count + 2)) // total


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def merge(ids1: np.ndarray, counts1: np.ndarray, total1: int, ids2: np.ndarray, counts2: np.ndarray, total2: int) -> tuple[int, int]:
    """The summed price of the terms that at least one of two sparse arrays has, and how many these are."""
    if len(ids1) > len(ids2):
        ids1, counts1, total1, ids2, counts2, total2 = ids2, counts2, total2, ids1, counts1, total1
    p, q = share(counts1, total1), share(counts2, total2)
    none = np.zeros(1, dtype=np.int64)
    p0, q0 = share(none, total1), share(none, total2)
    here, there = gallop(ids1, ids2)
    alone1, alone2 = np.delete(p, here), np.delete(q, there)
    value = int(price(p[here], q[there]).sum()) + int(price(alone1, q0).sum()) + int(price(p0, alone2).sum())
    return value, len(ids1) + len(ids2) - len(here)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """`lang`, `source`, `term`, `count`, `docs`: partial counts of a task; a row with a null term tells of the group."""
    blank = lambda c: F.coalesce(named(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), named(text_col).alias("text"))

    def passed(held):
        lang, source, term, count, n = [], [], [], [], []
        for (a, b), (counts, holders) in held.items():
            size = len(counts) + 1
            lang += [a] * size
            source += [b] * size
            term += [None, *(t.decode("utf-8", "surrogatepass") for t in counts)]
            count += [0, *counts.values()]
            n += [0, *(holders[t] for t in counts)]
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.string()), pa.array(count, pa.int64()), pa.array(n, pa.int64())], ["lang", "source", "term", "count", "docs"])

    def run(parts):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for part in parts:
            for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                counts, holders = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(counts)
                words = terms_of(text)
                counts.update(words)
                holders.update(set(words))
                size += len(counts)
                if size > HELD_TERMS:
                    yield passed(held)
                    held, size = {}, 0
        yield passed(held)

    return rows.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def _share(count: Column, total: Column) -> Column:
    """`share` in decimals of 38 digits, which hold every product of two counts."""
    exact = lambda c: c.cast("decimal(20,0)")
    return F.expr("1L") + F.call_function("div", exact(count + 2) * F.lit(SCALE).cast("decimal(10,0)"), exact(total))


def _price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """`lang`, `source`, `part`, `item`, `value`, `rank` for every occurring group of a language and a source.

    Part `pair`: each other source of the language, with the summed price over all kept terms, the farthest first. Part
    `term`: the `top` terms that the group has in excess of its language. Null languages, sources and texts are empty
    ones. Every row is a document, repeated rows too; ids are not read, nor are other columns, whatever their names. Texts
    without terms still make a group. Long texts are counted whole. An empty table gives an empty table. Equal values are
    in the order of the UTF-8 bytes of their items.
    """
    scratch = Scratch(docs.sparkSession)
    counts = term_counts(docs, text_col, lang_col, source_col).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    counts = scratch.write("counts", counts)
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("count").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = scratch.write("kept", terms.select("lang", "term", "in_lang"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("n_lang"))
    blocks = max(1, -(-(langs.agg(F.max("v")).first()[0] or 0) // block_terms))
    kept = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    kept = kept.withColumn("number", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")))
    held = scratch.write("held", split_join(counts.where("term IS NOT NULL").select("lang", "source", "term", "count"), kept, ["lang", "term"]))
    sizes = held.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = scratch.write("groups", groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "n_lang")]).withColumn("total", F.col("n") + 2 * F.col("v")))
    scratch.drop("kept", "counts")

    p, q = _share(F.col("count"), F.col("total")), _share(F.col("in_lang"), F.col("n_lang") + 2 * F.col("v"))
    shares = split_join(held, groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q"))
    farthest = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _price(F.col("p"), F.col("q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(farthest)).where(F.col("rank") <= top)

    arrays = held.groupBy("lang", "source", "block").agg(F.array_sort(F.collect_list(F.struct("number", "count"))).alias("x"))
    arrays = scratch.write("arrays", arrays.select("lang", "source", "block", F.col("x.number").alias("ids"), F.col("x.count").alias("counts")))
    one, two = (groups.select("lang", F.col("source").alias(f"s{i}"), F.col("total").alias(f"total{i}"), "v") for i in (1, 2))
    pairs = scratch.write("pairs", one.join(two.drop("v"), "lang").where("s1 < s2"))
    by, sides = ("lang", "s1", "s2", "block"), []
    for i in (1, 2):
        side = arrays.withColumnRenamed("source", f"s{i}").join(pairs, ["lang", f"s{i}"])
        side = side.select(*[F.col(c).alias(f"{c}_{i}") for c in by], *[F.col(c).alias(c) for c in ("ids", "counts", "total1", "total2")])
        sides.append(side.groupBy(*[f"{c}_{i}" for c in by]))

    def run(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        some = x if len(x) else y
        none = np.zeros(0, dtype=np.int64)
        a, b = ([np.asarray(side[c].iloc[0], dtype=np.int64) for c in ("ids", "counts")] if len(side) else (none, none) for side in (x, y))
        total1, total2 = int(some["total1"].iloc[0]), int(some["total2"].iloc[0])
        value, n = merge(*a, total1, *b, total2)
        return pd.DataFrame({"lang": [key[0]], "s1": [key[1]], "s2": [key[2]], "priced": [value], "n_priced": [n]})

    merged = sides[0].cogroup(sides[1]).applyInPandas(run, "lang string, s1 string, s2 string, priced long, n_priced long")
    summed = merged.groupBy("lang", "s1", "s2").agg(F.sum("priced").alias("priced"), F.sum("n_priced").alias("n_priced"))
    absent = _price(_share(F.lit(0), F.col("total1")), _share(F.lit(0), F.col("total2")))
    value = F.coalesce("priced", F.lit(0)) + F.when(F.col("v") > 0, (F.col("v") - F.coalesce("n_priced", F.lit(0))) * absent).otherwise(0)
    valued = scratch.write("valued", pairs.join(summed, ["lang", "s1", "s2"], "left").select("lang", "s1", "s2", value.alias("value")))
    ways = [valued.select("lang", F.col(a).alias("source"), F.lit("pair").alias("part"), F.col(b).alias("item"), "value") for a, b in (("s1", "s2"), ("s2", "s1"))]
    apart = ways[0].unionByName(ways[1]).withColumn("rank", F.row_number().over(farthest))
    return apart.unionByName(above)


def _share_sql(count: str, total: str) -> str:
    return f"(1 + ({SCALE}::HUGEINT * ({count} + 2)) // ({total}))"


ORACLE_SQL = rf"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS u, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
    t AS MATERIALIZED (SELECT u, lang, source, unnest(ws) AS term FROM d),
    kept AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM t GROUP BY 1, 2 HAVING count(DISTINCT u) >= {MIN_DOCS}),
    langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY 1),
    held AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
    grp AS MATERIALIZED (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(langs.n), 0) AS n_lang, coalesce(any_value(s.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM held GROUP BY 1, 2) s USING (lang, source) GROUP BY 1, 2),
    p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(h.c, 0) AS c, {_share_sql("coalesce(h.c, 0)", "g.n + 2 * g.v")} AS p, {_share_sql("k.c", "g.n_lang + 2 * g.v")} AS q
          FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
    pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
             FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 4),
    term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE c > 0 AND p > q)
    SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
    WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
