"""Operators 11 to 13 against plain versions, and on odd input."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docprep.llm import divergence, lexical, minmax, substring
from test_llm import WORDS, components_of, corpus, docs_of

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
ITEM = "item_id long, text string, doc_id int, score string, id int"


# min-max hashing ---------------------------------------------------------------------------------------------------


def shingles(text, k=3):
    ws = WORDS.findall((text or "").translate(ASCII_LOWER))
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def plain_copies(texts, k=3, percent=85):
    sets = [shingles(t, k) for t in texts]
    roots = components_of(range(len(texts)), lambda a, b: bool(sets[a]) and len(sets[a] & sets[b]) * 100 >= percent * len(sets[a] | sets[b]))
    least = {}
    for i in range(len(texts)):
        least.setdefault(roots[i], i)
    return [(i, len(sets[i]), least[roots[i]], least[roots[i]] == i) for i in range(len(texts))]


def changed_copies(seed, groups=12, most=6):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 120))]
        for changes in range(most):
            copy = list(words)
            for p in rng.sample(range(len(copy)), changes):
                copy[p] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("dense, block, size", [(32, 2048, 8 << 20), (2, 5, 1000)])
def test_min_max_near_copies(spark, monkeypatch, dense, block, size):
    for name, value in (("DENSE_BUCKET", dense), ("BLOCK", block), ("BLOCK_BYTES", size), ("MANY", dense)):
        monkeypatch.setattr(minmax, name, value)
    texts = [*changed_copies(1), *corpus(2)]
    found = minmax.near_duplicates(docs_of(spark, texts)).collect()
    assert sorted(map(tuple, found)) == plain_copies(texts)


def test_min_max_chains_of_one_template(spark):
    """Every copy is near the template's limit, so that links are few among many candidates."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(150):
        copy = list(words)
        for p in rng.sample(range(100), rng.randrange(1, 5)):
            copy[p] = f"x{rng.randrange(10)}"
        texts.append(" ".join(copy))
    assert sorted(map(tuple, minmax.near_duplicates(docs_of(spark, texts)).collect())) == plain_copies(texts)


def test_min_max_estimates(spark):
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        every = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = minmax.signature(np.unique(every[:360])), minmax.signature(np.unique(every[40:]))
        errors.append((a == b).mean() - 320 / 400)
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < (0.8 * 0.2 / 160) ** 0.5 * 1.3


def test_min_max_odd_rows(spark):
    docs = docs_of(spark, ["a b c d", "A b c D", None, "", " \n", "a b", "A B", "a b", "x" * 3_000_000], ids=[2, 1, 3, 4, None, 5, None, 5, 6])
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minmax.near_duplicates(docs).collect())
    assert found == {(2, 2, 1, False): 1, (1, 2, 1, True): 1, (3, 0, 3, True): 1, (4, 0, 4, True): 1, (None, 0, None, True): 1, (5, 1, 5, True): 2, (None, 1, 5, False): 1, (6, 1, 6, True): 1}
    assert minmax.near_duplicates(docs_of(spark, [])).count() == 0
    kept = minmax.keep_first(docs.withColumnRenamed("h", "a.b"))
    assert kept.columns == docs.withColumnRenamed("h", "a.b").columns and kept.count() == 7


# lexical search ----------------------------------------------------------------------------------------------------


def plain_search(docs, items, k):
    """{item: [(doc_id, score)]} from the definition; docs and items are lists of (id, text)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    words = [(i, split(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, w in words if w), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = {}
    for item, text in items:
        scores = []
        for i, w in words:
            m, tf = 100 - 25 + (25 * len(w) * n_docs) // max(1, n_terms), Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in split(text) if tf[t])
            scores += [(-s, i)] if s > 0 else []
        out[item] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("leaf, k, block", [(8192, 20, 1 << 22), (1, 3, 50), (16, 7, 1 << 22)])
def test_lexical_search(spark, monkeypatch, leaf, k, block):
    monkeypatch.setattr(lexical, "LEAF", leaf)
    monkeypatch.setattr(lexical, "BLOCK_CHARS", block)
    rng = random.Random(leaf)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "日本", "A1", "ﬁ", "a"]
    texts = [rng.choice([" ", "-", "\n", "_"]).join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(66)], k=rng.randrange(0, 60))) for _ in range(300)]
    texts += [texts[5], texts[5], None, "", "...", "W1 w2," * 500]
    items = [(i, rng.choice([" ", "/"]).join(rng.choices(vocabulary, k=rng.randrange(1, 25)))) for i in range(12)] + [(100, None), (101, "zz ."), (102, "")]
    docs = docs_of(spark, texts).repartition(3)
    found = lexical.search(docs, spark.createDataFrame([(i, t, 1, "s", 2) for i, t in items], ITEM), k).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["item_id"], r["rank"])):
        got[r["item_id"]].append((r["doc_id"], r["score"]))
        assert r["rank"] == len(got[r["item_id"]])
    want = plain_search(list(enumerate(texts)), items, k)
    assert dict(got) == {i: x for i, x in want.items() if x}


def test_lexical_search_of_odd_tables(spark):
    docs = docs_of(spark, ["a b", "a b", "a b", "c", None], ids=[1, 1, None, 2, 3])
    items = spark.createDataFrame([(7, "a", 0, "", 0), (7, "a", 0, "", 0), (None, "b", 0, "", 0)], ITEM)
    found = Counter((r["item_id"], r["rank"], r["doc_id"]) for r in lexical.search(docs, items).collect())
    assert found == {(7, 1, 1): 2, (7, 2, 1): 2, (7, 3, None): 2, (None, 1, 1): 1, (None, 2, 1): 1, (None, 3, None): 1}
    none = spark.createDataFrame([], ITEM)
    for d, i in ((docs, none), (docs_of(spark, []), items), (docs_of(spark, []), none), (docs_of(spark, [None, ""]), items)):
        out = lexical.search(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_range_maxima():
    rng = np.random.default_rng(1)
    n = 200
    counts = rng.integers(0, 6, n)
    terms = np.concatenate([np.sort(rng.choice(8, c, replace=False)) for c in counts])
    shard = lexical.Shard(np.arange(n), counts + 5, counts, terms, rng.integers(1, 9, len(terms)), np.array([0, *range(5, 12)]), n, 2000)
    for t in range(8):
        lo, hi = shard.begin[t], shard.begin[t + 1]
        assert (hi == lo) == (t == 0)
        for a, b in itertools.combinations(range(lo, hi + 1), 2):
            at = shard.maxima(np.array([a]), np.array([b]))[0]
            assert a <= at < b and shard.score[at] == shard.score[a:b].max()


# source divergence -------------------------------------------------------------------------------------------------


def plain_audit(rows, min_docs, top):
    """Both parts from the definition; rows are (lang, source, text)."""
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))) for lang, source, t in rows]
    holders, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in rows:
        holders[lang].update(set(words))
        counts[lang, source].update(words)
        counts[lang, None].update(words)
    out = set()
    for lang in holders:
        kept = [t for t, n in holders[lang].items() if n >= min_docs]
        share = {}
        for source in {s for a, s in counts if a == lang}:
            n = sum(counts[lang, source][t] for t in kept)
            share[source] = {t: 1 + 10**9 * (counts[lang, source][t] + 2) // (n + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for source in share.keys() - {None}:
            pair = [(-sum(f(share[source][t], share[other][t]) for t in kept), other) for other in share.keys() - {None, source}]
            term = [(-f(p, share[None][t]), t) for t, p in share[source].items() if counts[lang, source][t] and p > share[None][t]]
            for part, found in (("pair", sorted(pair, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(term, key=lambda x: (x[0], x[1].encode()))[:top])):
                out |= {(lang, source, part, item, -v, r) for r, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_source_divergence(spark, block):
    rng = random.Random(block)
    vocabulary = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70)] + ["É", "é", "日本", "\U0001f600"]
    rows = []
    for i in range(400):
        source = rng.choice(["s1", "s1", "s1", "s2", "S", None, "ü"])
        lang = rng.choice(["en", "de", None])
        some = vocabulary if source != "s2" else vocabulary[:30]
        rows.append((i, rng.choice([" ", "1", "_"]).join(rng.choices(some, k=rng.randrange(0, 9))), lang, source))
    rows += [(900, None, "en", "none"), (901, "", "en", "empty"), (902, "only here", "xx", "a"), (903, None, "xx", "b"), (901, "", "en", "empty")]
    docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "doc_id long, text string, lang string, source string, count int, term string, v int").repartition(5)
    found = Counter(map(tuple, divergence.audit(docs, min_docs=10, top=4, block_terms=block).collect()))
    assert found == Counter(plain_audit([(lang, source, t) for _, t, lang, source in rows], 10, 4))


def test_source_divergence_of_odd_tables(spark, monkeypatch):
    assert divergence.audit(docs_of(spark, [])).count() == 0
    assert {tuple(r) for r in divergence.audit(spark.createDataFrame([("a", "x", None), ("b", "x", None)], "source string, lang string, text string")).collect()} == {("x", "a", "pair", "b", 0, 1), ("x", "b", "pair", "a", 0, 1)}
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    texts = ["a b c d e f" * 3, "b c d", "x" * 2_000_000] * 4
    docs = docs_of(spark, texts).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    want = plain_audit([("en", f"s{i % 3}", t) for i, t in enumerate(texts)], 2, 10)
    assert {tuple(r) for r in divergence.audit(docs, min_docs=2).collect()} == want


def test_gallop_and_large_counts():
    rng = np.random.default_rng(2)
    for n, m in ((0, 0), (0, 5), (1, 1), (3, 2000), (700, 900), (900, 20000)):
        a, b = (np.sort(rng.choice(30000, k, replace=False)) for k in (n, m))
        here, there = divergence.gallop(a, b)
        assert a[here].tolist() == b[there].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    count = np.array([0, 1, 10**13], dtype=np.int64)
    assert divergence.share(count, 10**13 + 7).tolist() == [1 + 10**9 * (int(c) + 2) // (10**13 + 7) for c in count]


def test_substring_rows_are_numbered(spark):
    """Numbers without gaps by id and th over several partitions; rows of one id know the least of theirs."""
    keys = [(i // 3 if i < 60 else i, th) for i in range(200) for th in (i * 7919 % 101,)]
    scratch = substring.Scratch(spark)
    found = substring.numbered(spark.createDataFrame(keys, "id long, th long").repartition(7), scratch).collect()
    assert [(r["id"], r["th"]) for r in sorted(found, key=lambda r: r["row"])] == sorted(keys)
    assert sorted(r["row"] for r in found) == list(range(len(keys)))
    assert all(r["low"] == min(x["row"] for x in found if x["id"] == r["id"]) for r in found)


def test_substring_edges_are_hashed_not_sorted(spark, monkeypatch):
    """The first place of an edge is found by a hashed minimum, without sorting the edges."""
    plans, write = {}, substring.Scratch.write

    def watched(self, name, df, by=None, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(self, name, df, by, **options)

    monkeypatch.setattr(substring.Scratch, "write", watched)
    text = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring.deduplicate(docs).collect()} == {1: 0, 2: 40}
    assert "SortAggregate" not in plans["first0"] and "HashAggregate" in plans["first0"]
