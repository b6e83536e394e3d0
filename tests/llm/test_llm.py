"""The corpus operators against brute force on small fixtures, and on odd input: nulls, empty and long texts, ties,
repeated rows, empty tables and further columns with clashing names."""

import base64
import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from docprep.llm import ann, bpe, components, cotraining, langid, line_rules, lines, packing, queries, simhash, substring, url_rules

DATA = os.environ.get("DOCPREP_TESTDATA", "/root/testdata/sf0.001")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, g int, h string, th string, label int"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "x", "y", 3) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def corpus(seed, n=60):
    """Texts of few words in lines, with copies, shared passages and odd ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ß!", "日本"]
    passage = " ".join(rng.choices(vocabulary, k=30))
    out = []
    for _ in range(n):
        text = "\n".join(rng.choice(["", " "]) + rng.choice([" ", "\t"]).join(rng.choices(vocabulary, k=rng.randrange(1, 14))) for _ in range(rng.randrange(1, 9)))
        kind = rng.random()
        out.append(passage + "\n" + text if kind < 0.2 else rng.choice(out) if kind < 0.4 and out else (rng.choice(out) or "") + " more" if kind < 0.5 and out else text)
    return [*out, None, "", " \n\t\n", "one", "x" * 5000, "a b c", "a b c"]


# line dedup --------------------------------------------------------------------------------------------------------


def kept_lines(docs, n):
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        every = (text or "").split("\n")
        at = [p for p, x in enumerate(every) if WORDS.search(x)]
        gone = set()
        for k in range(len(at) - n + 1):
            run = tuple(every[p] for p in at[k : k + n])
            gone.update(at[k : k + n] if run in seen else ())
            seen.add(run)
        out[i] = ("\n".join(x for p, x in enumerate(every) if p not in gone), len(gone))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_line_runs(spark, n):
    texts = corpus(n)
    rng = random.Random(n)
    pool = [t for t in texts if t]
    texts += ["\n".join(rng.choice(pool) for _ in range(3)) for _ in range(20)]
    found = lines.deduplicate_lines(docs_of(spark, texts), min_lines=n).collect()
    assert {r["__id"]: (r["kept"], r["n_removed"]) for r in found} == kept_lines(dict(enumerate(texts)), n)


def longest_earlier(docs):
    """By definition: for each line with an earlier copy, how many lines from it on have one together."""
    where = {i: [x for x in (t or "").split("\n") if WORDS.search(x)] for i, t in docs.items()}
    starts, out = [(i, p) for i in sorted(where) for p in range(len(where[i]))], {}
    for n, (i, p) in enumerate(starts):
        best = 0
        for j, q in starts[:n]:
            d = 0
            while p + d < len(where[i]) and q + d < len(where[j]) and where[i][p + d] == where[j][q + d]:
                d += 1
            best = max(best, d)
        if best:
            out.setdefault(i, {})[p] = best
    return out


def test_maximal_line_runs(spark):
    rng = random.Random(8)
    texts = ["a\nb\nq", "a\nb\nc\nd", "a\nb\nc\nd", "\n".join("x" * 23), "\n".join("x" * 40 + "y"), "\n".join("ab" * 9 + "c")]
    base = [f"line {i}" for i in range(40)]
    for _ in range(25):
        lo = rng.randrange(30)
        texts.append("\n".join([rng.choice("pqr"), *base[lo : lo + rng.randrange(1, 30)], rng.choice("pqr")]))
    found = {r["__id"]: r for r in lines.deduplicate_lines(docs_of(spark, texts)).collect()}
    want = longest_earlier(dict(enumerate(texts)))
    for i in range(len(texts)):
        lcp = want.get(i, {})
        assert found[i]["n_removed"] == len(lcp)
        assert found[i]["longest_run"] == max(lcp.values(), default=0)
        assert found[i]["n_runs"] == sum(1 for p, d in lcp.items() if lcp.get(p - 1, 0) + p - 1 < p + d)


def test_line_rows_of_one_id_and_null_ids(spark):
    docs = docs_of(spark, ["a\nb", "a\nb", "a\nb\nc", "a\nb", "x\n\n"], ids=[1, 1, 2, None, 1])
    found = Counter((r["__id"], r["kept"]) for r in lines.deduplicate_lines(docs, min_lines=1).collect())
    assert found == {(1, ""): 2, (2, "c"): 1, (None, "a\nb"): 1, (1, "x\n\n"): 1}
    assert Counter((r["doc_id"], r["text"], r["label"]) for r in lines.without_repeated_lines(docs).collect()) == {(2, "c", 3): 1, (None, "a\nb", 3): 1, (1, "x\n\n", 3): 1}


# substring dedup ---------------------------------------------------------------------------------------------------


def kept_words(docs, k):
    first = {}
    words = {i: WORDS.findall(t or "") for i, t in docs.items()}
    for i, ws in sorted(words.items()):
        for p in range(len(ws) - k + 1):
            first.setdefault(tuple(ws[p : p + k]), i)
    out = {}
    for i, ws in words.items():
        gone = {q for p in range(len(ws) - k + 1) if first[tuple(ws[p : p + k])] < i for q in range(p, p + k)}
        out[i] = (len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone))
    return out


def test_substrings(spark):
    texts = corpus(7, 90)
    found = substring.deduplicate(docs_of(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in found} == kept_words(dict(enumerate(texts)), 13)
    spans = defaultdict(set)
    every = {i: WORDS.findall(t or "") for i, t in enumerate(texts)}
    for r in substring.repeated_spans(docs_of(spark, texts)).collect():
        mine, other = (every[r[i]][r[p] : r[p] + r["n_words"]] for i, p in (("doc_id", "first_word"), ("source_id", "source_word")))
        assert mine == other and r["source_id"] < r["doc_id"]
        spans[r["doc_id"]].update(range(r["first_word"], r["first_word"] + r["n_words"]))
    assert {i: len(s) for i, s in spans.items()} == {r["doc_id"]: r["n_removed"] for r in found if r["n_removed"]}


def test_substring_pieces_of_paths(spark, monkeypatch):
    """A long source that many documents quote, over the edges of pieces and within one; pieces of all sizes give the same."""
    rng = random.Random(11)
    source = [f"s{i}" for i in range(1400)]
    quotes = [(lo, lo + rng.choice([13, 14, 40, 600])) for lo in rng.sample(range(1300), 40)] + [(0, 1400), (500, 525), (511, 524), (512, 525), (1387, 1400)]
    texts = [" ".join(source), *(" ".join([f"a{i}", *source[lo:hi], f"b{i}"]) for i, (lo, hi) in enumerate(quotes)), " ".join(source[:600] + ["x"] + source[601:])]
    want, spans = kept_words(dict(enumerate(texts)), 13), []
    for piece in (512, 5, 1):
        monkeypatch.setattr(substring, "PIECE", piece)
        found = substring.deduplicate(docs_of(spark, texts)).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in found} == want
        spans.append(sorted(map(tuple, substring.repeated_spans(docs_of(spark, texts)).collect())))
    assert spans[0] == spans[1] == spans[2]
    assert [s for s in spans[0] if s[3] == 0 and s[0] <= len(quotes)] == sorted((i + 1, 1, min(hi, 1400) - lo, 0, lo) for i, (lo, hi) in enumerate(quotes))


def test_substring_rows_of_one_id_and_columns(spark):
    long = " ".join(map(str, range(20)))
    docs = docs_of(spark, [long, long, long, long + " tail", None, ""], ids=[1, 1, 2, 3, None, 4])
    found = Counter((r["doc_id"], r["n_removed"]) for r in substring.deduplicate(docs).collect())
    assert found == {(1, 0): 2, (2, 20): 1, (3, 20): 1, (None, 0): 1, (4, 0): 1}
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"], r["g"], r["h"]) for r in out.collect()) == {(1, long, 2, "x"): 2, (3, "tail", 2, "x"): 1, (None, None, 2, "x"): 1, (4, "", 2, "x"): 1}


def test_substring_hashes_without_algebra(spark):
    """Words that a polynomial hash modulo a power of two cannot tell apart."""
    thue = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    same = " ".join(f"w{i}" for i in range(12))
    docs = docs_of(spark, [f"{same} {thue}", f"{same} {thue.translate({97: 98, 98: 97})}"])
    assert [r["n_removed"] for r in substring.deduplicate(docs).collect()] == [0, 0]


def test_substring_compares_words():
    """Equal hashes of different words remove nothing."""
    words, source = [f"w{i}".encode() for i in range(20)], " ".join(["w0", *(f"w{i}" for i in range(1, 14)), "x", "w15"])
    line, begin = b" ".join(words), np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    assert substring._equal_words(words, line, begin, 0, source, 13) == [(0, 13), (1, 14)]
    assert substring._equal_words(words, line, begin, 2, "w2 w3", 2) == [(2, 4)]
    assert substring._equal_words(words, line, begin, 18, "w18 w1", 2) == []


def test_names_with_dots_and_clashes(spark):
    docs = docs_of(spark, ["a\nb", "a\nb\nc", None]).toDF("doc_id", "text", "n_removed", "a.b", "n_lines", "kept", "at", "s", "cut", "words")
    for stage in (lines.without_repeated_lines, substring.without_repeats, simhash.keep_first):
        out = stage(docs)
        assert out.columns == docs.columns and out.count() >= 1


# simhash -----------------------------------------------------------------------------------------------------------


def fingerprint(text):
    ws = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(values, linked):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if linked(a, b):
            root[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_simhash(spark):
    texts = [*corpus(3), "A b C d", "a B c D", "À b"]
    found = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    prints = {i: fingerprint(t) for i, t in enumerate(texts)}
    assert {i: f for i, (f, _) in found.items()} == prints
    roots = components_of(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, f in sorted(prints.items()):
        least.setdefault(roots[f], i)
    assert {i: c for i, (_, c) in found.items()} == {i: least[roots[f]] for i, f in prints.items()}


@pytest.mark.parametrize("dense, block, many", [(1 << 20, 64, 1 << 25), (3, 16, 1 << 25), (3, 16, 1)])
def test_simhash_links(spark, monkeypatch, dense, block, many):
    """Clouds of near values, by the plain join, in blocks, and with wider segments."""
    for name, value in (("DENSE_SLOT", dense), ("BLOCK", block), ("MANY", many)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(5)
    centers = [rng.getrandbits(64) for _ in range(4)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for c in centers for _ in range(70)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links)
    pairs = {frozenset(x) for x in links}
    near = components_of(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    got = components_of(signed, lambda a, b: frozenset((a, b)) in pairs)
    assert {frozenset(v for v in signed if near[v] == r) for r in set(near.values())} == {frozenset(v for v in signed if got[v] == r) for r in set(got.values())}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def test_keep_first_keeps_columns_and_null_ids(spark):
    docs = docs_of(spark, ["a b c d e", "a b c d e", "z", None, ""], ids=[2, 1, None, 5, 4])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == {1: 1, None: 1, 4: 1}


# byte-level BPE ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("size, overlap", [(1 << 15, 1 << 11), (40, 12), (24, 20)])
def test_bpe(spark, encoding, size, overlap):
    rng = random.Random(size)
    texts = ["".join(rng.choice(["a", "b ", "  ", "\n", "'re", "'", "l", "12", "é", "日本", "!?", "😀", "\u2003", "<|endoftext|>"]) for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += [None, "", "x" * 700, " " * 300, texts[0], texts[0], "a" * 39 + "'re b", "\n" * 100 + "z"]
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = bpe.round_trip_digest(docs_of(spark, texts), vocabulary, size=size, overlap=overlap).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {i: (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in enumerate(texts) for ids in [encoding.encode_ordinary(t or "")]}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found} == want
    assert bpe.round_trip_digest(docs_of(spark, [texts[0]] * 3, ids=[1, 1, 1]), vocabulary, size=size, overlap=overlap).count() == 3


def test_bpe_joins_only_around_a_failed_cut(spark, encoding):
    words = " ".join(f"w{i}" for i in range(60))
    text = words + " " + "x" * 150 + " " + words
    rows = bpe.with_row_key(docs_of(spark, [text, "y" * 400, words]), "doc_id", "text")
    found = defaultdict(list)
    for r in bpe.pieces(rows, public_tokenizers.PATTERN, size=40, overlap=12).collect():
        found[r["__id"]].append((r["k"], r["piece"]))
    assert {i: "".join(p for _, p in sorted(ps)) for i, ps in found.items()} == {0: text, 1: "y" * 400, 2: words}
    assert len(found[0]) >= 7 and len(found[1]) == 1
    for ps in found.values():
        ids = [t for _, p in sorted(ps) for t in encoding.encode_ordinary(p)]
        assert ids == encoding.encode_ordinary("".join(p for _, p in sorted(ps)))


def test_bpe_classes_of_characters(spark, encoding):
    odd = [chr(c) for c in sorted(bpe._reclassed())]
    rng = random.Random(5)
    texts = ["".join(rng.choice([rng.choice(odd), "a", " ", "1", "!", "'s", "\n"]) for _ in range(120)) for _ in range(150)]
    for pattern in (r"\p{L}", r"\p{N}", r"\s"):
        some = "".join(odd)[:3000]
        both = tiktoken.Encoding("c", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        assert len(both.decode_bytes(both.encode_ordinary(some)).decode()) == len(bpe.regex.findall(pattern, some.translate(bpe._reclassed())))
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r["__id"]: list(r["ids"]) for r in bpe.encode(docs_of(spark, texts), vocabulary, size=24, overlap=20).collect()}
    assert got == {i: encoding.encode_ordinary(t) for i, t in enumerate(texts)}


# packing -----------------------------------------------------------------------------------------------------------


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        sizes = sorted(rng.sample(range(30), rng.randrange(1, 8)))
        counts = [rng.randrange(1, 9) for _ in sizes]
        k = rng.randrange(1, 5)
        padded = lambda bounds: sum(c * min(b for b in bounds if b >= n) for n, c in zip(sizes, counts, strict=True))
        best = min(padded([*cut, sizes[-1]]) for cut in itertools.combinations(sizes[:-1], min(k, len(sizes)) - 1))
        assert padded(packing.optimal_bounds(sizes, counts, k)) == best


def test_packing(spark):
    rng = random.Random(2)
    texts = [" ".join(["w"] * rng.randrange(70)) for _ in range(200)] + [None, "", "w " * 205]
    rows = packing.pack(docs_of(spark, texts), max_len=50, n_buckets=3, batch_tokens=200).collect()
    total = Counter()
    batches = defaultdict(list)
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
        assert r["n_tokens"] <= r["bucket_len"]
        batches[r["bucket_len"], r["batch_no"]].append((r["doc_id"], r["piece_no"]))
    assert dict(total) == {i: len(WORDS.findall(t or "")) for i, t in enumerate(texts)}
    for (size, number), members in batches.items():
        last = max(n for b, n in batches if b == size)
        assert len(members) == 200 // size or (number == last and len(members) <= 200 // size)
    for size in {b for b, _ in batches}:
        flat = [m for n in range(max(n for b, n in batches if b == size) + 1) for m in sorted(batches[size, n])]
        assert flat == sorted(flat)
    assert packing.pack(docs_of(spark, ["a", "a", "b"], ids=[None, None, 1])).count() == 3


# nearest neighbours ------------------------------------------------------------------------------------------------


def test_nearest_visits_few_cells_of_clustered_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "NEAR_CELLS", 2)
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((25, 16))
    vectors = centers[rng.integers(0, 25, 2000)] + 0.02 * rng.standard_normal((2000, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    visited, waves, plain = 0, 0, ann._searched

    def counted(pairs, *rest):
        nonlocal visited, waves
        visited, waves = visited + pairs.count(), waves + 1
        return plain(pairs, *rest)

    monkeypatch.setattr(ann, "_searched", counted)
    found = defaultdict(set)
    for r in ann.nearest(frame, "vec_id % 50 = 0", cells=48).collect():
        found[r["query_id"]].add(r["vec_id"])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2000, 50):
        score = unit @ unit[q]
        score[q] = -9
        hits += len(found[q] & set(np.argsort(-score)[:5].tolist()))
    assert hits >= 0.9 * 200 and waves > 2
    assert visited < 0.5 * 40 * 48


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 5)
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((6, 16))
    vectors = [(centers[i % 6] + 0.4 * rng.standard_normal(16)).astype(np.float32).tolist() for i in range(400)]
    vectors[100:140] = [vectors[100]] * 40
    rows = [(i, v, "x", i) for i, v in enumerate(vectors)] + [(1000, None, "x", 0), (1050, [0.0] * 16, "x", 0), (1100, [float("nan")] + [1.0] * 15, "x", 0), (1150, [None] + [1.0] * 15, "x", 0), (1200, [1.0], "x", 0), (None, vectors[0], "x", 0), (1250, [], "x", 0), (0, vectors[0], "x", 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string, rank int")
    found = defaultdict(list)
    for r in ann.nearest(frame, "vec_id % 50 = 0", cells=8, sample=100).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    unit = np.array(vectors, dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 400, 50):
        score = np.round(unit @ unit[q], 10)
        score[q] = -9
        best = np.lexsort((np.arange(400), -score))[:5]
        mine = sorted(found[q])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s - float(unit[v] @ unit[q])) < 1e-12 for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(best.tolist()))
    assert hits >= 0.9 * 40 and set(found) == set(range(0, 400, 50))
    assert [v for _, v, _ in sorted(found[100])] == [101, 102, 103, 104, 105]
    few = ann.nearest(frame.where("vec_id IN (0, 7)"), "vec_id % 50 = 0").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 7)]
    assert ann.nearest(frame.where("vec_id > 5000"), "vec_id % 50 = 0").count() == 0


def test_chi_square():
    assert abs(ann.chi2_quantile(0.95, 8) - 15.507) < 1e-3


# quality rules -----------------------------------------------------------------------------------------------------


def test_quality_rules_on_odd_texts(spark):
    texts = [*corpus(11), " ".join(map(str, range(8))) + " " + " ".join(map(str, range(8))), "# * é$"]
    docs = docs_of(spark, texts)
    found = {r["doc_id"]: r for r in line_rules.quality(docs, min_docs=3, max_share=0.0).collect()}
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    holders = Counter(x for t in texts for x in {normal(x) for x in (t or "").split("\n") if WORDS.search(x)})
    for i, t in enumerate(texts):
        r, ws = found[i], WORDS.findall(t or "")
        worded = [x for x in (t or "").split("\n") if WORDS.search(x)]
        runs = Counter(tuple(ws[p : p + 8]) for p in range(len(ws) - 7))
        repeat = {q for p in range(len(ws) - 7) if runs[tuple(ws[p : p + 8])] > 1 for q in range(p, p + 8)}
        lost = sum(len(WORDS.findall(x)) for x in worded if holders[normal(x)] > 3)
        failed = len(ws) < 20 or 100 * len(repeat) > 30 * len(ws)
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(worded) - len(set(worded)), len(repeat), failed)
        assert (r["n_lost_words"], r["kept"]) == (lost, not failed and lost <= 0.5 * len(ws))
    assert line_rules.quality(docs_of(spark, ["a", "a", None], ids=[1, 1, None])).count() == 3


def test_quality_counts_distinct_documents(spark):
    words = " ".join(f"w{i}" for i in range(26))
    docs = docs_of(spark, [f"{words}\n{words.upper()} x"] * 12, ids=[1] * 12)
    assert {(r["n_lost_words"], r["kept"]) for r in line_rules.quality(docs).collect()} == {(0, True)}
    docs = docs_of(spark, [words] * 12, ids=[1] * 6 + [None] * 6)
    assert {(r["n_lost_words"], r["kept"]) for r in line_rules.quality(docs).collect()} == {(0, True)}
    docs = docs_of(spark, [words] * 12)
    assert {(r["n_lost_words"], r["kept"]) for r in line_rules.quality(docs).collect()} == {(26, False)}


def test_frequent_lines_go(spark):
    own = [" ".join(f"v{chr(97 + i)}{chr(97 + j)}" for j in range(24)) for i in range(15)]  # letters only, as digits are one zero
    docs = docs_of(spark, [f"Menu {i}  Home\n\n{x}" for i, x in enumerate(own)] + ["menu 5 home", None])
    out = line_rules.without_frequent_lines(docs.withColumnRenamed("h", "a.b"))
    assert out.columns == docs.withColumnRenamed("h", "a.b").columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: f"\n{x}" for i, x in enumerate(own)}


# url filters -------------------------------------------------------------------------------------------------------


def test_listed_rules(spark):
    cases = {
        "http://A.Example.NET/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://net/": ("net", "/", "net/", "block"),
        "https://net": ("net", "", None, "allow"),
        "x://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "x://b.example.com/de/#f": ("b.example.com", "/de/", "example.com/de/", "block"),
        "x://y.org/fr/?://z.net/": ("y.org", "/fr/", "org/fr/", "allow"),
        "no scheme.net/": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(cases)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, labels).collect()}
    assert found == dict(enumerate(cases.values()))


def test_mined_rules(spark):
    urls = [f"http://{'pills' if i % 5 == 0 else 'news'}.example.com/{'shop' if i % 3 == 0 else 'read'}/{i}" for i in range(150)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 15 == 0 else 1) for i in range(100)], "doc_id long, quality int")
    tokens = pages.join(labels, F.col("page_id") == F.col("doc_id")).select(url_rules.tokens_of(F.col("url")).alias("tokens"), (F.col("quality") == 0).alias("bad"))
    rules = {tuple(r["rule"]): r["confidence"] for r in url_rules.mine_rules(tokens, min_pages=3).collect()}
    seen = [(set(r["tokens"]), r["bad"]) for r in tokens.collect()]
    items = sorted(set().union(*(t for t, _ in seen)))
    every = {}
    for k in range(1, len(items) + 1):
        level = {}
        for combination in itertools.combinations(items, k):
            holds = [bad for t, bad in seen if set(combination) <= t]
            if sum(holds) >= 5 and sum(holds) / len(holds) >= 0.5:
                level[combination] = sum(holds) / len(holds)
        every |= level
        if k > 3 and not level:
            break
    want = {r: c for r, c in every.items() if not any(tuple(x for x in r if x != t) in every and every[tuple(x for x in r if x != t)] >= c for t in r)}
    assert rules == pytest.approx(want) and rules
    judged = {r["page_id"]: r["mined"] for r in url_rules.judge(pages, labels, min_pages=3).collect()}
    assert judged == {i: i % 15 == 0 for i in range(150)}


# learned operators -------------------------------------------------------------------------------------------------


def test_language_is_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = docs.select("doc_id", "lang")
    found = langid.identify(docs.drop("n_chars")).join(known, "doc_id").where("held_out")
    n, right = found.count(), found.where("lang = lang_pred").count()
    assert right >= 0.98 * n
    hidden = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), None).otherwise(F.col("lang")))
    assert found.select("doc_id", "lang_pred").exceptAll(langid.identify(hidden).select("doc_id", "lang_pred")).count() == 0


def test_language_by_a_plain_kernel(spark):
    """Scores of the whole operator against sets of n-grams, counted one pair at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 3000 AND doc_id < 300")
    rows = {r["doc_id"]: r for r in docs.collect()}
    found = {r["doc_id"]: r for r in langid.identify(docs).collect()}

    def grams(text):
        flat = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()).strip(" ")) + " "
        flat = (" " if not text[:1].isalpha() else "") + flat + (" " if not text[-1:].isalpha() else "")
        return {flat[i : i + n] for n in langid.NGRAMS for i in range(len(flat) - n + 1)}

    taught = sorted((r["lang"], i) for i, r in rows.items() if r["lang"] and r["text"] and not found[i]["held_out"] and any(map(str.isalpha, r["text"])))
    sets = {i: grams(r["text"]) for i, r in rows.items() if r["text"] and any(map(str.isalpha, r["text"]))}
    marks, order = [], spark.createDataFrame([(i,) for _, i in taught], "i long").select("i", F.xxhash64("i").alias("h")).collect()
    h = {r["i"]: r["h"] for r in order}
    for lang in sorted({x for x, _ in taught}):
        marks += sorted((i for x, i in taught if x == lang), key=lambda i: (h[i], i))[: langid.LANDMARKS_PER_LANGUAGE]
    kernel = lambda i: np.array([len(sets[i] & sets[m]) for m in marks], dtype=float)
    value, vector = np.linalg.eigh(np.array([kernel(m) for m in marks]))
    good = value > 1e-6 * value.max()
    phi = {i: kernel(i) @ (vector[:, good] / np.sqrt(value[good])) / len(sets[i]) ** 0.5 for i in sets}
    langs = sorted({x for x, _ in taught})
    x, y = np.array([phi[i] for _, i in taught]), np.array([langs.index(lang) for lang, _ in taught])
    w = 1 / np.bincount(y)[y]
    gram = x.T @ (x * w[:, None]) + langid.RIDGE * np.eye(x.shape[1])
    weights = np.linalg.solve(gram, x.T @ ((y[:, None] == np.arange(len(langs))) * w[:, None]))
    margin = {i: p @ weights for i, p in phi.items()}
    agree = sum(found[i]["lang_pred"] == langs[int(m.argmax())] for i, m in margin.items())
    assert agree >= 0.99 * len(margin)
    assert np.median([abs(found[i]["score"] - np.clip(m.max(), 0, 1)) for i, m in margin.items()]) < 0.02


def test_language_of_long_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    for lang in ("en", "fr"):
        texts = [r["text"] for r in docs.where(F.col("lang") == lang).where("n_chars > 1000").orderBy("doc_id").limit(40).collect()]
        (pred, whole), score = model.predict([texts[0], "\n".join(texts) * 10]), None
        assert pred == [lang, lang] and whole[1] > 0.8 * whole[0]


def test_language_of_odd_texts(spark):
    docs = docs_of(spark, [None, "", "123 !?", "the the and of", "the of and in", "x" * 600_000, "日本"] * 2)
    found = langid.identify(docs).collect()
    assert len(found) == 14 and all(0 <= r["score"] <= 1 for r in found)
    assert {r["doc_id"] % 7 for r in found if r["lang_pred"] == "und"} == {0, 1, 2}
    empty = docs_of(spark, [])
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_is_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = cotraining.classify(docs, labels).join(labels, "doc_id").where("held_out")
    good, bad = found.where("quality = 1"), found.where("quality = 0")
    assert good.where("kept").count() >= 0.95 * good.count()
    assert bad.where("kept").count() <= 0.35 * bad.count()


def plain_co_training(docs, labels, scored):
    """Scores by id of the two views, fitted and exchanged over whole lists; docs: (id, text, source, lang)."""
    views = {}
    for i, text, source, lang in docs:
        data = (text or "").encode()
        pairs = Counter(((a << 8 | b) * 0x9E3779B1 % 2**32) >> 22 for a, b in itertools.pairwise(data))
        x = np.zeros(1024)
        for slot, n in pairs.items():
            x[slot] = min(round(510 * (n / (len(data) - 1)) ** 0.5), 255)
        m = np.zeros(112)
        m[[zlib.crc32(source.encode()) % 64, 64 + zlib.crc32(lang.encode()) % 16, 80 + len(text or "").bit_length()]] = 1
        views[i] = (x, m)
    sample = sorted((i for i in labels if zlib.crc32(str(i).encode()) % 4 != 2), key=lambda i: scored[i])
    pool = [views[i] for i in sorted(views) if i not in labels]
    prior = sum(labels[i] for i in sample) / len(sample)
    handed = {}

    def direction(v, taught):
        by_class = [np.array([views[i][v] for i in taught if labels[i] == c]) for c in (0, 1)]
        apart = np.vstack([x - x.mean(axis=0) for x in by_class])
        spread = apart.T @ apart / len(apart)
        spread += cotraining.RIDGE * np.trace(spread) / len(spread) * np.eye(len(spread))
        mean = []
        for c in (0, 1):
            more, n = handed.get((v, c), []), len(by_class[c])
            part = min(len(more), n) / (n + min(len(more), n))
            mean.append(by_class[c].mean(axis=0) * (1 - part) + (np.mean(more, axis=0) * part if more else 0))
        return np.linalg.solve(spread, mean[1] - mean[0])

    for _ in range(cotraining.ROUNDS + 1):
        scores = []
        for v in (0, 1):
            apart = [direction(v, [i for k, i in enumerate(sample) if k % 3 != f]) for f in range(3)]
            slope, constant = cotraining.fit_logistic(np.array([[views[i][v] @ apart[k % 3]] for k, i in enumerate(sample)]), np.array([labels[i] for i in sample]))
            scores.append(lambda x, w=direction(v, sample), v=v, slope=slope, constant=constant: slope * (x[v] @ w) + constant)
        even = np.log(prior / (1 - prior))
        handed = {(1 - v, c): [x[1 - v] for x in pool if (scores[v](x) >= np.log(9) + max(even, 0) if c else scores[v](x) <= min(even, 0) - np.log(9))] for v in (0, 1) for c in (0, 1)}
    return {i: tuple(1 / (1 + np.exp(-scores[v](x))) for v in (0, 1)) for i, x in views.items()}


def test_quality_by_plain_co_training(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    doubled = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    known = {r["doc_id"]: int(r["quality"] > 0) for r in labels.collect() if r["quality"] is not None}
    order = {r["doc_id"]: r["h"] for r in doubled.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    want = plain_co_training([(r["doc_id"], r["text"], r["source"] or "", r["lang"] or "") for r in doubled.fillna("", ["source", "lang"]).collect()], known, order)
    for r in cotraining.classify(doubled.fillna("", ["source", "lang"]), labels).collect():
        assert np.allclose((r["text_score"], r["meta_score"]), want[r["doc_id"]], atol=1e-6)


def test_quality_of_odd_texts(spark):
    docs = docs_of(spark, [None, "", "a b", "a b", "x" * 3_000_000], ids=[None, 1, 2, 2, 3])
    for rows in ([], [(2, 1)], [(i, i % 2) for i in range(50)], [(None, 1), (2, None)]):
        found = cotraining.classify(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()
        assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found)
    assert cotraining.classify(docs_of(spark, []), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# all ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("make", [lambda s: docs_of(s, []), lambda s: docs_of(s, [None, None], ids=[None, None])])
def test_empty_and_null_tables(spark, make):
    docs = make(spark)
    n = docs.count()
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert lines.line_digest(docs).count() == n
    assert bpe.round_trip_digest(docs, vocabulary).count() == n
    assert packing.pack(docs).count() == n
    assert substring.removal_digest(docs).count() == n
    assert simhash.near_duplicates(docs).count() == n
    assert line_rules.quality(docs).count() == n
    assert langid.with_language(docs).count() == 0


def word_sets(text):
    ws = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def plain_pipeline(docs, scores):
    """The stages on {id: text} of given languages and the scores of the language model; near copies are those of five words
    and similarity 0.8."""
    docs = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t) and (scores[i] >= langid.MIN_SCORE or len(t) <= langid.SHORT_CHARS)}
    cut = kept_lines(docs, lines.MIN_LINES)
    docs = {i: t for i, (t, gone) in cut.items() if not gone or WORDS.search(t)}
    sets = {i: word_sets(t) for i, t in docs.items()}
    roots = components_of(list(docs), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    first = {}
    for i in sorted(docs):
        first.setdefault(roots[i], i)
    docs = {i: docs[i] for i in first.values()}
    done = kept_words(docs, substring.WINDOW)
    return {i: n - gone for i, (n, gone, _) in done.items() if not gone or gone < n}


def test_pipeline(spark, tmp_path):
    texts = corpus(23, 80)
    docs_of(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    total = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        total[r["doc_id"]] += r["n_tokens"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    scores = {r["doc_id"]: r["score"] for r in langid.identify(docs).collect()}
    assert dict(total) == plain_pipeline(dict(enumerate(texts)), scores)
    one = texts.index("one")
    assert one in total and scores[one] < langid.MIN_SCORE  # short, with a given language
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    frame = queries.QUERIES[name](spark, DATA)
    columns = ", ".join(f'"{c}"' for c in sorted(frame.columns))
    want = con.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, frame.select(*sorted(frame.columns)).collect())) == Counter(want)
