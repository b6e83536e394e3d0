"""Work that must stay linear, and equality with the plain forms."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docprep.functions import text as X
from docprep.operators import quality, requests


def plain_strip(text):
    text = re.sub("<img[^>]*>", "", text)
    for name in ("picture", "svg"):
        text = re.sub(f"(?is)<{name}[^>]*>.*?</{name}>", "", text)
    return text


def test_images_of_odd_texts(spark):
    rng = random.Random(1)
    parts = ["<svg", "<SVG>", "</svg>", "</Svg>", ">", "<img", "<img>", "<IMG>", "<picture ", "</picture>", "x", "\n", "é", "İ", "<", "</svg", " a='b'"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 14))) for _ in range(3000)]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.strip_images(F.col("t")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in found} == {i: plain_strip(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("text", ["<svg>" * 200_000, "<picture>" * 100_000, "<img" * 250_000, "<svg " * 200_000 + "</svg>", "<svg></svg>" * 90_000 + "<svg" * 1000])
def test_images_in_a_long_text(spark, text):
    rows = spark.createDataFrame([(text,)], "t string").repartition(1)
    rows.select(F.length(X.strip_images(F.lit("<svg></svg>")))).collect()
    began = time.time()
    found = rows.select(X.strip_images(F.col("t")).alias("t")).collect()[0]["t"]
    assert time.time() - began < 5
    assert found == (text if "</" not in text else "<svg" * 1000 if "><" in text else text)


def test_terms_of_a_large_glossary(spark):
    rng = random.Random(2)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{i}" for i in range(2000)]
    chunks = [(1, i, " ".join(rng.choices(words, k=20)), " ".join(rng.choices(words, k=20))) for i in range(300)]
    pairs = spark.createDataFrame([*chunks, (2, 0, "ab 日本語 \U0001f600!", "x"), (2, 1, None, None), (2, 2, "", "")], "doc_id long, chunk_no int, source string, target string")
    given = [(1, w, w) for w in words] + [(2, "b", "x"), (2, "日本", "y"), (2, "\U0001f600!", None), (2, "", "x"), (2, None, "x"), (2, "ab 日", "x"), (2, "zzz", "x")]
    terms = spark.createDataFrame(given, "doc_id long, source_term string, target_term string")
    found = quality.glossary_compliance(pairs, terms)
    want = set()
    for d, c, s, t in pairs.collect():
        want |= {(d, c, a, b, b is not None and b in t) for e, a, b in given if e == d and s is not None and a is not None and a in s}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want
    met = [p for p in str(found._jdf.queryExecution().executedPlan()).splitlines() if "Join" in p]
    assert met and all("gram" in p for p in met)


def test_what_chunks_carry(spark):
    rng = random.Random(3)
    some = lambda: rng.choice([None, [], [None], [""], ["a: b"], ["x", None, "é\n日"], ["\U0001f600", "z"]])
    rows = [(d, i, f"s{i}" * rng.randrange(3), rng.choice([None, "", f"t{i}"]), some(), some(), rng.choice([None, "", "so", "two\nlines"])) for d in range(40) for i in range(d % 16)]
    start = [(d, *rng.choices([None, "", "無", "first: one", "a\nb"], k=2)) for d in range(30)]
    names = "doc_id long, chunk_no int, source_text string, translated string, new_terms array<string>, new_characters array<string>, summary string"
    chunks, initial = spark.createDataFrame(rows, names), spark.createDataFrame([(d, None, g, c) for d, g, c in start], "doc_id long, style string, glossary string, characters string")
    replies = chunks.drop("source_text").where("chunk_no <> 7")
    begin, want, saved = {d: (g, c) for d, g, c in start}, {}, {}
    for d, i, *_ in rows:
        before = [r for r in rows if r[0] == d and r[1] < i and r[1] != 7]
        lines = [[x for x in [begin.get(d, (None, None))[j]] if x and x != "無"] + [t for r in before for t in r[4 + j] or [] if t is not None] for j in (0, 1)]
        told = "\n".join(f"- {r[6]}" for r in before if r[6]).split("\n")[-10:]
        want[d, i] = ("\n".join(lines[0]), "\n".join(lines[1]), "\n".join(told))
        saved[d, i] = "".join(f"{r[3]}\n\n" for r in rows if r[0] == d and r[1] <= i and r[3] is not None)
    sources = chunks.select("doc_id", "chunk_no", "source_text")
    found = requests.request_context(sources, replies, initial)
    assert {(r["doc_id"], r["chunk_no"]): (r["glossary"], r["characters"], r["plot_summary"]) for r in found.collect()} == want
    assert {(r["doc_id"], r["chunk_no"]): r["saved_text"] for r in requests.running_translated_text(chunks).collect()} == saved
    few = chunks.where("chunk_no IN (3, 8)")
    for f, j in ((requests.running_glossary, 0), (requests.running_characters, 1)):
        assert {tuple(r)[:2]: r[2] for r in f(replies, initial, wanted=few).collect()} == {k: v[j] for k, v in want.items() if k[1] in (3, 8)}
    assert {tuple(r)[:2]: r[2] for r in requests.rolling_summary(replies).collect()} == {k: v[2] for k, v in want.items() if k[1] != 7}
    assert requests.request_context(sources, replies, initial, wanted=few).count() == sum(k[1] in (3, 8) for k in want)


def test_terms_of_a_document_of_many_chunks(spark):
    """20,000 chunks of four terms each: what all of them see together would be 16 GB; the last ones' is 16 MB."""
    replies = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("chunk_no"), F.array(*[F.concat(F.lit(f"term number {j} of "), "id") for j in range(4)]).alias("new_terms"))
    initial = spark.createDataFrame([(1, "first: one")], "doc_id int, glossary string")
    wanted = replies.where("chunk_no >= 19990")
    seen = requests.running_glossary(replies, initial, wanted)
    assert "collect_list" not in "".join(x for x in str(seen._jdf.queryExecution().executedPlan()).splitlines() if "Window" in x)
    began = time.time()
    found = {r["chunk_no"]: r["n"] for r in seen.select("chunk_no", F.size(F.split("glossary", "\n")).alias("n")).collect()}
    assert time.time() - began < 20
    assert found == {i: 4 * i + 1 for i in range(19_990, 20_000)}


def test_only_runs_that_begin_a_term_are_rows(spark):
    """The rows that meet the terms are those of their first characters, not those of all characters of a source."""
    pairs = spark.createDataFrame([(1, 0, "abcdefgh xyz", "T")], "doc_id long, chunk_no int, source string, target string")
    terms = spark.createDataFrame([(1, "cde", "T"), (1, "", "U"), (1, "zzz", "T"), (2, "abc", "T")], "doc_id long, source_term string, target_term string")
    found = quality.glossary_compliance(pairs, terms)
    assert sorted(map(tuple, found.collect())) == [(1, 0, "", "U", False), (1, 0, "cde", "T", True)]
    generated = []

    def visit(node):
        if node.nodeName() == "Generate":
            generated.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            visit(node.children().apply(k))
        if node.nodeName() == "AdaptiveSparkPlan":
            visit(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            visit(node.plan())

    visit(found._jdf.queryExecution().executedPlan())
    assert generated == [2]
