"""Where an operator once did less than its whole job: plain versions and cases that the shorter form failed."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docprep.llm import components, minmax, substring
from test_llm import WORDS, components_of, corpus, docs_of


def shingles(text):
    ws = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def changed_copies(seed):
    """Texts with copies in which a few words are others, from near equal to far apart."""
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 120))]
        for changes in (0, 0, 1, 2, 3, 5):
            copy = list(words)
            for p in rng.sample(range(len(copy)), changes):
                copy[p] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("dense, block", [(64, 512), (2, 5)])
def test_near_copies_of_the_stage(spark, monkeypatch, dense, block):
    monkeypatch.setattr(minmax, "DENSE_BUCKET", dense)
    monkeypatch.setattr(minmax, "BLOCK", block)
    texts = [*changed_copies(4), *corpus(5)]
    sets = [shingles(t) for t in texts]
    roots = components_of(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    least = {}
    for i in range(len(texts)):
        least.setdefault(roots[i], i)
    kept = corpus_pipeline.drop_near_copies(spark, docs_of(spark, texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert kept.columns == docs_of(spark, []).columns


def test_near_copies_of_one_id_and_null_ids(spark):
    docs = docs_of(spark, ["a b c d e", "A b c d e", "z", None, "", "q", "a b c d e"], ids=[2, 1, None, 5, 4, 2, None])
    assert Counter((r["doc_id"], r["text"]) for r in minmax.keep_first(docs, shingle=5, percent=80).collect()) == {(1, "A b c d e"): 1, (None, "z"): 1, (4, ""): 1, (2, "q"): 1, (None, "a b c d e"): 1}


def test_single_lines_of_the_stage(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = docs_of(spark, [f"a\n{long}\nb", f"c\n{long}\nd", long, "c"])
    kept = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {0: f"a\n{long}\nb", 1: "c\nd"}


def test_language_stage_decides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(500)
    odd = [(-1, "Это русский текст для проверки модели, которую никто не учил", "en"), (-2, "日本語の文章です。これは学習されていない", None)]
    known = docs.where("n_chars > 500").orderBy("doc_id").limit(1)
    hidden = known.select(F.lit(-3).cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    more = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in odd], docs.schema)
    out = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(more).unionByName(hidden), "").collect()}
    assert not {-1, -2} & set(out)
    assert out[-3] == known.first()["lang"]
    clean = [r["doc_id"] for r in docs.where("n_chars > 200").collect()]
    assert set(clean) <= set(out)


@pytest.mark.parametrize("texts", [[], [None, None]])
def test_pipeline_of_empty_and_null_tables(spark, tmp_path, texts):
    docs = docs_of(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= len(texts)


def test_stars_take_no_round(spark, monkeypatch):
    """What links of one-block clusters give are stars already, and the components of stars are read off."""
    written, write = [], components.Scratch.write
    monkeypatch.setattr(components.Scratch, "write", lambda self, name, *a, **k: (written.append(name), write(self, name, *a, **k))[1])
    edges = [(9, 1), (1, 4), (7, 1), (3, 2), (8, 2)]
    found = {tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {(1, 1), (9, 1), (4, 1), (7, 1), (2, 2), (3, 2), (8, 2)} and written == ["e0", "ends0"]
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join([*(f"x{i}" for i in range(n)), *words[n:]]) for n in (0, 5, 10, 15, 20)]
    written.clear()
    assert [r["doc_id"] for r in minmax.keep_first(docs_of(spark, texts)).collect()] == [0]
    assert written[written.index("links") :] == ["links", "e0", "ends0"]
    side = minmax._Side([5, 3, 4, 9, 7], [bytes(160)] * 5, ["a b c d", "A b c d", "x y z", "a b c D", "q r s"], 3)
    assert sorted(minmax.linked(side, side, 85)) == [(3, 5), (3, 9)]


def test_language_has_one_pool_of_workers(spark, monkeypatch):
    """Rows that the driver sends start Python workers apart from those of Arrow batches, which stay beside them."""
    docs = docs_of(spark, [f"{word} {word}s text {i}" for i in range(20) for word in ("house", "baum")]).select("doc_id", "text", F.element_at(F.array(F.lit("en"), F.lit("de")), (F.col("doc_id") % 2 + 1).cast("int")).alias("lang"))
    expected = {r["doc_id"]: r["lang"] for r in docs.collect()}

    def refuse(*args, **kwargs):
        raise AssertionError("rows sent by the driver")

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    out = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert out == expected


def test_passages_cut_each_text_once(spark):
    same = " ".join(f"w{i}" for i in range(20))
    docs = docs_of(spark, [f"{same} a b", f"c {same}", same, None, "x"])
    out = corpus_pipeline.drop_repeated_passages(spark, docs, "")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {r["doc_id"]: r["text"] for r in substring.without_repeats(docs).collect()} == {0: f"{same} a b", 1: "c", 3: None, 4: "x"}
