"""Sentences, chunks and chapters on hand-made cases and random strings, against plain restatements of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docprep.functions.text import split_sections, split_sentences
from docprep.operators.chapters import split_chapters
from docprep.operators.chunking import chunk_documents

SENTENCE = re.compile("[^.!?。！？]+[.!?。！？]+[\"'」』]?\\s*")
BLANK = "\u0009\u000a\u000b\u000c\u000d       　﻿" + "".join(map(chr, range(0x2000, 0x200B)))


def chunks_of(md, limit):
    """The packing rules one piece at a time."""
    done, held = [], ""

    def room(piece):
        nonlocal held
        if held and len(held) + len(piece) > limit:
            done.append(held.strip(BLANK))
            held = ""

    cuts = [m.start() for m in re.finditer("\n#{1,3} ", md) if m.start()]
    for part in (md[a:b] for a, b in zip([0, *cuts], [*cuts, len(md)], strict=True)):
        room(part)
        if len(part) <= limit:
            held += ("\n" if held and not held.endswith("\n") else "") + part
            continue
        for paragraph in re.split("\n\n+", part):
            room(paragraph)
            if len(paragraph) <= limit:
                held += ("\n\n" if held else "") + paragraph
                continue
            for sentence in SENTENCE.findall(paragraph) or [paragraph]:
                room(sentence)
                held += sentence
    return done + ([held.strip(BLANK)] if held.strip(BLANK) else [])


def of(spark, texts, column):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column.alias("x"))
    return [r["x"] for r in sorted(frame.collect(), key=lambda r: r["i"])]


@pytest.mark.parametrize("limit", [12, 30])
def test_chunks_follow_the_rules(spark, limit):
    rng = random.Random(limit)
    texts = ["".join(rng.choice("ab. !\n\n#  。」　") for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += ["\n\n".join("## x\n" + "word. " * rng.randrange(9) for _ in range(4)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, markdown string")
    found = {}
    for r in chunk_documents(docs, limit=limit).collect():
        found.setdefault(r["doc_id"], {})[r["chunk_no"]] = r["source_text"]
    for i, text in enumerate(texts):
        got = found.get(i, {})
        assert [got[k] for k in sorted(got)] == chunks_of(text, limit), repr(text)


def test_chunk_edges(spark):
    cases = {0: "", 1: " \n", 2: "x" * 3500, 3: "x" * 5000, 4: None, 5: "\n\nstart"}
    docs = spark.createDataFrame(list(cases.items()), "doc_id long, markdown string")
    assert sorted((r["doc_id"], r["n_chars"]) for r in chunk_documents(docs).collect()) == [(2, 3500), (3, 5000), (5, 5)]


def test_sentences(spark):
    texts = ["no end", "...Lead. tail", 'He said "Hi." . Yo.', "?!", "A. B! C", ""]
    assert of(spark, texts, split_sentences(F.col("t"))) == [SENTENCE.findall(t) or [t] for t in texts]
    assert ["".join(x) for x in of(spark, texts, split_sentences(F.col("t"), "lossless"))] == texts
    with pytest.raises(ValueError):
        split_sentences(F.col("t"), "other")


def test_sections(spark):
    texts = ["\n# a\n## b", "x\n#### deep\n# y", "```\n# code\n```"]
    assert of(spark, texts, split_sections(F.col("t"))) == [["\n# a", "\n## b"], ["x\n#### deep", "\n# y"], ["```", "\n# code\n```"]]


def test_chapters(spark):
    cases = {1: "no heading", 2: "pre\n# A #\nbody\n#### deep\n### B", 3: "Title\n=====\nx", 4: "```\n# no\n```\n# yes", 5: "  \n", 6: "# only"}
    docs = spark.createDataFrame(list(cases.items()), "doc_id long, markdown string")
    found = {}
    for r in sorted(split_chapters(docs).collect(), key=lambda r: (r["doc_id"], r["chapter_no"])):
        found.setdefault(r["doc_id"], []).append((r["title"], r["raw"]))
    assert found == {
        1: [("前言", "no heading")],
        2: [("前言", "pre"), ("A", "# A #\nbody\n#### deep"), ("B", "### B")],
        3: [("Title", "Title\n=====\nx")],
        4: [("前言", "```\n# no\n```"), ("yes", "# yes")],
        6: [("only", "# only")],
    }
