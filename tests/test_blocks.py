"""Block structure and HTML of Markdown against HTML written by hand."""

import time

import pytest

from docprep.operators import blocks, chapters, quality

CASES = {
    "# Hello": "<h1>Hello</h1>\n",
    "Line 1\nLine 2\n\n---": "<p>Line 1\nLine 2</p>\n<hr>\n",
    "Head\n====\ntext": "<h1>Head</h1>\n<p>text</p>\n",
    "two\nlines\n---\n---": "<h2>two\nlines</h2>\n<hr>\n",
    "```\n# code\n```\nHead\n---": "<pre><code># code\n</code></pre>\n<h2>Head</h2>\n",
    "~~~py\n```\n~~~ no\n~~~~\nx": '<pre><code class="language-py">```\n~~~ no\n</code></pre>\n<p>x</p>\n',
    "````\n```\n````": "<pre><code>```\n</code></pre>\n",
    "```\nopen <b>": "<pre><code>open &lt;b&gt;\n</code></pre>\n",
    "* a\n* **b**": "<ul>\n<li>a</li>\n<li><strong>b</strong></li>\n</ul>\n",
    "- a\n  - b\n    - c\n- d": "<ul>\n<li>a<ul>\n<li>b<ul>\n<li>c</li>\n</ul>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n",
    "1. a\n2. b\n- c": "<ol>\n<li>a</li>\n<li>b</li>\n</ol>\n<ul>\n<li>c</li>\n</ul>\n",
    "- a\nlazy\n---": "<ul>\n<li>a\nlazy</li>\n</ul>\n<hr>\n",
    "a\n===\n---\nb\n===\n===": "<h1>a</h1>\n<hr>\n<h1>b</h1>\n<p>===</p>\n",
    "> a\n> b\n>\n> c": "<blockquote>\n<p>a\nb</p>\n<p>c</p>\n</blockquote>\n",
    "#### deep ##\n#no": "<h4>deep</h4>\n<p>#no</p>\n",
    "#\n\n###### six": "<h1></h1>\n<h6>six</h6>\n",
    "a *b* **c** ***d*** ~~e~~ _f_ __g__ h_i_j": "<p>a <em>b</em> <strong>c</strong> <em><strong>d</strong></em> <del>e</del> <em>f</em> <strong>g</strong> h_i_j</p>\n",
    "**a *b* c** 2 * 3 * 4": "<p><strong>a <em>b</em> c</strong> 2 * 3 * 4</p>\n",
    "`a*b*<c>` \\*d\\* `open": "<p><code>a*b*&lt;c&gt;</code> *d* `open</p>\n",
    '[l](http://e/?a=1&b=2 "t") ![i](x.png)z': '<p><a href="http://e/?a=1&amp;b=2">l</a> z</p>\n',
    "hard  \nbreak\\\nhere": "<p>hard<br>\nbreak<br>\nhere</p>\n",
    "* * *\n_ _ _": "<hr>\n<hr>\n",
    "": "",
    " \n\t": "",
}


def test_html(spark):
    rows = [(i, 0, "t", text) for i, text in enumerate(CASES)]
    found = {r["doc_id"]: r["html"] for r in chapters.render_blocks(spark.createDataFrame(rows, "doc_id long, chapter_no int, title string, raw string")).collect()}
    assert [(text, found[i]) for i, text in enumerate(CASES)] == list(CASES.items())


@pytest.mark.parametrize(
    "text, want",
    [
        ("```\n# no\n```\nYes\n===\na\n# B #\n#### c\nD\n-", [("前言", "```\n# no\n```"), ("Yes", "Yes\n===\na"), ("B", "# B #\n#### c"), ("D", "D\n-")]),
        ("> # no\n\n- # no\n\n  two\nlines  \n---", [("前言", "> # no\n\n- # no\n"), ("two\nlines", "  two\nlines  \n---")]),
        ("~~~\n```\n# no", [("前言", "~~~\n```\n# no")]),
        ("# a\n\n# \n\n ", [("a", "# a\n"), ("", "# \n\n ")]),
    ],
)
def test_chapters(spark, text, want):
    found = chapters.split_chapters(spark.createDataFrame([(1, text)], "doc_id long, markdown string")).orderBy("chapter_no").collect()
    assert [(r["title"], r["raw"]) for r in found] == want


def test_long_documents(spark):
    """Many fences, items and lines, and what is never closed."""
    texts = ["```\nx\n```\n" * 3000, "- a\n  - b\n" * 1500, "*a " * 100_000, "[" * 100_000, "`" * 99_999, "\n".join(["> q"] * 20_000)]
    docs = spark.createDataFrame([(i, 0, "", t) for i, t in enumerate(texts)], "doc_id long, chapter_no int, title string, raw string")
    began = time.time()
    assert chapters.render_blocks(docs).count() == len(texts)
    sizes = {r["doc_id"]: len(r["html"]) for r in chapters.render_blocks(docs).collect()}
    assert sizes[0] == 3000 * len("<pre><code>x\n</code></pre>\n") and sizes[1] == len("<ul>\n</ul>\n") + 1500 * len("<li>a<ul>\n<li>b</li>\n</ul>\n</li>\n")
    assert time.time() - began < 60


def test_kinds(spark):
    found = blocks.block_lines(spark.createDataFrame([(1, "a\n\n# b\n- c\n> d\n```\ne\n```")], "doc_id long, t string"), ["doc_id"], "t").orderBy("n").collect()
    assert [(r["kind"], r["block"]) for r in found] == [("text", 1), ("blank", 1), ("atx", 2), ("item", 3), ("quote", 4), ("open", 5), ("code", 5), ("close", 5)]


@pytest.mark.parametrize(
    ("source", "target", "edits", "first"),
    [
        ("# a\n\n- b\n- c\n\nd", "# A\n\n- B\n- C\n\nD\nE", 0, None),
        ("- b\n\nd", "D\n\n- B", 2, 0),  # equal counts, other order
        ("```\n# a\n- b\n```\n\nx", "```\nA\n```\n\nX", 0, None),  # what is in a fence is no block
        ("# a\n\nb\n\nc", "# A\n\nB", 1, 2),
        ("# a\n\nb", "## A\n\nB", 1, 0),
        ("1. a\n2. b", "- A\n- B", 2, 0),
        ("a\n===\n\n> b\n\n***", "# A\n\n> B\n\n---", 0, None),
        ("", "", 0, None), (None, None, 0, None), (None, "a", 1, 0), ("a\n\nb", None, 2, 0), (" \n", "", 0, None),
    ],
)
def test_parity(spark, source, target, edits, first):
    pairs = spark.createDataFrame([(1, 2, source, target)], "doc_id long, chunk_no int, source string, target string")
    [found] = quality.markdown_parity(pairs).collect()
    assert (found["doc_id"], found["chunk_no"], found["edits"], found["first_edit"], found["parity"]) == (1, 2, edits, first, edits == 0)


def test_lines_are_read_once(spark):
    """No second reading of the texts for their fences, and no second one of the chapters for their titles."""
    docs = spark.createDataFrame([(1, "# a\nx"), (2, "b")], "doc_id long, markdown string").repartition("doc_id")
    made = chapters.split_chapters(docs)
    plan = chapters.render_blocks(made)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Join") == 1


def test_code_of_fences_by_lines(spark):
    text = "a\n```\n\n~~~\n````\nb\n~~~ x\nc\n```\n~~~\nd"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "```"), (4, None), (5, "x")], "doc_id long, markdown string")
    found = {}
    for r in sorted(blocks.block_lines(docs, ["doc_id"], "markdown").collect(), key=lambda r: (r["doc_id"], r["n"])):
        found.setdefault(r["doc_id"], []).append(r["kind"])
    assert found[1] == ["text", "open", "code", "code", "close", "text", "open", "code", "code", "close", "text"]
    assert (found[2], found[3], found[5], 4 in found) == (["blank"], ["open"], ["text"], False)
