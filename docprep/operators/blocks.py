"""The block structure of Markdown: lines with their kind and block, shared by chapters and rendering.

Lines become rows. What encloses them is found by two folds with a stack of what is open: fences, over the lines that look
like fence marks only, and lists, over the items of one run of items. All else compares a line with its neighbours in windows
over the document, so the rows are shuffled once. The subset: fenced code, headings of both forms, rules, quotes, nested
lists, paragraphs with lazy lines; inside them code spans, emphasis, deletion, links, hard breaks. HTML in the text is shown
as text. Code by indentation is not read, nor are further paragraphs of a list item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docprep.functions.text import escape_html, let, trim_ws

from .ordered import in_order

_FENCE = "^ {0,3}(`{3,}(?=[^`]*\\z)|~{3,})"
_ATX = "^ {0,3}#{1,6}(?=[ \t]|\\z)"
_RULE = "^ {0,3}(?:(?:-[ \t]*){3,}|(?:_[ \t]*){3,}|(?:[*][ \t]*){3,})\\z"
_QUOTE = "^ {0,3}> ?"
_ITEM = "^ *(?:[-*+]|[0-9]{1,9}[.)])(?:[ \t]+|\\z)"
_UNDER = "^ {0,3}(?:=+|-+)[ \t]*\\z"
#: Stand-ins, from the private use area, for marks that are not to be read.
_MARKS, _HELD = "*_[]~!", ""


def _fence_edges(lines: Column) -> Column:
    """`n` and `edge` (1 opens, -1 closes) of the lines that bound fenced code: a fence ends at a mark of its own kind, at
    least as long and with nothing after it."""
    marks = F.filter(F.transform(lines, lambda x, n: F.struct(n.alias("n"), F.regexp_extract(x, _FENCE, 1).alias("mark"), F.regexp_extract(x, _FENCE + "[ \t]*\\z", 1).alias("bare"))), lambda m: m["mark"] != "")
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<struct<n:int,edge:int>>").alias("edges"))

    def step(s: Column, m: Column) -> Column:
        opens, closes = s["open"] == "", m["bare"].startswith(s["open"]) & (s["open"] != "")
        edge = F.struct(m["n"].alias("n"), F.when(opens, 1).otherwise(-1).alias("edge"))
        added = F.when(opens | closes, F.concat(s["edges"], F.array(edge))).otherwise(s["edges"])
        return F.struct(F.when(opens, m["mark"]).when(closes, "").otherwise(s["open"]).alias("open"), added.alias("edges"))

    return F.aggregate(marks, start, step, lambda s: s["edges"])


def _fenced(lines: Column) -> Column:
    """For each line `open`, `code` or `close` if it is part of fenced code, else null; the lines from each edge to the next
    are made at once, so that this is linear in the lines."""
    none = F.lit(None).cast("string")

    def upto(edges: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            before = F.coalesce(F.get(edges, i - 1)["n"], F.lit(-1))
            return F.concat(F.array_repeat(F.when(e["edge"] == -1, "code"), e["n"] - before - 1), F.array(F.when(e["edge"] == 1, "open").otherwise("close")))

        last = F.get(edges, F.size(edges) - 1)
        rest = F.array_repeat(F.when(last["edge"] == 1, "code"), F.size(lines) - 1 - last["n"])
        return F.when(F.size(edges) == 0, F.array_repeat(none, F.size(lines))).otherwise(F.concat(F.flatten(F.transform(edges, one)), rest))

    return let(_fence_edges(lines), upto)


def begins(kind: Column) -> Column:
    """Whether a line of this kind, under one of the kind `above`, begins a block; text goes on with a paragraph, an item or
    a quote."""
    lazy = F.coalesce(F.col("above").isin("text", "item", "quote"), F.lit(False))
    quoted = F.coalesce(F.col("above") == "quote", F.lit(False))
    return kind.isin("atx", "rule", "item", "open") | ((kind == "quote") & ~quoted) | ((kind == "text") & ~lazy)


def block_lines(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The keys, `n`, `line`, `kind`, `block`, `level` for each line: kind is one of blank, atx, under, rule, quote, item,
    text, open, code, close; a block begins at its first line and blank lines go with the block before."""
    # an outer generator, so that Spark does not split the text once more for a filter on the array
    split = docs.select(*keys, F.explode_outer(F.array(F.split(text, "\n", -1))).alias("lines"))
    rows = split.select(*keys, F.posexplode_outer(F.arrays_zip("lines", _fenced(F.col("lines")).alias("fenced"))).alias("n", "x"))
    met = rows.select(*keys, "n", F.col("x.lines").alias("line"), F.col("x.fenced").alias("fenced")).where("line IS NOT NULL")
    doc = Window.partitionBy(*keys).orderBy("n")
    line = F.col("line")
    shape = F.when(F.col("fenced").isNotNull(), F.col("fenced")).when(~line.rlike("\\S"), "blank")
    shape = shape.when(line.rlike(_ATX), "atx").when(line.rlike(_RULE), "rule").when(line.rlike(_QUOTE), "quote").when(line.rlike(_ITEM), "item").otherwise("text")
    seen = met.withColumn("shape", shape).withColumn("above", F.lag("shape").over(doc))
    own = F.when(begins(F.col("shape")), F.col("shape"))  # of the block that a line belongs to
    seen = seen.withColumn("owner", F.last(own, ignorenulls=True).over(doc.rowsBetween(Window.unboundedPreceding, -1)))
    paragraph = (F.col("above") == "text") & (F.col("owner") == "text") & ~F.lag("line").over(doc).rlike("^ {0,3}=+[ \t]*\\z")
    under = paragraph & F.col("shape").isin("text", "rule", "item") & line.rlike(_UNDER)
    seen = seen.withColumn("kind", F.when(under, "under").otherwise(F.col("shape"))).withColumn("above", F.lag("kind").over(doc))
    level = F.when(F.col("kind") == "atx", F.char_length(F.regexp_extract("line", "^ *(#+)", 1))).when(F.col("kind") == "under", F.when(line.contains("="), 1).otherwise(2))
    numbered = seen.withColumn("block", F.sum(begins(F.col("kind")).cast("int")).over(doc)).withColumn("level", level)
    return numbered.select(*keys, "n", "line", "kind", "block", "level", begins(F.col("kind")).alias("begins"))


def block_kinds(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The keys and `kinds`, a letter for each block in order: 1 to 6 a heading, p paragraph, c code, q quote, r rule, u and o an
    item of a list without and with numbers. Texts without a block have no row."""
    first = F.min_by(F.struct("kind", F.col("line").rlike("^ *[0-9]").alias("numbered")), "n").alias("b")
    blocks = block_lines(docs, keys, text).where("block > 0").groupBy(*keys, "block").agg(first, F.max("level").alias("level"))
    kind = F.col("b.kind")
    letter = F.when(F.col("level").isNotNull(), F.col("level").cast("string")).when(kind == "item", F.when(F.col("b.numbered"), "o").otherwise("u"))
    letter = letter.when(kind == "open", "c").when(kind == "quote", "q").when(kind == "rule", "r").otherwise("p")
    return blocks.select(*keys, "block", letter.alias("letter")).groupBy(*keys).agg(F.array_join(in_order("letter", "block"), "").alias("kinds"))


def heading_text(line: Column) -> Column:
    """A heading line without its marks."""
    return trim_ws(F.regexp_replace(F.regexp_replace(line, "^ {0,3}#{1,6}", ""), "(?:^|[ \t]+)#+[ \t]*\\z", ""))


def _paired(text: Column, mark: str, tag: str) -> Column:
    """Text between two equal marks, without the mark itself or white space next to the inner sides, in a tag."""
    one = mark.strip("[]")[-1]
    return F.regexp_replace(text, f"(?<![{one}]){mark}(?![\\s{one}])([^{one}]+)(?<![\\s]){mark}(?![{one}])", f"<{tag}>$1</{tag}>")


#: What a text must hold for `inline` to change it.
_READ = "[&<>\"'\\\\`!*~_\\[" + _HELD + "]|  \n"


def inline(text: Column) -> Column:
    """HTML of a text's code spans, links, emphasis and hard breaks; images go."""
    return F.when(text.rlike(_READ), _marked(text)).otherwise(text)


def _marked(text: Column) -> Column:
    safe = escape_html(text)
    for mark, held in zip(_MARKS, _HELD, strict=True):
        safe = F.replace(safe, F.lit("\\" + mark), F.lit(held))
    span = lambda x: F.concat(F.lit("<code>"), F.translate(x, _MARKS, _HELD), F.lit("</code>"))
    part = lambda last: lambda x, i: F.when((i % 2 == 1) & (i < last), span(x)).when(i % 2 == 1, F.concat(F.lit("`"), x)).otherwise(x)
    out = let(F.split(safe, "`", -1), lambda parts: let(F.size(parts) - 1, lambda last: F.array_join(F.transform(parts, part(last)), "")))
    title = "(?:[ \t]+&quot;[^\n\\]]*&quot;)?"
    out = F.regexp_replace(out, f"!\\[[^\\[\\]]*\\]\\([^()\\s]*{title}\\)", "")
    out = F.regexp_replace(out, f"\\[([^\\[\\]]*)\\]\\(([^()\\s]*){title}\\)", '<a href="$2">$1</a>')
    out = F.regexp_replace(out, "[*]{3}(?![\\s*])([^*]+)(?<!\\s)[*]{3}", "<em><strong>$1</strong></em>")
    out = _paired(_paired(_paired(out, "[*]", "em"), "[*][*]", "strong"), "~~", "del")
    for mark, tag in (("__", "strong"), ("_", "em")):
        out = F.regexp_replace(out, f"(?<![\\w]){mark}(?![\\s_])([^_]+)(?<!\\s){mark}(?![\\w])", f"<{tag}>$1</{tag}>")
    broken = F.regexp_replace(out, "(?: {2,}|\\\\)\n *", "<br>\n")
    return let(broken, lambda x: F.when(x.rlike(f"[{_HELD}]"), F.translate(x, _HELD, _MARKS)).otherwise(x))


def _closed(stack: Column) -> Column:
    """The ends of open lists, the innermost first."""
    return F.array_join(F.transform(F.reverse(stack), lambda s: F.concat(F.lit("</li>\n</"), s["tag"], F.lit(">\n"))), "")


def list_html(items: Column) -> Column:
    """HTML of a run of items (`indent`, `tag`, `html`) by a fold with the stack of open lists; an item two columns further
    in than the one above opens a list in it."""
    start = F.struct(F.array().cast("array<struct<indent:int,tag:string>>").alias("stack"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        outer = F.filter(s["stack"], lambda o: o["indent"] + 2 <= x["indent"])
        level = F.get(s["stack"], F.size(outer))  # the open list that x goes on with, if there is one
        deeper = F.slice(s["stack"], F.size(outer) + 2, F.greatest(F.size(s["stack"]) - F.size(outer) - 1, F.lit(0)))
        opened = F.concat(F.lit("<"), x["tag"], F.lit(">\n"))
        before = F.when(level.isNull(), opened).otherwise(F.concat(_closed(deeper), F.lit("</li>\n"), F.when(level["tag"] == x["tag"], "").otherwise(F.concat(F.lit("</"), level["tag"], F.lit(">\n"), opened))))
        mine = F.struct(F.coalesce(level["indent"], x["indent"]).alias("indent"), x["tag"].alias("tag"))
        return F.struct(F.concat(outer, F.array(mine)).alias("stack"), F.concat(s["out"], F.array(F.concat(before, F.lit("<li>"), x["html"]))).alias("out"))

    return F.aggregate(items, start, step, lambda s: F.concat(F.array_join(s["out"], ""), _closed(s["stack"])))


def rendered(docs: DataFrame, keys: list[str], text: str, *others: str) -> DataFrame:
    """The keys, the named other columns and `html` of a text's blocks."""
    lines = block_lines(docs, keys, text)
    kind, line = F.col("kind"), F.col("line")
    bare = F.when(kind == "atx", heading_text(line)).when(kind == "quote", F.regexp_replace(line, _QUOTE, "")).when(kind == "item", F.regexp_replace(line, _ITEM, "")).when(kind == "text", F.ltrim(line)).when(kind == "code", line)
    blocks = lines.where("block > 0").groupBy(*keys, "block").agg(
        F.min_by("kind", "n").alias("kind"), F.max("level").alias("level"), F.array_join(in_order(bare, "n"), "\n").alias("text"), F.min_by("line", "n").alias("first"),
    )
    level, body = F.col("level").cast("string"), inline(F.col("text"))
    info = F.regexp_extract("first", _FENCE + "[ \t]*([^ \t`]*)", 2)
    pre = F.concat(F.lit("<pre><code"), F.when(info == "", "").otherwise(F.concat(F.lit(' class="language-'), escape_html(info), F.lit('"'))), F.lit(">"), escape_html(F.col("text")), F.lit("\n</code></pre>\n"))
    paragraph = lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>\n"))
    quote = F.concat(F.lit("<blockquote>\n"), F.array_join(F.transform(F.filter(F.split(body, "\n[ \t]*\n", -1), lambda x: x != ""), paragraph), ""), F.lit("</blockquote>\n"))
    html = (
        F.when(F.col("level").isNotNull(), F.concat(F.lit("<h"), level, F.lit(">"), body, F.lit("</h"), level, F.lit(">\n")))
        .when(kind == "rule", F.lit("<hr>\n")).when(kind == "open", pre).when(kind == "quote", quote).when(kind == "item", body).otherwise(paragraph(body))
    )
    order = Window.partitionBy(*keys).orderBy("block")
    is_item = kind == "item"
    marker = F.regexp_extract("first", "^( *)([-*+]|[0-9]+)", 1)
    known = blocks.select(*keys, "block", is_item.alias("item"), html.alias("html"), F.char_length(marker).alias("indent"), F.when(F.col("first").rlike("^ *[0-9]"), "ol").otherwise("ul").alias("tag"))
    run = F.sum((~F.col("item") | ~F.coalesce(F.lag("item").over(order), F.lit(False))).cast("int")).over(order)
    runs = known.withColumn("run", run).groupBy(*keys, "run").agg(F.sort_array(F.collect_list(F.struct("block", "item", "indent", "tag", "html"))).alias("x"))
    one = F.when(F.get("x", F.lit(0))["item"], list_html(F.col("x"))).otherwise(F.get("x", F.lit(0))["html"])
    whole = runs.select(*keys, "run", one.alias("part")).groupBy(*keys).agg(F.array_join(in_order("part", "run"), "").alias("html"))
    return docs.select(*keys, *others).join(whole, keys, "left").select(*keys, *others, F.coalesce("html", F.lit("")).alias("html"))
