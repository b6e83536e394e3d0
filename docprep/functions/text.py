"""Column functions on texts. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript defines it, sentence ends, closing quotes.
WS = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
END = "[.!?。！？]"
CLOSE = "[\"'」』]"
HAN = "一-鿿"
#: How much of a document the analysis of terms and of style reads.
TERMS_CHARS, STYLE_CHARS = 50_000, 30_000
#: Between the pieces of a text while it is split: a code point that Unicode keeps free of characters.
MARK = "\ufdd0"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; inside lambdas Spark would compute it at every mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(c, F.lit(WS_CHARS))


def nonspace_len(c: Column) -> Column:
    """Characters (code points) other than white space."""
    return F.char_length(F.regexp_replace(c, WS, ""))


def split_sections(c: Column) -> Column:
    """Cut before each line break that starts a heading of depth 1 to 3; fences are not seen."""
    return F.split(c, "(?=\n#{1,3} )", -1)


def split_paragraphs(c: Column) -> Column:
    return F.split(c, "\n\n+", -1)


def split_sentences(c: Column, mode: str = "reference") -> Column:
    """Sentences of a paragraph with their closing quote and white space; the paragraph if there is no sentence end.

    `reference` drops terminators without a sentence before them and a tail without one; `lossless` keeps every character.
    """
    if mode == "lossless":
        cut = F.split(F.regexp_replace(c, f"({END}+{CLOSE}?{WS}*)", f"$1{MARK}"), MARK, -1)
        return let(cut, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(1)))).otherwise(x))
    if mode != "reference":
        raise ValueError(f"mode {mode!r}: reference or lossless")
    marked = F.regexp_replace(F.ltrim(c, F.lit(END.strip("[]"))), f"({END}+{CLOSE}?{WS}*){END}*", f"$1{MARK}")
    return let(F.split(marked, MARK, -1), lambda x: F.when(F.size(x) > 1, F.slice(x, 1, F.size(x) - 1)).otherwise(F.array(c)))


def _without_blocks(c: Column, name: str) -> Column:
    """Without `<name ..> .. </name>` in any case, in time linear in the text.

    A search from an opening that nothing closes runs to the end, so it is not begun: openings count up to the last closing
    tag only, and of those after the last `>` before it none is whole. A stand-in closes what is open there.
    """
    opening, closing = f"(?is)<{name}[^>]*>.*?</{name}>", f"</{name}>"

    def cut(x: Column) -> Column:
        after = F.char_length(F.substring_index(F.translate(x, name.upper(), name), closing, -1))
        body = F.left(x, F.greatest(F.char_length(x) - after - len(closing), F.lit(0)))
        return F.struct((after < F.char_length(x)).alias("some"), body.alias("body"), F.substring_index(body, ">", -1).alias("loose"), F.right(x, after).alias("tail"), x.alias("x"))

    def joined(p: Column) -> Column:
        whole = F.left(p["body"], F.char_length(p["body"]) - F.char_length(p["loose"]))
        kept = F.regexp_replace(F.concat(whole, F.lit(MARK + closing)), opening, "")
        last = F.substring(p["x"], F.char_length(p["body"]) + 1, F.lit(len(closing)))
        open_end = let(kept, lambda k: F.when(k.endswith(MARK + closing), F.concat(F.left(k, F.char_length(k) - len(MARK + closing)), p["loose"], last)).otherwise(k))
        return F.when(p["some"], F.concat(open_end, p["tail"])).otherwise(p["x"])

    return let(let(c, cut), joined)


def strip_images(c: Column) -> Column:
    """Without <img> tags (lower case only) and <picture> and <svg> blocks (any case)."""
    return F.when(c.rlike("(?i)<(?:img|picture|svg)"), _without_images(c)).otherwise(c)


def _without_images(c: Column) -> Column:
    # behind the last > no tag ends, so no search goes there
    loose = lambda x: F.char_length(F.substring_index(x, ">", -1))
    bare = let(c, lambda x: F.concat(F.regexp_replace(F.left(x, F.char_length(x) - loose(x)), "<img[^>]*>", ""), F.right(x, loose(x))))
    return _without_blocks(_without_blocks(bare, "picture"), "svg")


def escape_html(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def base_name(title: Column, file: Column) -> Column:
    """The trimmed title, else the file name without .pdf or .md, else `document`."""
    stem = F.regexp_replace(file, "(?i)\\.(pdf|md)\\z", "")
    return F.coalesce(F.nullif(trim_ws(title), F.lit("")), F.nullif(stem, F.lit("")), F.lit("document"))


def download_name(base: Column, mode: Column, ext: str, always_suffix: bool = False) -> Column:
    suffix = F.lit("_翻譯") if always_suffix else F.when(mode == "translate", "_翻譯").otherwise("")
    return F.concat(base, suffix, F.lit(ext))


def to_base64(c: Column) -> Column:
    """One line of base64."""
    return F.replace(F.base64(c), F.lit("\r\n"), F.lit(""))


def url_name(c: Column) -> Column:
    """Percent-encoded with %20 for a blank, leaving what URI components leave."""
    out = F.url_encode(c)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def has_raw_text(c: Column, least: int = 10) -> Column:
    return F.coalesce(nonspace_len(c) > least, F.lit(False))


def extraction_route(c: Column) -> Column:
    """`repair` for pages with text, `ocr` for pages without."""
    return F.when(has_raw_text(c), "repair").otherwise("ocr")


def suspiciously_short(source: Column, target: Column, floor: int = 150, ratio: float = 0.02) -> Column:
    n = nonspace_len(source)
    return F.coalesce((n > floor) & (nonspace_len(F.coalesce(target, F.lit(""))) < n * F.lit(ratio)), F.lit(False))


def is_retryable(status: Column, message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.coalesce(status == 429, F.lit(False)) | low.rlike("429|quota|rate limit|suspiciously short")


def est_output_tokens(tokens: Column, factor: float = 2.5) -> Column:
    return F.coalesce(F.floor(tokens * F.lit(factor) + 0.5), F.lit(0)).cast("long")


def est_cost_usd(tokens: Column, in_price: Column, out_price: Column) -> Column:
    return tokens / 1e6 * in_price + est_output_tokens(tokens) / 1e6 * out_price


def est_cost_twd(usd: Column, rate: float = 32.5) -> Column:
    return usd * rate


def eta_display(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("int").cast("string"), 2, "0"))


def backoff_seconds(kind: Column, retries: Column) -> Column:
    """short output: 1; rate limit: retries x 5; extraction: retries x 1."""
    return F.when(kind == "short", 1).when(kind == "rate", retries * 5).when(kind == "extraction", retries)


def analysis_prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def citation_marks(c: Column) -> Column:
    """[n] and ^n in order."""
    return F.regexp_extract_all(c, F.lit("(\\[[0-9]+\\]|\\^[0-9]+)"), F.lit(1))
