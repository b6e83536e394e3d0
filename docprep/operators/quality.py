"""Checks of a translation against its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.functions.text import HAN, citation_marks, let

from .blocks import block_kinds

#: Characters of a term by which it is looked up.
GRAM = 3


def _count(c: str, pattern: str):
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0)).cast("long")


def markdown_parity(pairs: DataFrame) -> DataFrame:
    """Whether a translation has the blocks of its source, in their order.

    Both sides are read as sequences of block kinds (`blocks.block_kinds`) and aligned: `edits` is the least number of blocks
    to add, drop or change, `first_edit` the number, from 0, of the first block where they differ (null if none does), and
    `parity` is true without edits. Headings, list items and paragraphs of both sides are counted too. A null text has no
    blocks. What both begin with is not aligned, the rest in time of the product of their numbers of blocks.
    """
    sides = pairs.select("doc_id", "chunk_no", F.explode(F.create_map(F.lit("source"), F.col("source"), F.lit("target"), F.col("target"))).alias("side", "text"))
    kinds = block_kinds(sides, ["doc_id", "chunk_no", "side"], "text")
    both = kinds.groupBy("doc_id", "chunk_no").agg(*[F.max(F.when(F.col("side") == side, F.col("kinds"))).alias(f"{side}_kinds") for side in ("source", "target")])
    known = pairs.select("doc_id", "chunk_no").join(both, ["doc_id", "chunk_no"], "left")
    s, t = (F.coalesce(f"{side}_kinds", F.lit("")) for side in ("source", "target"))
    here = F.filter(F.sequence(F.lit(0), F.greatest(F.length(s), F.length(t))), lambda i: F.substr(s, i + 1, F.lit(1)) != F.substr(t, i + 1, F.lit(1)))
    aligned = known.withColumn("first_edit", F.get(here, F.lit(0)))
    rest = [F.substr(x, F.col("first_edit") + 1) for x in (s, t)]
    edits = F.coalesce(F.levenshtein(*rest), F.lit(0)).cast("long")
    letters = {"headings": "[1-6]", "items": "[uo]", "paragraphs": "p"}
    counts = [F.regexp_count(x, F.lit(p)).cast("long").alias(f"{side}_{name}") for name, p in letters.items() for side, x in (("source", s), ("target", t))]
    return aligned.select("doc_id", "chunk_no", *counts, edits.alias("edits"), "first_edit", F.col("first_edit").isNull().alias("parity"))


def untranslated_residue(pairs: DataFrame) -> DataFrame:
    """Runs of four or more Latin words with a sentence end, outside parentheses.

    Only the last four words decide, so the pattern repeats a fixed number of times: an open repeat of a group recurses
    in the regular expression engine once for each word of a long text.
    """
    bare = pairs.withColumn("bare", F.regexp_replace("target", "[(（][^()（）]*[)）]", ""))
    return bare.select("doc_id", "chunk_no", _count("bare", "[A-Za-z](?:[ ,;]+[A-Za-z]+){3}[.!?]").alias("latin_sentences"))


def dialogue_breaks(pairs: DataFrame) -> DataFrame:
    """Paragraphs that hold two or more quoted speeches."""
    crowded = F.filter(F.split("target", "\n\n+", -1), lambda p: F.regexp_count(p, F.lit("「[^「」]*」")) >= 2)
    return pairs.select("doc_id", "chunk_no", F.coalesce(F.when(F.col("target").isNotNull(), F.size(crowded)), F.lit(0)).cast("long").alias("crowded_paragraphs"))


def fullwidth_punct(pairs: DataFrame) -> DataFrame:
    """Half-width punctuation next to a Han character."""
    return pairs.select("doc_id", "chunk_no", _count("target", f"[{HAN}][,.!?;:]|[,.!?;:][{HAN}]").alias("halfwidth_marks"))


def citation_markers(docs: DataFrame) -> DataFrame:
    """`doc_id`, `position`, `marker` of every [n] and ^n."""
    return docs.select("doc_id", F.posexplode(citation_marks(F.col("markdown"))).alias("position", "marker"))


def _grams(text, n: int):
    """The distinct runs of n characters of a text."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    runs = let(chars, lambda x: F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.concat(*[F.get(x, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(runs)


def glossary_compliance(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """For each glossary term that a source holds: whether the translation holds its target term.

    A term is found through its first characters, GRAM at most: a source is read once into its distinct runs of characters,
    whatever the number of terms, and only the runs that begin a term of its document become rows, so what is shuffled
    grows with the terms that are found and not with the characters of a source. An empty term is in every source.
    """
    head = F.left("source_term", F.lit(GRAM))
    sized = terms.where("source_term IS NOT NULL").select("doc_id", head.alias("gram"), "source_term", "target_term")
    heads = sized.groupBy("doc_id").agg(F.collect_set("gram").alias("heads"))
    runs = F.concat(F.array(F.lit("")), *[_grams(F.col("source"), n) for n in range(1, GRAM + 1)])
    # an outer generator: for the others Spark infers a filter on the array, which would build it twice
    known = pairs.select("doc_id", "chunk_no", "source", "target").join(heads, "doc_id")
    begun = known.select("doc_id", "chunk_no", "source", "target", F.explode_outer(F.array_intersect("heads", runs)).alias("gram"))
    met = begun.where("gram IS NOT NULL").join(sized, ["doc_id", "gram"]).where(F.contains("source", "source_term"))
    return met.select("doc_id", "chunk_no", "source_term", "target_term", F.coalesce(F.contains("target", "target_term"), F.lit(False)).alias("complies"))
