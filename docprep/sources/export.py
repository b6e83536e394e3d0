"""Export: metadata, package entries, print pages and text files."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprep.functions.text import escape_html

from .attempt_log import opened

#: Fixed values.
TITLE, AUTHOR, LANG, TOC_TITLE = "Translated Document", "AI Translator", "zh-TW", "目錄"
PAGE_HEAD = '<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>'
PAGE_STYLE = "</title>\n<style>body { max-width: 50em; margin: auto; line-height: 1.7; }</style>\n</head>\n<body>\n"
PAGE_TAIL = "\n</body>\n</html>\n"


def _or(c: str, default: str):
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def export_metadata(docs: DataFrame) -> DataFrame:
    """Defaults for null and empty title and author; the date in UTC to the second; an empty cover is none."""
    # an instant is shown in the session's zone, a time without a zone as it is
    utc = F.to_utc_timestamp("ts", F.current_timezone()) if dict(docs.dtypes)["ts"] == "timestamp" else F.col("ts")
    date = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return docs.select("doc_id", _or("title", TITLE).alias("title"), _or("author", AUTHOR).alias("author"), F.lit(LANG).alias("lang"), F.lit(TOC_TITLE).alias("toc_title"), date.alias("date"), F.nullif("cover", F.lit("")).alias("cover"))


def export_entries(chapters: DataFrame, meta: DataFrame) -> DataFrame:
    """`doc_id`, `entry_no`, `path`, `content`: the files of a package as rows (metadata and spine, contents, chapters)."""
    slug = F.regexp_replace("title", "[^0-9A-Za-z一-鿿]+", "-")
    page = F.concat(F.lit("<html><head><title>"), escape_html(F.col("title")), F.lit("</title></head><body>"), F.col("html"), F.lit("</body></html>"))
    files = chapters.select("doc_id", F.struct("chapter_no", "title", F.format_string("OEBPS/%d_%s.xhtml", "chapter_no", slug).alias("path"), page.alias("content")).alias("file"))
    books = files.groupBy("doc_id").agg(F.array_sort(F.collect_list("file")).alias("files"))
    known = books.join(meta.select("doc_id", F.col("title").alias("book"), "author", "lang", "toc_title", "date"), "doc_id", "left")
    every = lambda line: F.array_join(F.transform("files", line), "")
    spine = every(lambda f: F.concat(F.lit('<itemref idref="'), f["path"], F.lit('"/>')))
    toc = every(lambda f: F.concat(F.lit("<navPoint>"), escape_html(f["title"]), F.lit("|"), f["path"], F.lit("</navPoint>")))
    opf = F.concat(F.lit("<package><title>"), escape_html(F.col("book")), F.lit("</title><creator>"), escape_html(F.col("author")), F.lit("</creator><language>"), F.col("lang"), F.lit("</language><date>"), F.col("date"), F.lit("</date><spine>"), spine, F.lit("</spine></package>"))
    ncx = F.concat(F.lit("<ncx><docTitle>"), F.col("toc_title"), F.lit("</docTitle>"), toc, F.lit("</ncx>"))
    entry = lambda number, path, content: F.struct(number.alias("entry_no"), path.alias("path"), content.alias("content"))
    lists = F.array(entry(F.lit(0), F.lit("OEBPS/content.opf"), opf), entry(F.lit(1), F.lit("OEBPS/toc.ncx"), ncx))
    pages = F.transform("files", lambda f: entry(f["chapter_no"] + 2, f["path"], f["content"]))
    entries = known.select("doc_id", F.explode_outer(F.when(F.col("book").isNotNull(), F.concat(lists, pages)).otherwise(pages)).alias("e"))
    return entries.select("doc_id", "e.entry_no", "e.path", "e.content")


def html_export(docs: DataFrame) -> DataFrame:
    """A print page around rendered content."""
    return docs.select("doc_id", F.concat(F.lit(PAGE_HEAD), escape_html(F.col("title")), F.lit(PAGE_STYLE), F.col("html"), F.lit(PAGE_TAIL)).alias("page"))


def file_names(docs: DataFrame) -> DataFrame:
    """`file_name` and `text` of the documents with a text, under names that a folder can hold once each.

    Slashes, backslashes and control characters become `_`; a name that readers would take for hidden (`_` or `.` in front)
    gets a `-` in front, and so does a null or empty one. Of a name that several different texts have, each gets
    `-` and twelve digits of its text's hash before the extension; equal texts of one name are one file.
    """
    name = F.regexp_replace(F.coalesce("file_name", F.lit("")), "[/\\\\\\x00-\\x1F\\x7F]", "_")
    name = F.when((name == "") | name.startswith("_") | name.startswith("."), F.concat(F.lit("-"), name)).otherwise(name)
    some = docs.where(F.coalesce("text", F.lit("")) != "").select(name.alias("file_name"), "text", F.left(F.sha2("text", 256), F.lit(12)).alias("mark"))
    own = some.groupBy("file_name").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high").select("file_name", F.lit(True).alias("shared"))
    stem, ending = F.regexp_replace("file_name", "(?s)(?<=.)[.][^.]*\\z", ""), F.regexp_extract("file_name", "(?s)(?<=.)([.][^.]*)\\z", 1)
    apart = F.when(F.col("shared"), F.concat(stem, F.lit("-"), F.col("mark"), ending)).otherwise(F.col("file_name"))
    return some.join(own, "file_name", "left").select(apart.alias("file_name"), "text")


def write_markdown(docs: DataFrame, path: str, mode: str | None = None) -> DataFrame:
    """One Markdown file for each document, under its own `file_name` (see `file_names`) in the folder; documents whose text is
    null or empty are skipped. Returns `file_name`, `bytes` and `sha256` of the files, which also stay in `_index`.

    The text is the column `text`, or with a `mode` `translated_text` (translate) or `extracted_text` (any other). Tasks write
    the files, each under another name first and then renamed, so a file is whole or absent and a task that is run again
    writes the same. Files of other names that are in the folder stay. The folder is one that pyarrow's file systems can
    open (a path, file, s3, gs, hdfs).
    """
    if mode is not None:
        docs = docs.withColumn("text", F.col("translated_text" if mode == "translate" else "extracted_text"))
    folder, schema = path.rstrip("/"), "file_name string, bytes long, sha256 string"

    def write(parts):
        files, base = opened(folder)
        files.create_dir(f"{base}/_writing", recursive=True)
        for part in parts:
            out = []
            for name, text in zip(part["file_name"], part["text"], strict=True):
                data, early = text.encode("utf-8", "surrogatepass"), f"{base}/_writing/{uuid.uuid4().hex}"
                with files.open_output_stream(early) as file:
                    file.write(data)
                files.move(early, f"{base}/{name}")
                out.append((name, len(data), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(out, columns=["file_name", "bytes", "sha256"])

    written = file_names(docs).mapInPandas(write, schema)
    written.distinct().write.mode("overwrite").parquet(f"{folder}/_index")
    return docs.sparkSession.read.schema(schema).parquet(f"{folder}/_index")
