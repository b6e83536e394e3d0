"""Every operator as a query on the driver's tables, with its DuckDB SQL."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docprep.functions import text as X
from docprep.operators import attempts, chapters, chunking, cost, history, model, pages, quality, requests
from docprep.sources import export
from docprep.sources import files as sources
from docprep.sources.attempt_log import AttemptLog
from docprep.sources.folders import dealt_out, shared_folder
from docprep.streaming import streams

from . import fixtures as fx
from . import lifecycle

QUERIES = {}
ORACLE_SQL = {}
WS = X.WS


def _trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def _escape(c: str) -> str:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        c = f"replace({c}, '{char}', '{name}')"
    return c


def _with(sql: str, extra: dict[str, str] | None = None) -> str:
    """Put the fixtures that `sql` names before it, each after those it names itself."""
    known, seen, found = fx.SQL | (extra or {}), set(), []

    def need(text: str) -> None:
        for name in known:
            if name not in seen and re.search(rf"\b(?:FROM|JOIN) {name}\b", text):
                seen.add(name)
                need(known[name])
                found.append(name)

    need(sql)
    return f"WITH RECURSIVE {', '.join(f'{n} AS ({known[n]})' for n in found)} {sql}" if found else sql


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = _with(sql, extra)
        return f

    return add


# chunking --------------------------------------------------------------------------------------------------------

_MARK = "chr(1) || chr(2)"
_SENTENCES = f"""CASE WHEN len(regexp_extract_all(par, '[^.!?。！？]+[.!?。！？]+["''」』]?{WS}*')) > 0
    THEN regexp_extract_all(par, '[^.!?。！？]+[.!?。！？]+["''」』]?{WS}*') ELSE [par] END"""
_SECTIONS = f"""CASE WHEN regexp_matches(markdown, '^\\n#{{1,3}} ') THEN string_split(regexp_replace(markdown, '(\\n#{{1,3}} )', {_MARK} || '\\1', 'g'), {_MARK})[2:]
    ELSE string_split(regexp_replace(markdown, '(\\n#{{1,3}} )', {_MARK} || '\\1', 'g'), {_MARK}) END"""


def _chunk_sql(docs: str, limit: int) -> dict[str, str]:
    return {
        "c_sec": f"SELECT doc_id, s, secs[s] AS sec FROM (SELECT doc_id, {_SECTIONS} AS secs FROM {docs}) AS a, unnest(range(1, len(secs) + 1)) AS t(s)",
        "c_par": f"SELECT doc_id, s, p, pars[p] AS par FROM (SELECT doc_id, s, string_split_regex(sec, '\\n\\n+') AS pars FROM c_sec WHERE length(sec) > {limit}) AS a, unnest(range(1, len(pars) + 1)) AS t(p)",
        "c_sen": f"SELECT doc_id, s, p, n, sens[n] AS sen FROM (SELECT doc_id, s, p, {_SENTENCES} AS sens FROM c_par WHERE length(par) > {limit}) AS a, unnest(range(1, len(sens) + 1)) AS t(n)",
        "c_piece": f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, p, n) AS i FROM (
            SELECT doc_id, s, 0 AS p, 0 AS n, sec AS piece, 'S' AS kind, false AS opens FROM c_sec WHERE length(sec) <= {limit}
            UNION ALL SELECT doc_id, s, p, 0, par, 'P', p = 1 FROM c_par WHERE length(par) <= {limit}
            UNION ALL SELECT doc_id, s, p, n, sen, 'N', n = 1 FROM c_sen)""",
        "c_fold": f"""SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS size, false AS nl, 0 AS chunk_no, '' AS piece FROM {docs} WHERE markdown IS NOT NULL
            UNION ALL SELECT doc_id, i, was + length(sep) + length(piece), CASE WHEN piece <> '' THEN ends_with(piece, chr(10)) WHEN sep <> '' THEN true ELSE nl AND was > 0 END, chunk_no, sep || piece
            FROM (SELECT *, CASE WHEN was = 0 OR kind = 'N' THEN '' WHEN kind = 'P' THEN chr(10) || chr(10) WHEN nl THEN '' ELSE chr(10) END AS sep
                  FROM (SELECT c.doc_id, c.i, c.piece, c.kind, f.nl, CASE WHEN flush THEN 0 ELSE f.size END AS was, f.chunk_no + flush::INT AS chunk_no
                        FROM (SELECT f.*, f.size > 0 AND (c.opens OR f.size + length(c.piece) > {limit}) AS flush FROM c_fold f JOIN c_piece c ON c.doc_id = f.doc_id AND c.i = f.i + 1) f
                        JOIN c_piece c ON c.doc_id = f.doc_id AND c.i = f.i + 1))""",
        "c_chunk": f"""SELECT doc_id, chunk_no, source_text, length(source_text) AS n_chars FROM (
            SELECT doc_id, chunk_no, {_trim("string_agg(piece, '' ORDER BY i)")} AS source_text, chunk_no = max(chunk_no) OVER (PARTITION BY doc_id) AS last FROM c_fold WHERE i > 0 GROUP BY doc_id, chunk_no)
            WHERE NOT last OR source_text <> ''""",
    }


_T4 = "SELECT doc_id, chunk_no, source_text, n_chars FROM c_chunk"


@query("t1_split_sections", f"SELECT doc_id, {_SECTIONS} AS sections FROM md_docs")
def _(s, d):
    return fx.md_docs(s, d).select("doc_id", X.split_sections(F.col("markdown")).alias("sections"))


@query("t2_split_paragraphs", "SELECT doc_id, string_split_regex(markdown, '\\n\\n+') AS paragraphs FROM para_docs")
def _(s, d):
    return fx.para_docs(s, d).select("doc_id", X.split_paragraphs(F.col("markdown")).alias("paragraphs"))


@query("t3_split_sentences", f"SELECT doc_id, {_SENTENCES} AS sentences FROM (SELECT doc_id, markdown AS par FROM plain_docs)")
def _(s, d):
    return fx.plain_docs(s, d).select("doc_id", X.split_sentences(F.col("markdown")).alias("sentences"))


@query("t4_chunk_plain_documents", _T4, _chunk_sql("plain_docs", 3500))
def _(s, d):
    return chunking.chunk_documents(fx.plain_docs(s, d))


@query("t4_chunk_paragraph_documents", _T4, _chunk_sql("para_docs", 900))
def _(s, d):
    return chunking.chunk_documents(fx.para_docs(s, d), limit=900)


@query("t4_chunk_markdown_documents", _T4, _chunk_sql("md_docs", 700))
def _(s, d):
    return chunking.chunk_documents(fx.md_docs(s, d), limit=700)


@query("t5_chunk_off", "SELECT doc_id, 0 AS chunk_no, markdown AS source_text, length(markdown) AS n_chars FROM md_docs")
def _(s, d):
    return chunking.chunk_off(fx.md_docs(s, d))


@query("chunk_sizes_by_language", "SELECT lang, count(*) AS chunks, sum(c_chunk.n_chars)::BIGINT AS chars, max(c_chunk.n_chars) AS longest FROM c_chunk JOIN documents USING (doc_id) GROUP BY lang", _chunk_sql("plain_docs", 3500))
def chunk_sizes_by_language(s, d):
    docs = dealt_out(s.read.parquet(f"{d}/documents.parquet")).selectExpr("struct(doc_id, lang) AS doc_id", "text AS markdown")
    sizes = chunking.chunk_documents(docs).select(F.col("doc_id.lang").alias("lang"), "n_chars")
    return sizes.groupBy("lang").agg(F.count("*").alias("chunks"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


# pages -----------------------------------------------------------------------------------------------------------


@query("a4_page_text", "SELECT doc_id, page_no, text FROM page_text")
def _(s, d):
    return pages.page_text(fx.page_items(s, d))


@query("a5_document_from_pages", "SELECT doc_id, string_agg(text || chr(10) || chr(10), '' ORDER BY page_no) AS markdown FROM page_text GROUP BY doc_id")
def _(s, d):
    return pages.document_from_pages(pages.page_text(fx.page_items(s, d)))


@query("t9_page_batches", "SELECT doc_id, b::INT AS batch_no, (b * 5 + 1)::INT AS start_page, least(b * 5 + 5, pages)::INT AS end_page FROM page_counts, unnest(range(0, (pages + 4) // 5)) AS t(b)")
def _(s, d):
    return pages.page_batches(fx.page_counts(s, d))


@query("t10_token_batches", "SELECT doc_id, b::INT AS batch_no, (b * step + 1)::INT AS start_page, least(b * step + step, pages)::INT AS end_page FROM (SELECT *, CASE WHEN pages <= 1000 THEN pages ELSE 500 END AS step FROM page_counts) AS a, unnest(range(0, (pages + step - 1) // step)) AS t(b)")
def _(s, d):
    return pages.token_batches(fx.page_counts(s, d))


@query("t11_batch_raw_text", "SELECT doc_id, ((page_no - 1) // 5)::INT AS batch_no, string_agg(text || chr(10), '' ORDER BY page_no) AS raw_text FROM page_text GROUP BY 1, 2")
def _(s, d):
    return pages.batch_raw_text(pages.page_text(fx.page_items(s, d)))


@query("w8_is_last_batch", "SELECT doc_id, batch_no, is_last FROM (SELECT doc_id, ((page_no - 1) // 5)::INT AS batch_no, batch_no = max(((page_no - 1) // 5)::INT) OVER (PARTITION BY doc_id) AS is_last FROM page_text) GROUP BY ALL")
def _(s, d):
    batches = pages.batch_raw_text(pages.page_text(fx.page_items(s, d))).select("doc_id", "batch_no")
    return pages.is_last_batch(batches)


@query("p1_extraction_route", f"SELECT doc_id, page_no, length(regexp_replace(text, '{WS}', '', 'g')) > 10 AS has_raw, CASE WHEN length(regexp_replace(text, '{WS}', '', 'g')) > 10 THEN 'repair' ELSE 'ocr' END AS route FROM page_text")
def _(s, d):
    text = pages.page_text(fx.page_items(s, d))
    return text.select("doc_id", "page_no", X.has_raw_text(F.col("text")).alias("has_raw"), X.extraction_route(F.col("text")).alias("route"))


@query("g2_assemble_extraction", f"SELECT doc_id, coalesce(p, '') AS partial, {_trim("coalesce(p, '')")} AS markdown FROM (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY batch_no) AS p FROM batch_texts GROUP BY doc_id)")
def _(s, d):
    return pages.assemble_extraction(fx.batch_texts(s, d))


@query("g5_progress", "SELECT doc_id, count(text) AS done, count(*) AS total, floor(100.0::DOUBLE * count(text) / count(*) + 0.5)::BIGINT AS percent FROM batch_texts GROUP BY doc_id")
def _(s, d):
    return pages.progress(fx.batch_texts(s, d))


@query("g7_concat_fragments", "SELECT doc_id, chunk_no, string_agg(coalesce(text, ''), '' ORDER BY seq) AS draft_text FROM fragments GROUP BY 1, 2")
def _(s, d):
    return pages.concat_fragments(fx.fragments(s, d))


@query("g8_extraction_complete", "SELECT doc_id, count(text) AS completed, max(total) AS total, count(text) = max(total) AND max(total) > 0 AS complete FROM batch_texts GROUP BY doc_id")
def _(s, d):
    return pages.extraction_complete(fx.batch_texts(s, d))


# cost ------------------------------------------------------------------------------------------------------------

_COST = {
    "prices": "SELECT * FROM (VALUES ('pro', 1.25::DOUBLE, 5.0::DOUBLE), ('flash', 0.075, 0.3), ('lite', 0.0375, 0.15)) AS t(model_id, i, o)",
    "totals": "SELECT doc_id, floor(sum(tokens) * 20 + 0.5)::BIGINT AS tokens FROM token_counts GROUP BY doc_id",
    "costs": "SELECT doc_id, model_id, tokens, floor(tokens * 2.5::DOUBLE + 0.5)::BIGINT AS output_tokens, tokens / 1e6 * i + floor(tokens * 2.5::DOUBLE + 0.5) / 1e6 * o AS usd, (tokens / 1e6 * i + floor(tokens * 2.5::DOUBLE + 0.5) / 1e6 * o) * 32.5::DOUBLE AS twd FROM totals CROSS JOIN prices",
}


def _costs(s, d):
    return cost.cost_by_model(cost.token_total(fx.token_counts(s, d)), cost.price_list(s))


@query("g1_token_total", "SELECT doc_id, tokens FROM totals", _COST)
def _(s, d):
    return cost.token_total(fx.token_counts(s, d))


@query("j1_cost_by_model", "SELECT doc_id, model_id, tokens, round(usd, 9) AS usd FROM costs", _COST)
def _(s, d):
    return _costs(s, d).select("doc_id", "model_id", "tokens", F.round("usd", 9).alias("usd"))


@query("m1_est_output_tokens", "SELECT doc_id, coalesce(floor(nullif(n_chars, 0) * 2.5::DOUBLE + 0.5), 0)::BIGINT AS output_tokens FROM documents")
def _(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", X.est_output_tokens(F.nullif("n_chars", F.lit(0))).alias("output_tokens"))


@query("m2_est_cost_usd", "SELECT doc_id, round(usd, 9) AS usd FROM costs WHERE model_id = 'pro'", _COST)
def _(s, d):
    return cost.find_model(_costs(s, d), "pro").select("doc_id", F.round("usd", 9).alias("usd"))


@query("m3_est_cost_twd", "SELECT doc_id, model_id, floor(twd * 100 + 0.5) / 100 AS twd FROM costs", _COST)
def _(s, d):
    return _costs(s, d).select("doc_id", "model_id", (F.floor(F.col("twd") * 100 + 0.5) / 100).alias("twd"))


@query("m4_cost_display", "SELECT doc_id, model_id, printf('%.4f', usd) AS usd_text, printf('%.2f', twd) AS twd_text FROM costs", _COST)
def _(s, d):
    return cost.cost_display(_costs(s, d))


@query("m5_eta_display", "SELECT event_id, (s // 60)::VARCHAR || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS eta FROM (SELECT event_id, floor(value * 10)::BIGINT AS s FROM events)")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", X.eta_display(F.floor(F.col("value") * 10)).alias("eta"))


@query("m6_backoff_seconds", "SELECT doc_id, chunk_no, attempt_no, CASE WHEN error_message LIKE '%short%' THEN 1 WHEN http_status = 429 THEN attempt_no * 5 ELSE attempt_no END::INT AS wait_seconds FROM attempts")
def _(s, d):
    kind = F.when(F.contains("error_message", F.lit("short")), "short").when(F.col("http_status") == 429, "rate").otherwise("extraction")
    return fx.attempts(s, d).select("doc_id", "chunk_no", "attempt_no", X.backoff_seconds(kind, F.col("attempt_no")).cast("int").alias("wait_seconds"))


@query("p11_find_model", "SELECT model_id, i AS input_price, o AS output_price, (SELECT sum(n_chars)::BIGINT FROM documents) AS chars FROM prices WHERE model_id = 'flash'", _COST)
def _(s, d):
    chars = s.read.parquet(f"{d}/documents.parquet").agg(F.sum("n_chars").alias("chars")).withColumn("model_id", F.lit("flash"))
    return cost.find_model(cost.price_list(s), "flash").join(chars, "model_id")


# chapters and export ---------------------------------------------------------------------------------------------

_ODD_MD = "'Head' || chr(10) || '====' || chr(10) || '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) || '# A & B #' || chr(10) || 'x' || chr(10) || chr(10) || '---' || chr(10) || '#### deep'"
#: Chapters and HTML by what the blocks were made from, not by reading the Markdown.
_CHAPTERS = {
    "h_odd": "SELECT DISTINCT 2000000 + conv_id AS doc_id, conv_id % 3 AS r FROM conversations",
    "md_some": f"SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY i) AS markdown FROM b_block GROUP BY doc_id UNION ALL SELECT doc_id, CASE r WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE {_ODD_MD} END FROM h_odd",
    "h_line": "SELECT doc_id, n, ls[n] AS line FROM (SELECT doc_id, string_split(markdown, chr(10)) AS ls FROM md_some) AS a, unnest(range(1, len(ls) + 1)) AS t(n)",
    "h_part": "SELECT *, sum((k < 2)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM b_block",
    "h_joined": "SELECT doc_id, part, coalesce(max(w) FILTER (k < 2), '前言') AS title, string_agg(md, chr(10) || chr(10) ORDER BY i) AS raw, string_agg(html, '' ORDER BY i) AS html FROM h_part GROUP BY doc_id, part",
    "h_whole": """
        SELECT doc_id, (row_number() OVER d - 1)::INT AS chapter_no, title, raw || CASE WHEN lead(part) OVER d IS NULL THEN '' ELSE chr(10) END AS raw, html FROM h_joined WINDOW d AS (PARTITION BY doc_id ORDER BY part)
        UNION ALL SELECT doc_id, 0, 'Head', 'Head' || chr(10) || '====' || chr(10) || '```' || chr(10) || '# code' || chr(10) || '```', '<h1>Head</h1>' || chr(10) || '<pre><code># code' || chr(10) || '</code></pre>' || chr(10) FROM h_odd WHERE r = 2
        UNION ALL SELECT doc_id, 1, 'A & B', '# A & B #' || chr(10) || 'x' || chr(10) || chr(10) || '---' || chr(10) || '#### deep', '<h1>A &amp; B</h1>' || chr(10) || '<p>x</p>' || chr(10) || '<hr>' || chr(10) || '<h4>deep</h4>' || chr(10) FROM h_odd WHERE r = 2""",
    "h_chap": "SELECT doc_id, chapter_no, title, raw FROM h_whole",
    "h_html": "SELECT doc_id, chapter_no, title, html FROM h_whole",
    "h_all": "SELECT doc_id, chapter_no, title, html FROM h_html UNION ALL SELECT doc_id, 0, '內容', '<p>無內容</p>' FROM md_some WHERE markdown <> '' AND doc_id NOT IN (SELECT doc_id FROM h_html)",
    "h_meta": "SELECT user_id AS doc_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE 'T' || event_id END, ''), 'Translated Document') AS title, coalesce(nullif(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END, ''), 'AI Translator') AS author, 'zh-TW' AS lang, '目錄' AS toc_title, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date, nullif(CASE WHEN event_id % 2 = 0 THEN '' ELSE 'c' END, '') AS cover FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1",
    "h_file": "SELECT doc_id, chapter_no, title, 'OEBPS/' || chapter_no || '_' || regexp_replace(title, '[^0-9A-Za-z一-鿿]+', '-', 'g') || '.xhtml' AS path, html FROM h_all",
    "h_list": f"SELECT doc_id, string_agg('<itemref idref=\"' || path || '\"/>', '' ORDER BY chapter_no) AS spine, string_agg('<navPoint>' || {_escape('title')} || '|' || path || '</navPoint>', '' ORDER BY chapter_no) AS toc FROM h_file GROUP BY doc_id",
}


def _md_some(s, d):
    odd = f"CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN ' ' ELSE {_ODD_MD} END AS markdown"
    ids = s.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("doc_id")).distinct()
    return fx.block_docs(s, d).unionByName(ids.selectExpr("2000000 + doc_id AS doc_id", odd))


def _meta(s, d):
    first = s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.min_by(F.struct("event_id", "event_type", "ts"), "event_id").alias("e"))
    return first.selectExpr("user_id AS doc_id", "CASE WHEN e.event_id % 3 = 0 THEN '' ELSE 'T' || e.event_id END AS title", "CASE WHEN e.event_id % 4 = 0 THEN NULL ELSE e.event_type END AS author", "e.ts AS ts", "CASE WHEN e.event_id % 2 = 0 THEN '' ELSE 'c' END AS cover")


def _rendered(s, d):
    docs = chapters.nonempty_documents(_md_some(s, d))
    return chapters.chapter_fallback(docs, chapters.render_blocks(chapters.split_chapters(docs)))


@query("t6_split_chapters", "SELECT doc_id, chapter_no, title, raw FROM h_chap", _CHAPTERS)
def _(s, d):
    return chapters.split_chapters(_md_some(s, d))


@query("t8_render_blocks", "SELECT doc_id, chapter_no, title, html FROM h_html", _CHAPTERS)
def _(s, d):
    return chapters.render_blocks(chapters.split_chapters(_md_some(s, d)))


@query("p6_nonempty_documents", "SELECT doc_id, length(markdown) AS n FROM md_some WHERE markdown IS NOT NULL AND markdown <> ''", _CHAPTERS)
def _(s, d):
    return chapters.nonempty_documents(_md_some(s, d)).select("doc_id", F.char_length("markdown").cast("long").alias("n"))


@query("p7_nonempty_chapters", f"SELECT doc_id, n::INT AS chapter_no, line AS raw FROM h_line WHERE {_trim('line')} <> ''", _CHAPTERS)
def _(s, d):
    lines = _md_some(s, d).select("doc_id", F.posexplode(F.split("markdown", "\n", -1)).alias("n", "raw"))
    return chapters.nonempty_chapters(lines.select("doc_id", (F.col("n") + 1).alias("chapter_no"), "raw"))


@query("p8_chapter_fallback", "SELECT doc_id, chapter_no, title, html FROM h_all", _CHAPTERS)
def _(s, d):
    return _rendered(s, d)


_ENTRIES = f"""
    SELECT doc_id, 0 AS entry_no, 'OEBPS/content.opf' AS path, '<package><title>' || {_escape('title')} || '</title><creator>' || {_escape('author')} || '</creator><language>' || lang || '</language><date>' || date || '</date><spine>' || spine || '</spine></package>' AS content FROM h_meta JOIN h_list USING (doc_id)
    UNION ALL SELECT doc_id, 1, 'OEBPS/toc.ncx', '<ncx><docTitle>' || toc_title || '</docTitle>' || toc || '</ncx>' FROM h_meta JOIN h_list USING (doc_id)
    UNION ALL SELECT doc_id, chapter_no + 2, path, '<html><head><title>' || {_escape('title')} || '</title></head><body>' || html || '</body></html>' FROM h_file"""  # fmt: skip


@query("a7_export_entries", _ENTRIES, _CHAPTERS)
def _(s, d):
    return export.export_entries(_rendered(s, d), export.export_metadata(_meta(s, d)))


@query("a8_export_metadata", "SELECT doc_id, title, author, lang, toc_title, date, cover FROM h_meta", _CHAPTERS)
def _(s, d):
    return export.export_metadata(_meta(s, d))


@query("a11_html_export", f"SELECT doc_id, '{export.PAGE_HEAD}' || {_escape('title')} || '{export.PAGE_STYLE}' || html || '{export.PAGE_TAIL}' AS page FROM html")
def _(s, d):
    return export.html_export(fx.html(s, d))


@query("t7_strip_images", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(html, '<img[^>]*>', '', 'g'), '(?is)<picture[^>]*>.*?</picture>', '', 'g'), '(?is)<svg[^>]*>.*?</svg>', '', 'g') AS html FROM html")
def _(s, d):
    return fx.html(s, d).select("doc_id", X.strip_images(F.col("html")).alias("html"))


@query("a1_accept_filter", "SELECT doc_id, path, mime FROM files WHERE mime = 'application/pdf' OR ends_with(lower(path), '.md')")
def _(s, d):
    return sources.accept_filter(fx.files(s, d))[0].select("doc_id", "path", "mime")


@query("a1_rejected_files", "SELECT doc_id, path, 'only PDF and Markdown files are read' AS message FROM files WHERE NOT (mime = 'application/pdf' OR ends_with(lower(path), '.md'))")
def _(s, d):
    return sources.accept_filter(fx.files(s, d))[1].select("doc_id", "path", "message")


@query("a3_file_facts", "SELECT f.doc_id, round(length / 1024 / 1024, 2) AS size_mb, coalesce(pages, 0) AS pages FROM files f LEFT JOIN (SELECT doc_id, count(*) AS pages FROM page_items GROUP BY 1) p USING (doc_id)")
def _(s, d):
    return sources.file_facts(fx.files(s, d), fx.page_items(s, d))


_BASE = f"coalesce(nullif({_trim('title')}, ''), nullif(regexp_replace(path, '(?i)\\.(pdf|md)$', ''), ''), 'document')"
_NAMED = {"named": "SELECT doc_id, path, CASE WHEN doc_id % 4 = 0 THEN ' 　' WHEN doc_id % 4 = 1 THEN ' T ' || doc_id ELSE NULL END AS title FROM files"}


def _named(s, d):
    return fx.files(s, d).selectExpr("doc_id", "path", "CASE WHEN doc_id % 4 = 0 THEN ' 　' WHEN doc_id % 4 = 1 THEN ' T ' || doc_id ELSE NULL END AS title")


@query("t16_base_name", f"SELECT doc_id, {_BASE} AS base FROM named", _NAMED)
def _(s, d):
    return _named(s, d).select("doc_id", X.base_name(F.col("title"), F.col("path")).alias("base"))


@query("t17_download_name", f"SELECT doc_id, {_BASE} || CASE WHEN doc_id % 2 = 0 THEN '_翻譯' ELSE '' END || '.md' AS by_mode, {_BASE} || '_翻譯.epub' AS package FROM named", _NAMED)
def _(s, d):
    base, mode = X.base_name(F.col("title"), F.col("path")), F.when(F.col("doc_id") % 2 == 0, "translate").otherwise("extract")
    return _named(s, d).select("doc_id", X.download_name(base, mode, ".md").alias("by_mode"), X.download_name(base, mode, ".epub", always_suffix=True).alias("package"))


@query("t18_to_base64", "SELECT doc_id, base64(encode(markdown)) AS b64 FROM plain_docs")
def _(s, d):
    return fx.plain_docs(s, d).select("doc_id", X.to_base64(F.encode("markdown", "UTF-8")).alias("b64"))


# DuckDB escapes these five marks, which the components of a URI leave as they are
_URL = "url_encode(markdown)"
for _code, _char in ((33, "%21"), (39, "%27"), (40, "%28"), (41, "%29"), (42, "%2A")):
    _URL = f"replace({_URL}, '{_char}', chr({_code}))"


@query("t19_url_name", f"SELECT doc_id, {_URL} AS name FROM plain_docs")
def _(s, d):
    return fx.plain_docs(s, d).select("doc_id", X.url_name(F.col("markdown")).alias("name"))


@query("t20_nonspace_len", f"SELECT doc_id, length(regexp_replace(markdown, '{WS}', '', 'g')) AS n FROM para_docs")
def _(s, d):
    return fx.para_docs(s, d).select("doc_id", X.nonspace_len(F.col("markdown")).alias("n"))


# requests and replies --------------------------------------------------------------------------------------------

_STYLE = {"styled": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'calm' ELSE '' END AS style, glossary, characters FROM analysis"}


def _analysis(s, d):
    return requests.parse_analysis(fx.analysis(s, d)).withColumn("style", F.when(F.col("doc_id") % 2 == 0, "calm").otherwise(""))


def _replies(s, d):
    return requests.parse_reply(fx.raw_replies(s, d))


_BEFORE = "OVER (PARTITION BY r.doc_id ORDER BY r.chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _running_sql(start: str, added: str) -> str:
    given = f"CASE WHEN {start} IN ('無', '') OR {start} IS NULL THEN [] ELSE [{start}] END"
    return f"SELECT r.doc_id, r.chunk_no, array_to_string(list_concat({given}, flatten(coalesce(list(coalesce({added}, [])) {_BEFORE}, []))), chr(10)) AS {start} FROM replies r LEFT JOIN analysis a ON a.doc_id = r.doc_id"


_CONTEXT = {
    "x_glossary": _running_sql("glossary", "new_terms"),
    "x_characters": _running_sql("characters", "new_characters"),
    "x_summary": f"SELECT doc_id, chunk_no, array_to_string(l[greatest(len(l) - 9, 1):], chr(10)) AS plot_summary FROM (SELECT r.doc_id, r.chunk_no, string_split(coalesce(string_agg(CASE WHEN summary <> '' THEN '- ' || summary END, chr(10)) {_BEFORE}, ''), chr(10)) AS l FROM replies r)",
    "x_prev": "SELECT doc_id, chunk_no, source_text, coalesce(right(lag(source_text) OVER w, 1000), '') AS prev_source, coalesce(right(lag(translated) OVER w, 1000), '') AS prev_translation FROM turns JOIN replies USING (doc_id, chunk_no) WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no)",
}


@query("t12_parse_analysis", "SELECT doc_id, glossary, characters FROM analysis")
def _(s, d):
    return requests.parse_analysis(fx.analysis(s, d))


@query("t13_parse_terms", "SELECT doc_id, (n - 1)::INT AS line_no, regexp_extract(ls[n], '^- *([^:]+?) *: *(.+?) *$', 1) AS source_term, regexp_extract(ls[n], '^- *([^:]+?) *: *(.+?) *$', 2) AS target_term FROM (SELECT doc_id, string_split(glossary, chr(10)) AS ls FROM analysis) AS a, unnest(range(1, len(ls) + 1)) AS t(n) WHERE regexp_matches(ls[n], '^- *([^:]+?) *: *(.+?) *$')")
def _(s, d):
    return requests.parse_terms(_analysis(s, d))


@query("t14_parse_reply", "SELECT doc_id, chunk_no, translated, new_terms, new_characters, summary, found_hallucinations, missing_content FROM replies")
def _(s, d):
    return _replies(s, d)


@query("w1_prev_source_tail", "SELECT doc_id, chunk_no, prev_source FROM x_prev", _CONTEXT)
def _(s, d):
    return requests.prev_source_tail(fx.turns(s, d))


@query("w2_prev_translation_tail", "SELECT doc_id, chunk_no, prev_translation FROM x_prev", _CONTEXT)
def _(s, d):
    return requests.prev_translation_tail(_replies(s, d))


@query("w3_running_glossary", "SELECT doc_id, chunk_no, glossary FROM x_glossary", _CONTEXT)
def _(s, d):
    return requests.running_glossary(_replies(s, d), _analysis(s, d))


@query("w3_running_characters", "SELECT doc_id, chunk_no, characters FROM x_characters", _CONTEXT)
def _(s, d):
    return requests.running_characters(_replies(s, d), _analysis(s, d))


@query("w4_rolling_summary", "SELECT doc_id, chunk_no, plot_summary FROM x_summary", _CONTEXT)
def _(s, d):
    return requests.rolling_summary(_replies(s, d))


@query("w7_running_translated_text", "SELECT doc_id, chunk_no, string_agg(translated || chr(10) || chr(10), '') OVER (PARTITION BY doc_id ORDER BY chunk_no) AS saved_text FROM replies")
def _(s, d):
    return requests.running_translated_text(_replies(s, d))


@query("j2_requests", "SELECT doc_id, chunk_no, source_text, style, glossary, characters FROM turns LEFT JOIN styled USING (doc_id)", _STYLE)
def _(s, d):
    return requests.requests(fx.turns(s, d), _analysis(s, d))


_REQUEST = """
    SELECT doc_id, chunk_no, 'Style: ' || CASE WHEN coalesce(style, '') IN ('', '無') THEN 'general' ELSE style END
        || chr(10) || 'Glossary:' || chr(10) || CASE WHEN coalesce(g.glossary, '') IN ('', '無') THEN 'keep names and headings the same throughout' ELSE g.glossary END
        || chr(10) || 'Characters:' || chr(10) || CASE WHEN coalesce(c.characters, '') IN ('', '無') THEN 'find the characters and keep them the same' ELSE c.characters END
        || chr(10) || 'The story so far:' || chr(10) || CASE WHEN coalesce(plot_summary, '') IN ('', '無') THEN 'this is the beginning' ELSE plot_summary END
        || CASE WHEN prev_source = '' THEN '' ELSE chr(10) || chr(10) || 'Previous source:' || chr(10) || prev_source || chr(10) || 'Previous translation:' || chr(10) || prev_translation END
        || chr(10) || chr(10) || 'Translate:' || chr(10) || source_text AS request
    FROM x_prev JOIN x_glossary g USING (doc_id, chunk_no) JOIN x_characters c USING (doc_id, chunk_no) JOIN x_summary USING (doc_id, chunk_no) LEFT JOIN styled USING (doc_id)"""


@query("t15_build_request", _REQUEST, _CONTEXT | _STYLE)
def _(s, d):
    return requests.build_request(requests.request_context(fx.turns(s, d), _replies(s, d), _analysis(s, d)))


@query("j3_replies_to_chunks", "SELECT doc_id, chunk_no, source_text, translated FROM turns JOIN replies USING (doc_id, chunk_no)")
def _(s, d):
    return requests.replies_to_chunks(fx.turns(s, d), _replies(s, d).select("doc_id", "chunk_no", "translated"))


@query("g3_assemble_translation", "SELECT doc_id, string_agg(translated || chr(10) || chr(10), '' ORDER BY chunk_no) AS translated_text FROM replies GROUP BY doc_id")
def _(s, d):
    return requests.assemble_translation(_replies(s, d))


@query("g4_glossary_final", "SELECT a.doc_id, array_to_string(list_concat(CASE WHEN glossary IN ('無', '') THEN [] ELSE [glossary] END, coalesce(terms, [])), chr(10)) AS glossary FROM analysis a LEFT JOIN (SELECT doc_id, flatten(list(coalesce(new_terms, []) ORDER BY chunk_no)) AS terms FROM replies GROUP BY doc_id) t ON t.doc_id = a.doc_id")
def _(s, d):
    return requests.glossary_final(_analysis(s, d), _replies(s, d))


@query("s3_analysis_prefix", "SELECT doc_id, substr(markdown, 1, 50000) AS for_terms, substr(markdown, 1, 30000) AS for_style FROM plain_docs")
def _(s, d):
    return fx.plain_docs(s, d).select("doc_id", X.analysis_prefix(F.col("markdown"), X.TERMS_CHARS).alias("for_terms"), X.analysis_prefix(F.col("markdown"), X.STYLE_CHARS).alias("for_style"))


# attempts --------------------------------------------------------------------------------------------------------

_SHORT = {"tries": f"SELECT doc_id, chunk_no, (chunk_no % 4)::INT AS retries, source, CASE WHEN chunk_no % 3 = 0 THEN substr(target, 1, 2) ELSE target END AS target, length(regexp_replace(source, '{WS}', '', 'g')) AS ns FROM pairs", "short": f"SELECT *, ns > 150 AND length(regexp_replace(target, '{WS}', '', 'g')) < ns * 0.02::DOUBLE AS short FROM tries"}


def _tries(s, d):
    return fx.pairs(s, d).selectExpr("doc_id", "chunk_no", "CAST(chunk_no % 4 AS INT) AS retries", "source", "CASE WHEN chunk_no % 3 = 0 THEN substr(target, 1, 2) ELSE target END AS target")


@query("p2_suspiciously_short", "SELECT doc_id, chunk_no, short FROM short", _SHORT)
def _(s, d):
    return _tries(s, d).select("doc_id", "chunk_no", X.suspiciously_short(F.col("source"), F.col("target")).alias("short"))


@query("p3_short_outcome", "SELECT doc_id, chunk_no, retries, CASE WHEN short AND retries < 2 THEN 'retry' WHEN short THEN 'accept_warn' ELSE 'ok' END AS outcome FROM short", _SHORT)
def _(s, d):
    return attempts.short_outcome(_tries(s, d))


_RETRY = "(coalesce(http_status = 429, false) OR regexp_matches(lower(coalesce(error_message, '')), '429|quota|rate limit|suspiciously short'))"


@query("p4_is_retryable", f"SELECT doc_id, chunk_no, attempt_no, {_RETRY} AS retryable FROM attempts")
def _(s, d):
    return fx.attempts(s, d).select("doc_id", "chunk_no", "attempt_no", X.is_retryable(F.col("http_status"), F.col("error_message")).alias("retryable"))


@query("p5_missing_content", "SELECT doc_id, chunk_no, attempt_no, missing_content AND attempt_no < 6 AS retry FROM attempts")
def _(s, d):
    return attempts.missing_content(fx.attempts(s, d))


@query("g6_attempt_stats", "SELECT doc_id, chunk_no, count(*) AS attempts, max(attempt_no) AS final_attempt, arg_max(error_message, attempt_no) FILTER (error_message IS NOT NULL) AS last_error FROM attempts GROUP BY 1, 2")
def _(s, d):
    return attempts.attempt_stats(fx.attempts(s, d))


_OUTCOME = {
    "o_end": f"SELECT *, CASE WHEN (error_message IS NOT NULL OR coalesce(http_status >= 400, false)) THEN CASE WHEN NOT {_RETRY} OR attempt_no >= 6 THEN 'failed' END WHEN missing_content AND attempt_no < 6 THEN NULL ELSE 'accepted' END AS done FROM attempts",
    "outcomes": "SELECT doc_id, chunk_no, coalesce(arg_min(done, attempt_no) FILTER (done IS NOT NULL), 'pending') AS outcome, coalesce(min(attempt_no) FILTER (done IS NOT NULL), max(attempt_no)) AS attempt_no FROM o_end GROUP BY 1, 2",
}


@query("r1_translation_outcome", "SELECT doc_id, chunk_no, outcome, attempt_no FROM outcomes", _OUTCOME)
def _(s, d):
    return attempts.translation_outcome(fx.attempts(s, d))


@query("r2_extraction_outcome", "SELECT doc_id, batch_no, CASE WHEN bool_or(ok) THEN 'accepted' WHEN count(*) >= 3 AND bool_and(is_last) AND NOT bool_or(has_raw) THEN 'empty' WHEN count(*) >= 3 THEN 'failed' ELSE 'pending' END AS outcome FROM extraction_attempts GROUP BY 1, 2")
def _(s, d):
    return attempts.extraction_outcome(fx.extraction_attempts(s, d))


@query("r3_document_status", "SELECT doc_id, CASE WHEN bool_or(outcome = 'failed') THEN 'error' WHEN bool_and(outcome = 'accepted') THEN 'completed' ELSE 'translating' END AS status FROM outcomes GROUP BY 1", _OUTCOME)
def _(s, d):
    return attempts.document_status(attempts.translation_outcome(fx.attempts(s, d)))


@query("w6_eta", """
    SELECT id, ts, current_chunk, CASE WHEN current_chunk > 0 THEN floor(spent / current_chunk * rest / 1e6 + 0.5)::BIGINT END AS eta_seconds, CASE WHEN here > 0 THEN floor(spent / here * rest / 1e6 + 0.5)::BIGINT END AS eta_this_run
    FROM (SELECT *, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY id) AS spent, total_chunks - current_chunk AS rest, current_chunk - first_value(current_chunk) OVER (PARTITION BY id ORDER BY ts, current_chunk) AS here FROM history_log)""")  # fmt: skip
def _(s, d):
    return attempts.eta(fx.history_log(s, d))


# quality ---------------------------------------------------------------------------------------------------------


def _n(c: str, pattern: str) -> str:
    return f"coalesce(len(regexp_extract_all({c}, '{pattern}')), 0)::BIGINT"


#: The kinds of a block's blocks by what it was made from, and counts of kinds.
_BLOCK_KINDS = "CASE k WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'p' WHEN 3 THEN 'c' WHEN 4 THEN 'uuu' WHEN 5 THEN 'q' WHEN 6 THEN 'rp' WHEN 7 THEN 'oo' ELSE '4' END"
_PARITY = ", ".join(f"length({side}) - length(translate({side}, '{letters}', '')) AS {side}_{name}" for name, letters in (("headings", "124"), ("items", "uo"), ("paragraphs", "p")) for side in ("source", "target"))


@query(
    "t21_markdown_parity", f"SELECT doc_id, 0 AS chunk_no, {_PARITY}, levenshtein(source, target) AS edits, (list_filter(range(1, greatest(length(source), length(target)) + 1), lambda x: substr(source, x, 1) <> substr(target, x, 1))[1] - 1)::INT AS first_edit, source = target AS parity FROM k_pair",
    {"k_block": f"SELECT doc_id, i, {fx.BLOCK_PLACE} AS j, {_BLOCK_KINDS} AS kinds FROM b_block",
     "k_pair": "SELECT doc_id, string_agg(kinds, '' ORDER BY i) AS source, coalesce(string_agg(kinds, '' ORDER BY j) FILTER (j IS NOT NULL), '') || CASE WHEN doc_id % 4 = 3 THEN 'p' ELSE '' END AS target FROM k_block GROUP BY doc_id"},
)
def _(s, d):
    return quality.markdown_parity(fx.block_pairs(s, d))


@query("t22_untranslated_residue", f"SELECT doc_id, chunk_no, {_n("regexp_replace(target, '[(（][^()（）]*[)）]', '', 'g')", '[A-Za-z]+([ ,;]+[A-Za-z]+){3,}[.!?]')} AS latin_sentences FROM pairs")
def _(s, d):
    return quality.untranslated_residue(fx.pairs(s, d))


@query("t23_dialogue_breaks", "SELECT doc_id, chunk_no, len(list_filter(string_split_regex(target, '\\n\\n+'), lambda p: len(regexp_extract_all(p, '「[^「」]*」')) >= 2))::BIGINT AS crowded_paragraphs FROM pairs")
def _(s, d):
    return quality.dialogue_breaks(fx.pairs(s, d))


@query("t24_fullwidth_punct", f"SELECT doc_id, chunk_no, {_n('target', '[一-鿿][,.!?;:]|[,.!?;:][一-鿿]')} AS halfwidth_marks FROM pairs")
def _(s, d):
    return quality.fullwidth_punct(fx.pairs(s, d))


_CITED = {"cited": "SELECT doc_id, replace(replace(markdown, '. ', ' [' || doc_id || ']. '), ', ', '^' || (doc_id % 10) || ', ') AS markdown FROM plain_docs"}


@query("t25_citation_markers", "SELECT doc_id, (p - 1)::INT AS position, ms[p] AS marker FROM (SELECT doc_id, regexp_extract_all(markdown, '\\[[0-9]+\\]|\\^[0-9]+') AS ms FROM cited) AS a, unnest(range(1, len(ms) + 1)) AS t(p)", _CITED)
def _(s, d):
    return quality.citation_markers(fx.plain_docs(s, d).selectExpr("doc_id", "replace(replace(markdown, '. ', ' [' || doc_id || ']. '), ', ', '^' || (doc_id % 10) || ', ') AS markdown"))


@query("j6_glossary_compliance", "SELECT p.doc_id, p.chunk_no, source_term, target_term, contains(target, target_term) AS complies FROM pairs p JOIN terms t ON t.doc_id = p.doc_id WHERE contains(source, source_term)")
def _(s, d):
    return quality.glossary_compliance(fx.pairs(s, d), fx.terms(s, d))


# history ---------------------------------------------------------------------------------------------------------

_NOW = "id, title, author, cover, current_chunk, total_chunks, status, ts, model"


@query("w5_history_current", f"SELECT {_NOW} FROM history_now")
def _(s, d):
    return history.history_current(fx.history_log(s, d))


@query("a10_history_delete", f"SELECT {_NOW} FROM history_now WHERE id NOT IN (SELECT id FROM tombstones)")
def _(s, d):
    return history.history_delete(fx.history_log(s, d), fx.tombstones(s, d))


@query("j4_history_minus_deleted", f"SELECT {_NOW} FROM history_log WHERE id NOT IN (SELECT id FROM tombstones)")
def _(s, d):
    return history.history_minus_deleted(fx.history_log(s, d), fx.tombstones(s, d))


@query("s1_history_list", f"SELECT {_NOW} FROM history_now ORDER BY ts DESC, id")
def _(s, d):
    return history.history_list(fx.history_log(s, d))


@query("s2_history_get", f"SELECT {_NOW} FROM history_now WHERE id = 7")
def _(s, d):
    return history.history_get(fx.history_log(s, d), 7)


@query("j5_pending_chunks", "SELECT doc_id, chunk_no FROM turns WHERE (doc_id, chunk_no) NOT IN (SELECT (doc_id, chunk_no) FROM outcomes WHERE outcome = 'accepted')", _OUTCOME)
def _(s, d):
    accepted = attempts.translation_outcome(fx.attempts(s, d)).where("outcome = 'accepted'")
    return history.pending_chunks(fx.turns(s, d).select("doc_id", "chunk_no"), accepted)


_STATE = "CAST(id % 4 * 2 AS INT) AS current_chunk, CAST(CASE WHEN id % 3 = 0 THEN id % 4 * 2 ELSE 9 END AS INT) AS total_chunks"


@query("p10_resume_filter", "SELECT t.doc_id, t.chunk_no FROM turns t LEFT JOIN states s ON s.doc_id = t.doc_id WHERE t.chunk_no >= coalesce(CASE WHEN s.current_chunk = s.total_chunks AND s.total_chunks > 0 THEN 0 ELSE s.current_chunk END, 0)", {"states": f"SELECT id AS doc_id, {_STATE} FROM history_now WHERE id % 5 <> 0"})
def _(s, d):
    state = history.history_current(fx.history_log(s, d)).where("id % 5 <> 0").selectExpr("id AS doc_id", *_STATE.replace(", CAST", ";CAST").split(";"))
    return history.resume_filter(fx.turns(s, d).select("doc_id", "chunk_no"), state)


_STAGED = "doc_id, source_text AS extracted_text, 'T' || source_text AS translated_text, CASE chunk_no % 3 WHEN 0 THEN 'extracting' WHEN 1 THEN 'translating' END AS stage"


@query("p9_select_text", "SELECT doc_id, CASE WHEN coalesce(stage, '') IN ('extracting', 'analyzing') THEN extracted_text ELSE translated_text END AS text FROM staged", {"staged": f"SELECT {_STAGED} FROM turns"})
def _(s, d):
    return history.select_text(fx.turns(s, d).selectExpr("doc_id", "source_text AS extracted_text", "'T' || source_text AS translated_text", "CASE chunk_no % 3 WHEN 0 THEN 'extracting' WHEN 1 THEN 'translating' END AS stage"), "translate")


# model function, files and streams -------------------------------------------------------------------------------


def _reversed(request: str) -> str:
    if len(request) % 7 == 0:
        raise ValueError("seven")
    return request[::-1]


@query("u1_run_model", "SELECT doc_id, chunk_no, CASE WHEN length(source_text) % 7 <> 0 THEN length(source_text) END AS n, CASE WHEN length(source_text) % 7 = 0 THEN 'seven' END AS error_message FROM turns")
def _(s, d):
    asked = fx.turns(s, d).withColumnRenamed("source_text", "request")
    return model.run_model(asked, _reversed).select("doc_id", "chunk_no", F.char_length("reply").cast("long").alias("n"), "error_message")


def _follow(request: str, previous: str) -> str:
    return f"{len(request) + int(previous or 0)}"


@query("u2_translate_in_order", "SELECT doc_id, chunk_no, (sum(length(source_text)) OVER (PARTITION BY doc_id ORDER BY chunk_no))::VARCHAR AS reply FROM turns")
def _(s, d):
    return model.translate_in_order(fx.turns(s, d).withColumnRenamed("source_text", "request"), _follow).select("doc_id", "chunk_no", "reply")


def _draft(request: str) -> str:
    return "T" + request.rsplit("\n\nTranslate:\n", 1)[1]


def _correction(request: str, draft: str) -> str:
    n = len(draft)
    return json.dumps({"newTerms": [f"t{n}", "-"], "newCharacters": [f"c{n}"] * (n % 2), "chunkSummary": f"s{n}\nx"})


_CORRECTED = {"replies": "SELECT doc_id, chunk_no, 'T' || source_text AS translated, ['t' || (length(source_text) + 1), '-'] AS new_terms, CASE WHEN length(source_text) % 2 = 0 THEN ['c' || (length(source_text) + 1)] ELSE [] END AS new_characters, 's' || (length(source_text) + 1) || chr(10) || 'x' AS summary FROM turns"}


@query("u2_translate_with_context", f"SELECT doc_id, chunk_no, 1 AS attempt_no, sha256(request) AS request_sha256, replies.translated FROM ({_REQUEST}) AS asked JOIN replies USING (doc_id, chunk_no)", _CONTEXT | _STYLE | _CORRECTED)
def _(s, d):
    asked = requests.requests(fx.turns(s, d), _analysis(s, d))
    return model.translate_with_context(asked, _draft, _correction).select("doc_id", "chunk_no", "attempt_no", "request_sha256", "translated")


@query("a2_scan_markdown", "SELECT 'doc ' || doc_id || '.md' AS file_name, markdown FROM md_docs")
def _(s, d):
    folder = f"{shared_folder(s)}/markdown"
    export.write_markdown(_named_docs(s, d), folder)
    return sources.scan_markdown(s, folder)


@query("a6_write_markdown", "SELECT 'doc ' || doc_id || '.md' AS file_name, strlen(markdown) AS bytes, sha256(markdown) AS sha256, 'text/markdown' AS mime FROM md_docs")
def _(s, d):
    folder = f"{shared_folder(s)}/markdown"
    export.write_markdown(_named_docs(s, d), folder)
    return sources.scan_files(s, folder).select(sources.own_name().alias("file_name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "mime")


def _named_docs(s, d):
    return fx.md_docs(s, d).selectExpr("'doc ' || doc_id || '.md' AS file_name", "markdown AS text")


@query("a9_history_append", f"SELECT {_NOW} FROM history_now")
def _(s, d):
    folder, log = f"{shared_folder(s)}/history", fx.history_log(s, d)
    for early in (True, False):
        part = log.where((F.col("ts") < "2024-01-10") == early)
        history.history_append(part.withColumns({"translation_style": F.lit(""), "glossary_text": F.lit(None).cast("string")}), folder)
    return history.history_current(s.read.parquet(folder)).drop("translation_style", "glossary_text")


def _streamed(s, rows, part, stream, keys, merge):
    """The current rows after three runs of a stream: each on what has arrived since, with a third of what came before it again."""
    folder, rows = shared_folder(s), rows.withColumn("part", part)
    for n in range(3):
        arrived = rows.where((F.col("part") == n) | ((F.col("part") == n - 1) & (F.pmod(F.xxhash64(*keys), F.lit(3)) == 0))).drop("part")
        arrived.write.mode("append").parquet(f"{folder}/in")
        found = streams.run_to_end(stream(s.readStream.schema(arrived.schema).parquet(f"{folder}/in")), folder, keys, merge)
    return found


@query("st1_stream_drafts", "SELECT doc_id, chunk_no, string_agg(coalesce(text, ''), '' ORDER BY seq) AS draft_text, true AS final FROM fragments GROUP BY 1, 2")
def _(s, d):
    drafts = _streamed(s, fx.sent_fragments(s, d), F.expr("least(chunk_no, 2)"), streams.stream_drafts, ["doc_id", "chunk_no"], streams.longest_draft)
    return drafts.select("doc_id", "chunk_no", "draft_text", "final")


@query("st2_stream_progress", "SELECT doc_id, count(text) AS done, count(*) AS total, floor(100.0::DOUBLE * count(text) / count(*) + 0.5)::BIGINT AS percent FROM batch_texts GROUP BY doc_id")
def _(s, d):
    replies = fx.batch_texts(s, d).withColumn("event_time", fx.minute("batch_no"))
    return streams.with_percent(_streamed(s, replies, F.expr("least(batch_no, 2)"), streams.stream_progress, ["doc_id"], streams.added_progress))


@query("st3_stream_history", f"SELECT {_NOW} FROM history_now")
def _(s, d):
    log = fx.history_log(s, d)
    return _streamed(s, log, F.pmod(F.xxhash64("ts"), F.lit(3)), streams.stream_history, ["id"], history.history_current)


# whole plans -----------------------------------------------------------------------------------------------------


@query("lifecycle_estimate", "SELECT doc_id, model_id, tokens, floor(tokens * 2.5::DOUBLE + 0.5)::BIGINT AS output_tokens, round(tokens / 1e6 * i + floor(tokens * 2.5::DOUBLE + 0.5) / 1e6 * o, 9) AS usd FROM (SELECT doc_id, pages * 600 * 20 AS tokens FROM page_counts) CROSS JOIN prices", _COST)
def _(s, d):
    return lifecycle.estimate(fx.page_counts(s, d), 600, cost.price_list(s)).select("doc_id", "model_id", "tokens", "output_tokens", F.round("usd", 9).alias("usd"))


@query("lifecycle_convert", _ENTRIES, _CHAPTERS | {"b_source": "SELECT * FROM b_lines", "h_odd": "SELECT doc_id, 2 AS r FROM b_block WHERE false", "md_some": "SELECT doc_id, 'x' AS markdown FROM b_block"})
def _(s, d):
    return lifecycle.convert(fx.block_pages(s, d), _meta(s, d))


def _count(request: str) -> str:
    """Characters of the chunk and lines of the glossary, long enough for a draft, but some chunks fail."""
    n = len(request.split("\n\nTranslate:\n", 1)[1])
    if n % 11 == 3:
        raise ValueError("no")
    return f"{n}/{request.split('Glossary:', 1)[1].split('Characters:', 1)[0].count(chr(10)) - 1}{'.' * 100}"


def _term(request: str, draft: str) -> str:
    return json.dumps({"newTerms": [draft]})


_TRANSLATED = """
    SELECT doc_id, CASE WHEN bad THEN 'error' ELSE 'completed' END AS status, CASE WHEN NOT bad THEN text END AS translated_text,
        CASE WHEN NOT bad THEN array_to_string(list_concat(CASE WHEN known = '' THEN [] ELSE [known] END, parts), chr(10)) END AS glossary
    FROM (SELECT doc_id, any_value(known) AS known, bool_or(bad) AS bad, string_agg(part || chr(10) || chr(10), '' ORDER BY chunk_no) AS text, list(part ORDER BY chunk_no) AS parts
        FROM (SELECT doc_id, chunk_no, known, n_chars % 11 = 3 AS bad, n_chars || '/' || greatest(1, chunk_no + CASE WHEN known = '' THEN 0 ELSE len(string_split(known, chr(10))) END) || repeat('.', 100) AS part
            FROM (SELECT c_chunk.*, coalesce(nullif(glossary, '無'), '') AS known FROM c_chunk LEFT JOIN analysis USING (doc_id)))
        GROUP BY doc_id)"""


@query("lifecycle_translate", _TRANSLATED, _chunk_sql("plain_docs", 3500))
def _(s, d):
    found = _analysis(s, d).select("doc_id", "style", "glossary", "characters")
    return lifecycle.translate(fx.plain_docs(s, d), found, _count, _term)


def _stops(request: str) -> str:
    """As `_count`, but the worker ends with some chunks."""
    if len(request.split("\n\nTranslate:\n", 1)[1]) % 37 == 5:
        raise SystemExit("the worker ends here")
    return _count(request)


@query("lifecycle_translate_resumed", _TRANSLATED, _chunk_sql("plain_docs", 3500))
def _(s, d):
    found, log = _analysis(s, d).select("doc_id", "style", "glossary", "characters"), shared_folder(s)
    try:
        lifecycle.translate(fx.plain_docs(s, d), found, _stops, _term, log=log)
    except PySparkException:  # the run ended with its workers; the next one goes on from its log
        pass
    return lifecycle.translate(fx.plain_docs(s, d), found, _count, _term, log=log)


def _flaky(folder: str):
    """A model function that fails at the first call for some requests and at every call for others."""

    def fn(request: str) -> str:
        n = len(request)
        calls = AttemptLog(folder, model.ATTEMPT)
        name = hashlib.sha256(request.encode()).hexdigest()
        if n % 13 == 3 and not calls.chunks(name):
            calls.commit(name, 1, [{}])
            raise ValueError("at first")
        if n % 29 == 5:
            raise ValueError("at every call")
        return f" {n}\n{request.split(chr(10), 1)[1]}"

    return fn


_RAW_TEXT = f"length(regexp_replace(raw_text, '{WS}', '', 'g')) > 10"
_EXTRACT = {
    "e_raw": "SELECT doc_id, ((page_no - 1) // 5)::INT AS batch_no, string_agg(text || chr(10), '' ORDER BY page_no) AS raw_text FROM page_text GROUP BY 1, 2",
    "e_ask": f"SELECT *, {_RAW_TEXT} AS has_raw, CASE WHEN {_RAW_TEXT} THEN raw_text ELSE 'pages from ' || (batch_no * 5 + 1) END AS body, CASE WHEN {_RAW_TEXT} THEN 'repair' ELSE 'ocr' END || chr(10) AS head, batch_no = max(batch_no) OVER (PARTITION BY doc_id) AS is_last FROM e_raw",
    "e_end": "SELECT *, length(head || body) % 29 = 5 AS bad, bad AND NOT (is_last AND NOT has_raw) AS failed, CASE WHEN bad THEN '' ELSE ' ' || length(head || body) || chr(10) || body END AS text FROM e_ask",
}


@query("lifecycle_extract", f"SELECT doc_id, CASE WHEN bool_or(failed) THEN 'error' ELSE 'completed' END AS status, CASE WHEN NOT bool_or(failed) THEN {_trim("string_agg(text, chr(10) || chr(10) ORDER BY batch_no)")} END AS markdown FROM e_end GROUP BY doc_id", _EXTRACT)
def _(s, d):
    return lifecycle.extract(fx.page_items(s, d), _flaky(shared_folder(s)))


def _analyst(request: str) -> str:
    n = len(request.removeprefix(requests.TERMS_REQUEST).removeprefix(requests.STYLE_REQUEST))
    if n % 5 == 0:
        raise ValueError("five")
    if request.startswith(requests.STYLE_REQUEST):
        return " " if n % 3 == 0 else f" style {n}\n"
    return "nothing" if n % 3 == 0 else f"{requests.TERMS_HEAD}\n- a{n}: 甲\n{requests.CHARACTERS_HEAD} C{n}"


_PREPARE = {
    "n_docs": "SELECT doc_id, least(length(markdown), 50000) AS t, least(length(markdown), 30000) AS y FROM plain_docs WHERE markdown IS NOT NULL",
    "n_found": "SELECT doc_id, CASE WHEN y % 5 = 0 OR y % 3 = 0 THEN 'general' ELSE 'style ' || y END AS style, CASE WHEN t % 5 = 0 OR t % 3 = 0 THEN '無' ELSE '- a' || t || ': 甲' END AS glossary, CASE WHEN t % 5 = 0 OR t % 3 = 0 THEN '無' ELSE 'C' || t END AS characters FROM n_docs WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, 'kept', 'g', 'c' FROM plain_docs WHERE doc_id % 4 = 0",
}


@query("lifecycle_prepare", "SELECT doc_id, chunk_no, source_text, n_chars, style, glossary, characters FROM c_chunk LEFT JOIN n_found USING (doc_id)", _chunk_sql("plain_docs", 3500) | _PREPARE)
def _(s, d):
    docs = fx.plain_docs(s, d)
    saved = docs.where("doc_id % 4 = 0").selectExpr("doc_id", "'kept' AS style", "'g' AS glossary", "'c' AS characters")
    return lifecycle.prepare(docs, _analyst, saved=saved)
