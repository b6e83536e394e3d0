"""Tables of the engine's schemas, derived from the driver's tables: as DataFrames, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docprep.sources.folders import dealt_out

#: Expressions that Spark and DuckDB read alike.
NL = "chr(10)"
REPLY_TEXT = "replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n')"
REPLY_JSON = (
    "'{\"correctedTranslation\":\"' || CASE WHEN (doc_id + chunk_no) % 5 = 0 THEN '' ELSE 'T: ' || " + REPLY_TEXT + " END"
    " || '\",\"newTerms\":[' || CASE WHEN chunk_no % 2 = 0 THEN '\"- term' || chunk_no || ': 詞' || chunk_no || '\",\"- second' || doc_id || ': 二\"' ELSE '' END"
    " || '],\"newCharacters\":[' || CASE WHEN chunk_no % 3 = 1 THEN '\"- name' || chunk_no || '\"' ELSE '' END"
    " || '],\"chunkSummary\":\"' || CASE WHEN chunk_no % 4 = 3 THEN '' WHEN chunk_no % 3 = 0 THEN 'part ' || chunk_no || chr(92) || 'ngoes on' ELSE 'part ' || chunk_no END"
    " || '\",\"foundHallucinations\":' || CASE WHEN chunk_no % 4 = 0 THEN 'true' ELSE 'false' END"
    " || ',\"missingContentDetected\":' || CASE WHEN chunk_no % 6 = 5 THEN 'true' ELSE 'false' END || '}'"
)
CUT_JSON = f"CASE WHEN (doc_id * 31 + chunk_no) % 7 = 0 THEN substr({REPLY_JSON}, 1, 20) WHEN (doc_id + chunk_no) % 11 = 3 THEN ' ' ELSE {REPLY_JSON} END"
STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'translating' END"
HTTP = "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 429 WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 500 END"
MESSAGE = "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'Resource exhausted: Quota' WHEN event_type = 'error' THEN 'Translated text is suspiciously short' WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'Internal' END"
PATH = "url || CASE page_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.MD' ELSE '' END"
MIME = "CASE WHEN page_id % 5 = 0 THEN 'application/pdf' ELSE 'text/html' END"
IMAGES = "html || '<img src=\"a\"><IMG src=\"b\"><picture>x' || chr(10) || '</picture>y<SVG><path/></SVG>'"
ANALYSIS = "CASE doc_id % 4 WHEN 0 THEN '【術語表】：' || chr(10) || '- alpha: 甲' || chr(10) || '- beta ray: 乙' || chr(10) || '【角色圖譜】：' || chr(10) || '- Ann: x' WHEN 1 THEN '【角色圖譜】： Bob ' WHEN 2 THEN '【術語表】：【角色圖譜】：' ELSE 'nothing' END"


#: A block of Markdown of the `k`-th kind from words `w` and a `tag`, and the HTML that it stands for.
BLOCK_MD = f"""CASE k WHEN 0 THEN '# ' || w || ' #' WHEN 1 THEN w || {NL} || '----' WHEN 2 THEN w || {NL} || 'x **' || tag || '** `a<b*` [l](http://e/?a=1&b=2) *i* & ![p](q.png)done'
    WHEN 3 THEN '```py' || {NL} || '# ' || w || {NL} || '~~~' || {NL} || '```' WHEN 4 THEN '- ' || w || {NL} || '  - in' || {NL} || '- **b**' WHEN 5 THEN '> ' || w || {NL} || '> q'
    WHEN 6 THEN '***' || {NL} || w WHEN 7 THEN '1. ' || w || {NL} || '2. z' ELSE '#### ' || w END"""
BLOCK_HTML = f"""CASE k WHEN 0 THEN '<h1>' || w || '</h1>' || {NL} WHEN 1 THEN '<h2>' || w || '</h2>' || {NL}
    WHEN 2 THEN '<p>' || w || {NL} || 'x <strong>' || tag || '</strong> <code>a&lt;b*</code> <a href="http://e/?a=1&amp;b=2">l</a> <em>i</em> &amp; done</p>' || {NL}
    WHEN 3 THEN '<pre><code class="language-py"># ' || w || {NL} || '~~~' || {NL} || '</code></pre>' || {NL}
    WHEN 4 THEN '<ul>' || {NL} || '<li>' || w || '<ul>' || {NL} || '<li>in</li>' || {NL} || '</ul>' || {NL} || '</li>' || {NL} || '<li><strong>b</strong></li>' || {NL} || '</ul>' || {NL}
    WHEN 5 THEN '<blockquote>' || {NL} || '<p>' || w || {NL} || 'q</p>' || {NL} || '</blockquote>' || {NL} WHEN 6 THEN '<hr>' || {NL} || '<p>' || w || '</p>' || {NL}
    WHEN 7 THEN '<ol>' || {NL} || '<li>' || w || '</li>' || {NL} || '<li>z</li>' || {NL} || '</ol>' || {NL} ELSE '<h4>' || w || '</h4>' || {NL} END"""


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return dealt_out(s.read.parquet(f"{d}/{name}.parquet"))


def plain_docs(s, d):
    return _table(s, d, "documents").selectExpr("doc_id", "text AS markdown")


def para_docs(s, d):
    return _table(s, d, "documents").selectExpr("doc_id", f"replace(text, {NL}, {NL} || {NL}) AS markdown")


def md_docs(s, d):
    turns = _table(s, d, "conversations").selectExpr("conv_id AS doc_id", "turn", f"'## ' || role || {NL} || {NL} || text AS part")
    joined = turns.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("turn", "part"))).alias("p"))
    return joined.selectExpr("doc_id", f"'# Conversation ' || doc_id || {NL} || {NL} || array_join(p.part, {NL} || {NL}) AS markdown")


def _line_blocks(s, d):
    lines = _table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "text"))
    return lines.selectExpr("doc_id", "p + 1 AS n", "'doc' AS tag", "text")


def _blocks(rows):
    worded = rows.selectExpr("doc_id", "n", "tag", "trim(regexp_replace(text, '[^A-Za-z]+', ' ')) AS w").where("w <> ''")
    kinds = worded.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))).withColumn("k", (F.col("i") + F.col("doc_id")) % 9)
    return kinds.selectExpr("doc_id", "i", f"{BLOCK_MD} AS md")


def _known_blocks(s, d):
    """The turns of conversations and the lines of documents as blocks."""
    said = _table(s, d, "conversations").selectExpr("conv_id AS doc_id", "turn AS n", "role AS tag", "text")
    return _blocks(said.unionByName(_line_blocks(s, d).withColumn("doc_id", F.col("doc_id") + 1000000)))


def block_docs(s, d):
    """Documents of known blocks."""
    joined = _known_blocks(s, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "md"))).alias("p"))
    return joined.selectExpr("doc_id", f"array_join(p.md, {NL} || {NL}) AS markdown")


#: The place of a block in a translation: some have the first two swapped, some lack the second.
BLOCK_PLACE = "CASE WHEN doc_id % 4 = 1 AND i <= 2 THEN 3 - i WHEN doc_id % 4 = 2 AND i = 2 THEN NULL ELSE i END"


def block_pairs(s, d):
    """Those documents and translations of the same blocks, some in other order, with one less or with a paragraph more."""
    rows = _known_blocks(s, d).withColumn("j", F.expr(BLOCK_PLACE))
    joined = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "md"))).alias("p"), F.array_sort(F.collect_list(F.when(F.col("j").isNotNull(), F.struct("j", "md")))).alias("q"))
    target = f"array_join(q.md, {NL} || {NL}) || CASE WHEN doc_id % 4 = 3 THEN {NL} || {NL} || '好' ELSE '' END"
    return joined.selectExpr("doc_id", "0 AS chunk_no", f"array_join(p.md, {NL} || {NL}) AS source", f"{target} AS target")


def block_pages(s, d):
    """The same of documents as page items."""
    return _blocks(_line_blocks(s, d)).select("doc_id", F.col("i").alias("page_no"), F.split("md", " ", -1).alias("items"))


def page_items(s, d):
    lines = _table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    return lines.select("doc_id", (F.col("p") + 1).alias("page_no"), F.split("line", " ", -1).alias("items"))


def page_counts(s, d):
    parts = _table(s, d, "part").selectExpr("CAST(p_partkey AS BIGINT) AS doc_id", "CAST(p_size AS INT) AS pages")
    return parts.unionByName(parts.selectExpr("doc_id + 1000000 AS doc_id", "pages * 40 AS pages"))


def token_counts(s, d):
    batches = _table(s, d, "documents").selectExpr("doc_id", "n_chars", "explode(sequence(0, CAST(n_chars % 7 AS INT))) AS batch_no")
    return batches.selectExpr("doc_id", "batch_no", "CAST(floor(n_chars / (batch_no + 1)) AS BIGINT) AS tokens")


def turns(s, d):
    return _table(s, d, "conversations").selectExpr("conv_id AS doc_id", "CAST(turn AS INT) AS chunk_no", "text AS source_text")


def pairs(s, d):
    c = _table(s, d, "conversations").where("role IN ('user', 'assistant')")
    user = c.where("role = 'user'").selectExpr("conv_id AS doc_id", "turn", "text AS source")
    reply = c.where("role = 'assistant'").selectExpr("conv_id AS doc_id", "turn - 1 AS turn", "text AS target")
    met = user.join(reply, ["doc_id", "turn"])
    return met.selectExpr("doc_id", "CAST(turn AS INT) AS chunk_no", "source", f"CASE turn % 4 WHEN 2 THEN '「' || substr(target, 1, 9) || '」你好,「' || source || '」' || {NL} || {NL} || '# 好. (see that one two three.)' ELSE target END AS target")


def attempts(s, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _table(s, d, "events").withColumn("n", F.row_number().over(order) - 1)
    return rows.selectExpr("user_id AS doc_id", "CAST(floor(n / 6) AS INT) AS chunk_no", "CAST(n % 6 AS INT) + 1 AS attempt_no", f"{HTTP} AS http_status", f"{MESSAGE} AS error_message", "event_type = 'view' AND event_id % 3 = 0 AS missing_content", "ts")


def extraction_attempts(s, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _table(s, d, "events").withColumn("n", F.row_number().over(order) - 1).withColumn("batch_no", F.floor(F.col("n") / 3).cast("int"))
    rows = rows.withColumn("last", F.max("batch_no").over(Window.partitionBy("user_id")))
    return rows.selectExpr("user_id AS doc_id", "batch_no", "event_id % 4 = 0 AS ok", "batch_no = last AS is_last", "batch_no % 2 = 0 AS has_raw")


def raw_replies(s, d):
    return turns(s, d).withColumnRenamed("source_text", "text").selectExpr("doc_id", "chunk_no", "text AS draft_text", f"{CUT_JSON} AS reply_json")


def analysis(s, d):
    ids = turns(s, d).select("doc_id").distinct()
    return ids.selectExpr("doc_id", f"{ANALYSIS} AS reply")


def minute(number: str):
    """A time for what is sent in the order of a number."""
    return F.expr(f"TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {number})")


def fragments(s, d):
    cut = turns(s, d).selectExpr("doc_id", "chunk_no", "source_text", "explode(sequence(0, CAST(floor((length(source_text) - 1) / 200) AS INT))) AS seq")
    return cut.selectExpr("doc_id", "chunk_no", "seq", "CASE WHEN seq % 9 = 8 THEN NULL ELSE substr(source_text, seq * 200 + 1, 200) END AS text")


def sent_fragments(s, d):
    """Fragments with their time and whether one is its chunk's last."""
    chunk = Window.partitionBy("doc_id", "chunk_no")
    return fragments(s, d).withColumn("last", F.col("seq") == F.max("seq").over(chunk)).withColumn("event_time", minute("chunk_no"))


def batch_texts(s, d):
    rows = turns(s, d).selectExpr("doc_id", "chunk_no AS batch_no", "CASE WHEN (doc_id + chunk_no) % 9 = 4 THEN NULL ELSE ' ' || source_text || '　' END AS text")
    return rows.withColumn("total", F.count("*").over(Window.partitionBy("doc_id")))


def history_log(s, d):
    return history_of(_table(s, d, "events"))


def history_of(events):
    return events.selectExpr(
        "user_id AS id", "'Doc ' || user_id AS title", "'A' AS author", "CASE WHEN event_id % 2 = 0 THEN '' ELSE 'cover.png' END AS cover", "CAST(floor(value) AS INT) AS current_chunk", "491 AS total_chunks", f"{STATUS} AS status", "ts", "'flash' AS model",
    )


def tombstones(s, d):
    return _table(s, d, "events").where("event_type = 'error' AND user_id % 3 = 0").selectExpr("user_id AS id").distinct()


def files(s, d):
    return _table(s, d, "pages").selectExpr("page_id AS doc_id", f"{PATH} AS path", f"{MIME} AS mime", "length(html) AS length")


def html(s, d):
    return _table(s, d, "pages").selectExpr("page_id AS doc_id", "'Page <' || page_id || '>' AS title", f"{IMAGES} AS html")


def terms(s, d):
    first = lambda c, n: F.nullif(F.regexp_extract(c, f"[A-Za-z]{{{n},}}", 0), F.lit(""))
    return pairs(s, d).select("doc_id", first("source", 5).alias("source_term"), first("target", 4).alias("target_term")).where("source_term IS NOT NULL AND target_term IS NOT NULL").distinct()


#: The same in DuckDB, each after those it reads.
SQL = {
    "plain_docs": "SELECT doc_id, text AS markdown FROM documents",
    "para_docs": f"SELECT doc_id, replace(text, {NL}, {NL} || {NL}) AS markdown FROM documents",
    "md_docs": f"SELECT conv_id AS doc_id, '# Conversation ' || conv_id || {NL} || {NL} || string_agg('## ' || role || {NL} || {NL} || text, {NL} || {NL} ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id",
    "b_lines": "SELECT doc_id, p AS n, 'doc' AS tag, lines[p] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) AS l, unnest(range(1, len(lines) + 1)) AS t(p)",
    "b_source": "SELECT conv_id AS doc_id, turn AS n, role AS tag, text FROM conversations UNION ALL SELECT doc_id + 1000000, n, tag, text FROM b_lines",
    "b_kind": "SELECT *, (i + doc_id) % 9 AS k FROM (SELECT doc_id, tag, w, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM (SELECT *, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS w FROM b_source) WHERE w <> '')",
    "b_block": f"SELECT doc_id, i, k, w, {BLOCK_MD} AS md, {BLOCK_HTML} AS html FROM b_kind",
    "page_items": "SELECT doc_id, p::INT AS page_no, string_split(lines[p], ' ') AS items FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) AS l, unnest(range(1, len(lines) + 1)) AS t(p)",
    "page_text": "SELECT doc_id, page_no, array_to_string(items, ' ') AS text FROM page_items",
    "page_counts": "SELECT p_partkey::BIGINT AS doc_id, p_size::INT AS pages FROM part UNION ALL SELECT p_partkey + 1000000, (p_size * 40)::INT FROM part",
    "token_counts": "SELECT doc_id, b::INT AS batch_no, n_chars // (b + 1) AS tokens FROM documents, unnest(range(0, n_chars % 7 + 1)) AS t(b)",
    "turns": "SELECT conv_id AS doc_id, turn::INT AS chunk_no, text AS source_text FROM conversations",
    "pairs": f"SELECT u.conv_id AS doc_id, u.turn::INT AS chunk_no, u.text AS source, CASE u.turn % 4 WHEN 2 THEN '「' || substr(a.text, 1, 9) || '」你好,「' || u.text || '」' || {NL} || {NL} || '# 好. (see that one two three.)' ELSE a.text END AS target FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'",
    "attempts": f"SELECT user_id AS doc_id, (n // 6)::INT AS chunk_no, (n % 6 + 1)::INT AS attempt_no, {HTTP} AS http_status, {MESSAGE} AS error_message, event_type = 'view' AND event_id % 3 = 0 AS missing_content, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)",
    "extraction_attempts": "SELECT user_id AS doc_id, batch_no, event_id % 4 = 0 AS ok, batch_no = max(batch_no) OVER (PARTITION BY user_id) AS is_last, batch_no % 2 = 0 AS has_raw FROM (SELECT *, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 3)::INT AS batch_no FROM events)",
    "raw_replies": f"SELECT doc_id, chunk_no, text AS draft_text, {CUT_JSON} AS reply_json FROM (SELECT doc_id, chunk_no, source_text AS text FROM turns)",
    "replies": "SELECT doc_id, chunk_no, coalesce(nullif(json_extract_string(j, '$.correctedTranslation'), ''), draft_text) AS translated, CAST(json_extract(j, '$.newTerms') AS VARCHAR[]) AS new_terms, CAST(json_extract(j, '$.newCharacters') AS VARCHAR[]) AS new_characters, json_extract_string(j, '$.chunkSummary') AS summary, coalesce(CAST(json_extract(j, '$.foundHallucinations') AS BOOLEAN), false) AS found_hallucinations, coalesce(CAST(json_extract(j, '$.missingContentDetected') AS BOOLEAN), false) AS missing_content FROM (SELECT *, CASE WHEN json_valid(reply_json) THEN reply_json ELSE '{}' END AS j FROM raw_replies)",
    "raw_analysis": f"SELECT doc_id, {ANALYSIS} AS reply FROM (SELECT DISTINCT doc_id FROM turns)",
    "analysis": "SELECT doc_id, CASE WHEN contains(reply, '【術語表】：') THEN trim(regexp_extract(reply, '(?s)【術語表】：(.*?)(【角色圖譜】：|$)', 1), chr(10) || ' ') ELSE '無' END AS glossary, CASE WHEN contains(reply, '【角色圖譜】：') THEN trim(regexp_extract(reply, '(?s)【角色圖譜】：(.*)', 1), chr(10) || ' ') ELSE '無' END AS characters FROM raw_analysis",
    "fragments": "SELECT doc_id, chunk_no, q::INT AS seq, CASE WHEN q % 9 = 8 THEN NULL ELSE substr(source_text, q * 200 + 1, 200) END AS text FROM turns, unnest(range(0, (length(source_text) - 1) // 200 + 1)) AS t(q)",
    "batch_texts": "SELECT doc_id, chunk_no AS batch_no, CASE WHEN (doc_id + chunk_no) % 9 = 4 THEN NULL ELSE ' ' || source_text || '　' END AS text, count(*) OVER (PARTITION BY doc_id) AS total FROM turns",
    "history_log": f"SELECT user_id AS id, 'Doc ' || user_id AS title, 'A' AS author, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'cover.png' END AS cover, floor(value)::INT AS current_chunk, 491 AS total_chunks, {STATUS} AS status, ts, 'flash' AS model FROM events",
    "history_now": "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, current_chunk DESC) AS r FROM history_log) WHERE r = 1",
    "tombstones": "SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'error' AND user_id % 3 = 0",
    "files": f"SELECT page_id AS doc_id, {PATH} AS path, {MIME} AS mime, length(html) AS length FROM pages",
    "html": f"SELECT page_id AS doc_id, 'Page <' || page_id || '>' AS title, {IMAGES} AS html FROM pages",
    "terms": "SELECT DISTINCT doc_id, regexp_extract(source, '[A-Za-z]{5,}') AS source_term, regexp_extract(target, '[A-Za-z]{4,}') AS target_term FROM pairs WHERE regexp_matches(source, '[A-Za-z]{5,}') AND regexp_matches(target, '[A-Za-z]{4,}')",
}
