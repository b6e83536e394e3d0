"""Hand-made cases of the rules that the tables do not reach."""

import hashlib

from pyspark.sql import functions as F

from docprep.functions import text as X
from docprep.operators import attempts, history, model, quality, requests
from docprep.plans import lifecycle
from docprep.sources import export, files


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_short(spark):
    short = X.suspiciously_short(F.col("s"), F.col("t"))
    assert one(spark, short, s="a" * 150, t="") is False
    assert one(spark, short, s="a " * 151, t=None) is True
    assert one(spark, short, s="a" * 200, t="bbbb") is False
    assert one(spark, short, s="a" * 200, t="b　bb") is True


def test_names(spark):
    base = X.base_name(F.col("t"), F.col("f"))
    assert one(spark, base, t=" 　", f="a.PDF") == "a"
    assert one(spark, base, t=None, f="a.md.pdf") == "a.md"
    assert one(spark, base, t=None, f=None) == "document"
    assert one(spark, X.url_name(F.col("t")), t="測 試!'()*~&") == "%E6%B8%AC%20%E8%A9%A6!'()*~%26"


def outcome(spark, tries):
    rows = [(1, 0, i + 1, *t) for i, t in enumerate(tries)]
    frame = spark.createDataFrame(rows, "doc_id long, chunk_no int, attempt_no int, http_status int, error_message string, missing_content boolean")
    r = attempts.translation_outcome(frame).first()
    return r["outcome"], r["attempt_no"]


def test_translation_outcome(spark):
    limit, short, ok, missing = (429, "x", None), (None, "Suspiciously short", None), (None, None, False), (None, None, True)
    assert outcome(spark, [ok, limit]) == ("accepted", 1)
    assert outcome(spark, [limit, ok]) == ("accepted", 2)
    assert outcome(spark, [limit] * 6) == ("failed", 6)
    assert outcome(spark, [limit, (500, "broken", None), ok]) == ("failed", 2)
    assert outcome(spark, [short, short, ok]) == ("accepted", 3)
    assert outcome(spark, [missing] * 6) == ("accepted", 6)
    assert outcome(spark, [missing, limit]) == ("pending", 2)


def test_extraction_outcome(spark):
    rows = [(1, b, False, last, raw) for b, last, raw in ((0, False, False), (1, True, False), (2, True, True)) for _ in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, batch_no int, ok boolean, is_last boolean, has_raw boolean")
    assert {r["batch_no"]: r["outcome"] for r in attempts.extraction_outcome(frame).collect()} == {0: "failed", 1: "empty", 2: "failed"}


def test_rolling_summary(spark):
    rows = [(1, i, "a\nb" if i == 3 else "" if i == 5 else f"s{i}") for i in range(13)]
    found = {r["chunk_no"]: r["plot_summary"] for r in requests.rolling_summary(spark.createDataFrame(rows, "doc_id long, chunk_no int, summary string")).collect()}
    for i in range(13):
        lines = "\n".join(f"- {s}" for _, n, s in rows if n < i and s).split("\n")
        assert found[i] == "\n".join(lines[-10:])


def test_bad_replies_keep_the_draft(spark):
    rows = [(1, 0, "draft", '{"correctedTranslation": "x", "newTerms": ["a"'), (1, 1, "draft", " "), (1, 2, "draft", '{"correctedTranslation": ""}'), (1, 3, "draft", None)]
    frame = spark.createDataFrame(rows, "doc_id long, chunk_no int, draft_text string, reply_json string")
    assert {r["translated"] for r in requests.parse_reply(frame).collect()} == {"draft"}


def test_files(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "# x\n\ny"), ("b.md", ""), ("c.md", None)], "file_name string, text string")
    export.write_markdown(docs, str(tmp_path / "out"))
    kept, rejected = files.accept_filter(spark.createDataFrame([("application/pdf", "x"), (None, "y.MD"), ("text/html", None)], "mime string, path string"))
    assert (kept.count(), rejected.count()) == (2, 1)
    assert [tuple(r) for r in files.scan_markdown(spark, str(tmp_path / "out")).collect()] == [("a.md", "# x\n\ny")]


def test_names_of_files(spark, tmp_path):
    """Names that a folder can't hold, hidden ones, and one name of several texts; a second run writes the same."""
    given = [("a b+%20.md", "1"), ("é/ü\\.md", "2\n"), ("_x.md", "3"), (".md", "4"), (None, "5"), ("", "5"), ("s.md", "6"), ("s.md", "7"), ("s.md", "7"), ("s", "8"), ("s", "9"), ("t.tar.md", "日本"), ("none.md", None)]
    docs = spark.createDataFrame(given, "file_name string, text string")
    mark = lambda text: hashlib.sha256(text.encode()).hexdigest()[:12]
    want = {"a b+%20.md": "1", "é_ü_.md": "2\n", "-_x.md": "3", "-.md": "4", "-": "5", f"s-{mark('6')}.md": "6", f"s-{mark('7')}.md": "7", f"s-{mark('8')}": "8", f"s-{mark('9')}": "9", "t.tar.md": "日本"}
    for _ in range(2):
        index = export.write_markdown(docs.repartition(3), str(tmp_path))
        assert {r["file_name"]: r["markdown"] for r in files.scan_markdown(spark, str(tmp_path)).collect()} == want
        rows = {tuple(r) for r in index.collect()}
        assert index.count() == len(want) and rows == {(k, len(v.encode()), hashlib.sha256(v.encode()).hexdigest()) for k, v in want.items()}
    assert (tmp_path / "é_ü_.md").read_bytes() == b"2\n" and not list((tmp_path / "_writing").iterdir())
    assert export.write_markdown(docs.where("false"), str(tmp_path / "none")).count() == 0


def test_model_failures_end_a_document(spark):
    def fn(request, previous):
        if request == "bad":
            raise ValueError("no")
        return previous + request

    frame = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "bad"), (2, 1, "c")], "doc_id long, chunk_no int, request string")
    found = {(r["doc_id"], r["chunk_no"]): (r["reply"], r["error_message"]) for r in model.translate_in_order(frame, fn).collect()}
    assert found == {(1, 0): ("a", None), (1, 1): ("ab", None), (2, 0): (None, "no")}


def test_long_texts_without_an_end(spark):
    """A megabyte of words: no pattern may recurse once for each of them."""
    words = "word " * 200_000
    pairs = spark.createDataFrame([(1, 0, words, words), (1, 1, "a", words + "end."), (1, 2, "a", "one two three. one, two; three four! (a b c d e.)")], "doc_id long, chunk_no int, source string, target string")
    assert {r["chunk_no"]: r["latin_sentences"] for r in quality.untranslated_residue(pairs).collect()} == {0: 0, 1: 1, 2: 1}
    for check in (quality.markdown_parity, quality.dialogue_breaks, quality.fullwidth_punct):
        assert check(pairs).count() == 3


def test_dates_are_in_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Taipei")
        docs = spark.sql("SELECT 1 AS doc_id, '' AS title, '' AS author, '' AS cover, timestamp'2024-01-01 08:30:00' AS ts")
        assert export.export_metadata(docs).first()["date"] == "2024-01-01T00:30:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_record_saved_after_its_tombstone_is_back(spark):
    log = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "id long, ts long")
    gone = spark.createDataFrame([(1, 4), (2, 6)], "id long, ts long")
    assert {r["id"] for r in history.history_minus_deleted(log, gone).collect()} == {1, 3}
    assert {r["id"] for r in history.history_minus_deleted(log, gone.drop("ts")).collect()} == {3}


def test_translation_has_a_status(spark):
    def fn(request):
        text = request.split("Translate:\n")[1]
        if "bad" in text:
            raise ValueError("no")
        return text.upper()

    docs = spark.createDataFrame([(1, "one.\n\ntwo."), (2, "bad."), (3, "fine.\n\nbad.\n\nlast.")], "doc_id long, markdown string")
    analysis = spark.createDataFrame([], "doc_id long, style string, glossary string, characters string")
    found = {r["doc_id"]: (r["status"], r["translated_text"]) for r in lifecycle.translate(docs, analysis, fn, limit=6).collect()}
    assert found[2] == found[3] == ("error", None)
    assert found[1][0] == "completed" and found[1][1].split() == ["ONE.", "TWO."]


def test_attempts_at_a_chunk(spark):
    long = "word " * 50

    def draft(request):
        text = request.split("Translate:\n")[1]
        if text in ("limit", "fault"):
            error = OSError("no")
            error.status = 429 if text == "limit" else 500
            raise error
        return "x" if text == long else text

    def correct(request, text):
        return {"gap": '{"missingContentDetected": true, "correctedTranslation": "filled"}', "torn": '{"newTerms": [', "list": "[1]"}.get(text, "")

    texts = [(1, 0, "limit"), (1, 1, "after"), (2, 0, "fault"), (3, 0, long), (3, 1, "gap"), (3, 2, "torn"), (3, 3, "list"), (4, 0, None)]
    asked = spark.createDataFrame([(*t, None, None, "無") for t in texts], "doc_id long, chunk_no int, source_text string, style string, glossary string, characters string")
    tried = model.translate_with_context(asked, draft, correct, wait=lambda seconds: None)
    rows = tried.collect()
    tries = {}
    for r in rows:
        tries.setdefault((r["doc_id"], r["chunk_no"]), []).append((r["attempt_no"], r["translated"], r["http_status"]))
    assert {k: len(v) for k, v in tries.items()} == {(1, 0): 6, (2, 0): 1, (3, 0): 3, (3, 1): 6, (3, 2): 1, (3, 3): 1, (4, 0): 1}
    assert tries[3, 0][-1] == (3, "x", None) and tries[3, 1][-1][1] == "filled" and (tries[3, 2], tries[3, 3]) == ([(1, "torn", None)], [(1, "list", None)])
    ended = {(r["doc_id"], r["chunk_no"]): (r["outcome"], r["attempt_no"]) for r in attempts.translation_outcome(tried).collect()}
    assert ended == {k: ("failed" if k[0] < 3 else "accepted", len(v)) for k, v in tries.items()}
    known = requests.build_request(asked.where("doc_id = 3 AND chunk_no = 0").selectExpr("*", "'' AS plot_summary", "'' AS prev_source", "'' AS prev_translation")).selectExpr("sha2(request, 256) AS h").first()["h"]
    assert {r["request_sha256"] for r in rows if (r["doc_id"], r["chunk_no"]) == (3, 0)} == {known}


def test_markdown_by_mode(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "x", "y"), ("b.md", "z", None)], "file_name string, extracted_text string, translated_text string")
    export.write_markdown(docs, str(tmp_path / "t"), "translate")
    export.write_markdown(docs, str(tmp_path / "e"), "extract")
    text = lambda folder: sorted(r["markdown"].strip() for r in files.scan_markdown(spark, str(tmp_path / folder)).collect())
    assert (text("t"), text("e")) == (["y"], ["x", "z"])
