"""Whole plans: ended runs that go on, retry rounds, analysis."""

import json
import os
import uuid
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docprep.operators import chunking, cost, model, requests
from docprep.plans import lifecycle
from docprep.sources.attempt_log import AttemptLog

ANALYSIS = "doc_id long, style string, glossary string, characters string"


def docs_and_analysis(spark, n=8):
    docs = spark.createDataFrame([(i, "\n\n".join(f"part {i}.{j} {'x' * 30}" for j in range(6))) for i in range(n)], "doc_id long, markdown string")
    return docs, spark.createDataFrame([(i, "calm", "- a: b" if i % 2 else None, "") for i in range(n)], ANALYSIS)


def model_function(calls, ends=(), fails=()):
    """Tells of each call in a file; the worker ends with some chunks, others fail."""

    def draft(request):
        text = request.split("\n\nTranslate:\n", 1)[1]
        with open(f"{calls}/{uuid.uuid4().hex}", "w") as out:
            out.write(text)
        if any(x in text for x in ends):
            raise SystemExit("the worker ends")
        if any(x in text for x in fails):
            raise ValueError("no")
        return f"T{request.count(chr(10))} {text}"

    return draft


#: A lambda, which tasks get whole, as they cannot import this file.
correct = lambda request, draft: json.dumps({"newTerms": [f"t{len(draft)}", None], "newCharacters": [None], "chunkSummary": f"s{len(draft)}"})


def called(folder):
    return Counter(open(f"{folder}/{name}").read() for name in os.listdir(folder))


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_a_run_that_broke_off_goes_on(spark, tmp_path):
    docs, analysis = docs_and_analysis(spark)
    whole = rows(lifecycle.translate(docs, analysis, model_function(tmp_path), correct, limit=60))
    assert {r[1] for r in whole} == {"completed"} and all("None" not in r[3] for r in whole)
    calls, log = tmp_path / "calls", f"file:{tmp_path}/log"
    calls.mkdir()
    ends = ("part 3.2", "part 6.5")
    with pytest.raises(PySparkException):
        lifecycle.translate(docs, analysis, model_function(calls, ends), correct, limit=60, log=log)
    accepted = {r["translated"].split(" ", 1)[1] for r in AttemptLog(log, model.TRANSLATION).table(spark).collect()}
    assert accepted
    assert rows(lifecycle.translate(docs, analysis, model_function(calls), correct, limit=60, log=log)) == whole
    n = called(calls)
    assert all(n[text] == 1 for text in accepted)
    assert len(n) == 48 and all(c == 1 or any(x in text for x in ends) for text, c in n.items())
    assert not os.listdir(tmp_path / "log/chunks")  # all are finished
    assert rows(lifecycle.translate(docs, analysis, model_function(calls), correct, limit=60, log=log)) == whole
    assert called(calls) == n


def test_failed_chunks_are_asked_again_on_demand(spark, tmp_path):
    docs, analysis = docs_and_analysis(spark, 3)
    whole = rows(lifecycle.translate(docs, analysis, model_function(tmp_path), correct, limit=60))
    calls, log = tmp_path / "calls", f"{tmp_path}/log"
    calls.mkdir()
    out = rows(lifecycle.translate(docs, analysis, model_function(calls, fails=("part 1.3",)), correct, limit=60, log=log))
    assert [r[1] for r in out] == ["completed", "error", "completed"] and out[1][2] is None
    n = called(calls)
    assert rows(lifecycle.translate(docs, analysis, model_function(calls), correct, limit=60, log=log)) == out and called(calls) == n
    assert rows(lifecycle.translate(docs, analysis, model_function(calls), correct, limit=60, log=log, again=True)) == whole
    assert sum(called(calls).values()) == sum(n.values()) + 3  # the failed chunk and the two after it


def test_loop_equals_windows_with_null_terms(spark):
    """Null terms are left out in the loop as in the batch form."""
    docs, analysis = docs_and_analysis(spark, 1)
    asked = chunking.chunk_documents(docs, 60).join(analysis, "doc_id")
    found = model.translate_with_context(asked, lambda r: r, correct).collect()
    assert all(r["new_terms"] == [r["new_terms"][0]] and r["new_characters"] == [] for r in found)


def test_extraction_rounds(spark, tmp_path):
    items = [(1, p, ["page", str(p), "of some length"]) for p in range(1, 13)] + [(2, 1, ["some text of this page"]), (2, 6, ["x"]), (3, 1, ["y"]), (3, 6, ["text enough for a page"])]
    pages = spark.createDataFrame(items, "doc_id long, page_no int, items array<string>")

    def fn(request):
        with open(f"{tmp_path}/{uuid.uuid4().hex}", "w") as out:
            out.write(request)
        seen = sum(open(f"{tmp_path}/{name}").read() == request for name in os.listdir(tmp_path))
        if request.startswith("ocr") or ("page 6" in request and seen < 3):
            raise ValueError("no")
        return request.upper()

    found = {r["doc_id"]: r for r in lifecycle.extract(pages, fn).collect()}
    assert (found[1]["status"], found[2]["status"], found[3]["status"]) == ("completed", "completed", "error")
    assert found[2]["markdown"] == "REPAIR\nSOME TEXT OF THIS PAGE" and found[3]["markdown"] is None
    n = called(tmp_path)
    assert sorted(n.values()) == [1, 1, 1, 1, 3, 3, 3]  # the batch of page 6, and the two without text
    assert found[1]["markdown"].count("REPAIR") == 3


def test_analysis_of_new_documents_only(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b" * 60_000), (3, None), (4, "d")], "doc_id long, markdown string")
    saved = spark.createDataFrame([(4, "s", "g", "c"), (9, "s", "g", "c")], ANALYSIS)

    def fn(request):
        if request.endswith("d") or (request.endswith("a") and "style guide" in request):
            raise ValueError("no")
        return f"{len(request)}【術語表】：\n- x: y\n"

    found = {r["doc_id"]: r for r in lifecycle.analyse(docs, fn, saved).collect()}
    assert set(found) == {1, 2, 4} and tuple(found[4]) == (4, "s", "g", "c")
    assert tuple(found[1]) == (1, "general", "- x: y", "無")
    assert found[2]["style"].startswith(str(len(requests.STYLE_REQUEST) + 30_000))


def test_log_rows_once(spark, tmp_path):
    log = AttemptLog(str(tmp_path), model.TRANSLATION)
    assert log.table(spark).count() == 0 and log.chunks(5) == {}
    rows = [{"doc_id": 5, "chunk_no": 1, "attempt_no": n, "translated": "a\nü", "new_terms": ["x"], "ts": "2024-01-02T03:04:05.000006+00:00"} for n in (1, 2)]
    log.commit(5, 1, rows)
    log.commit(6, 1, [{**rows[0], "doc_id": 6}])
    assert log.chunks(5) == {1: rows} and log.table(spark).count() == 3
    before = log.chunks(5)
    log.compact(spark.createDataFrame([(5,), (7,)], "doc_id long"))
    assert log.chunks(5) == {} and log.table(spark).count() == 3
    log.commit(5, 1, before[1])  # as if the run had ended before the files went
    assert log.table(spark).groupBy("doc_id").count().orderBy("doc_id").collect() == [(5, 2), (6, 1)]
    assert log.table(spark).where(F.col("ts") == F.expr("TIMESTAMP '2024-01-02 03:04:05.000006'")).count() == 3


def test_estimate_of_rows_that_share_an_id(spark):
    """Each row is an estimate of its own, as in the SQL, where numbers of two sources meet."""
    counts = spark.createDataFrame([(1, 3), (1, 1001), (2, 1000)], "doc_id long, pages int")
    found = lifecycle.estimate(counts, 600, cost.price_list(spark)).where("model_id = 'pro'").select("doc_id", "tokens")
    assert rows(found) == [(1, 3 * 12_000), (1, 1001 * 12_000), (2, 1000 * 12_000)]


def test_log_has_a_file_for_each_task(spark, tmp_path):
    """Documents that are not finished leave no file each, and a line without its end is not read."""
    docs, analysis = docs_and_analysis(spark, 30)
    calls, log = tmp_path / "calls", f"{tmp_path}/log"
    calls.mkdir()
    lifecycle.translate(docs, analysis, model_function(calls, fails=(".4 ",)), correct, limit=60, log=log)
    held, files = AttemptLog(log, model.TRANSLATION), [f"{where}/{name}" for where, _, names in os.walk(f"{log}/chunks") for name in names if name.endswith(".json")]
    assert 0 < len(files) <= 4 and held.table(spark).count() == 150
    with open(files[0], "rb+") as last:
        last.truncate(last.seek(-3, 2))
    assert held.table(spark).count() == 149
    part = files[0].split("/")[-2]
    assert len(dict(held.earlier(part))) == sum(1 for _ in open(files[0])) - 1


def test_extracted_texts_are_shuffled_once(spark):
    """Texts go to their documents without meeting the outcomes batch by batch; a document of failed batches stays."""
    items = [(1, 1, ["page", "of some length"]), (1, 6, ["y"]), (2, 1, ["this page always fails"])]
    pages = spark.createDataFrame(items, "doc_id long, page_no int, items array<string>")
    found = lifecycle.extract(pages, lambda request: 1 / ("fails" not in request and "ocr" not in request) and request.upper())
    assert rows(found) == [(1, "completed", "REPAIR\nPAGE OF SOME LENGTH"), (2, "error", None)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3
