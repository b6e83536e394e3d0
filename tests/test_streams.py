"""Streams over several batches with replays: equal to the batch forms, with state that the watermark bounds."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from docprep.operators import history, pages
from docprep.sources.current_table import CurrentTable
from docprep.streaming import streams

START = datetime.datetime(2024, 1, 1)


def arrive(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).parquet(f"{folder}/in")


def run(stream, folder, keys, merge):
    """As run_to_end, with the rows of state after the last batch."""
    table = CurrentTable(stream.sparkSession, f"{folder}/table", stream.schema, keys, merge, 8)
    query = stream.writeStream.outputMode("update").foreachBatch(table.apply).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    told = [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
    return table.read(), [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in told]


def test_drafts(spark, tmp_path):
    """Fragments in any order, with nulls, replays within and beyond the watermark, and a chunk that is never whole."""
    rng, schema = random.Random(1), "doc_id long, chunk_no int, seq int, text string, last boolean, event_time timestamp"
    chunks = {(d, c): [rng.choice([None, "", "a", "bc", "日本", "x\ny"]) for _ in range(rng.randrange(1, 9))] for d in range(12) for c in range(3)}
    sent = [[], [], []]
    for (d, c), parts in chunks.items():
        for seq, text in enumerate(parts):
            last = seq == len(parts) - 1 and (d, c) != (5, 1)
            sent[rng.randrange(c, 3) if c else 0].append((d, c, seq, text, last, START + datetime.timedelta(minutes=c, seconds=seq)))
    batches = [sent[0], sent[1] + sent[0], sent[2] + sent[1][:20], [(99, 0, 0, "z", True, START + datetime.timedelta(days=1))], [*sent[0], *sent[2]], [(99, 1, 0, "y", True, START + datetime.timedelta(days=3))]]
    counts = []
    for batch in batches:
        rng.shuffle(batch)
        stream = streams.stream_drafts(arrive(spark, batch, schema, tmp_path), "10 minutes")
        found, told = run(stream, str(tmp_path / "run"), ["doc_id", "chunk_no"], streams.longest_draft)
        counts += told
    once = spark.createDataFrame([r for s in sent for r in s] + batches[3] + batches[5], schema)
    want = {(r["doc_id"], r["chunk_no"]): r["draft_text"] for r in pages.concat_fragments(once).collect()}
    rows = {(r["doc_id"], r["chunk_no"]): r for r in found.collect()}
    assert {k: r["draft_text"] for k, r in rows.items()} == want
    assert {k for k, r in rows.items() if not r["final"]} == {(5, 1)}
    assert max(counts) >= len(chunks) and counts[-1] <= 2


def test_drafts_merge(spark):
    """Drafts put together at once, or step by step in any order, are the same; what follows a whole chunk's last one is left out."""
    rng, chunks = random.Random(3), {0: ["a", None, "c"], 1: ["x", "y"], 2: ["z"], 3: ["o", "p", "q"]}
    sent = [(5, c, seq, text, c != 3 and seq == len(parts) - 1, START) for c, parts in chunks.items() for seq, text in enumerate(parts)]
    sent.append((5, 1, 7, "beyond", False, START))
    schema = "doc_id long, chunk_no int, seq int, text string, last boolean, event_time timestamp"
    want = {0: ("ac", True), 1: ("xy", True), 2: ("z", True), 3: ("opq", False)}
    rows = lambda part: streams.fragment_drafts(spark.createDataFrame(part, schema))
    for _ in range(2):
        rng.shuffle(sent)
        found = streams.longest_draft(rows(sent))
        steps = streams.longest_draft(streams.longest_draft(rows(sent[:4])).unionByName(rows(sent[4:])))
        for df in (found, steps):
            got = df.collect()
            assert {r["chunk_no"]: (r["draft_text"], r["final"]) for r in got} == want
            assert all(bool(r["parts"]) != r["final"] for r in got)


def test_drafts_have_no_python_state(spark, tmp_path):
    """The state is kept by Spark's own deduplication, a row a fragment, not by a Python call for each chunk."""
    schema = "doc_id long, chunk_no int, seq int, text string, last boolean, event_time timestamp"
    stream = streams.stream_drafts(arrive(spark, [(1, 0, 0, "a", True, START)], schema, tmp_path))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "PandasWithState" not in plan and "DeduplicateWithinWatermark" in plan


def test_progress(spark, tmp_path):
    schema = "doc_id long, batch_no int, text string, total long, event_time timestamp"
    rows = [(d, b, None if (d + b) % 4 == 0 else f"t{b}", 5 + d % 2, START + datetime.timedelta(minutes=b)) for d in range(20) for b in range(5)]
    again = [(d, b, "late", t, e) for d, b, x, t, e in rows if x is None and d % 3 == 0]  # a batch that failed and came later
    early, late = [r for r in rows if r[1] < 3], [r for r in rows if r[1] >= 3]
    far = [(77, 0, "x", 1, START + datetime.timedelta(days=1))]
    counts = []
    for batch in (early, late + early[:25] + again, late + again + early, far, late + rows, [(78, 0, None, 1, START + datetime.timedelta(days=2))]):
        stream = streams.stream_progress(arrive(spark, batch, schema, tmp_path), "10 minutes")
        found, told = run(stream, str(tmp_path / "run"), ["doc_id"], streams.added_progress)
        counts += told
    done = {}
    for d, b, x, t, _ in [*rows, *again, *far, (78, 0, None, 1, None)]:
        seen, _ = done.setdefault(d, (set(), t))
        if x is not None:
            seen.add(b)
    found = {r["doc_id"]: (r["done"], r["total"], r["percent"]) for r in streams.with_percent(found).collect()}
    assert found == {d: (len(s), t, int(100 * len(s) / t + 0.5)) for d, (s, t) in done.items()}
    assert max(counts) >= len(rows) and counts[-1] <= 2


def test_history(spark, tmp_path):
    """The latest record by time wins in whatever batch it came; a batch rewrites only the buckets of its ids."""
    rng, schema = random.Random(2), "id long, title string, current_chunk int, ts timestamp"
    batches = [[(i, f"{b}", rng.randrange(9), START + datetime.timedelta(hours=rng.randrange(50))) for i in range(60) if rng.random() < 0.6] for b in range(3)] + [[(7, "x", 1, START + datetime.timedelta(days=9))]]
    for batch in batches:
        stream = streams.stream_history(arrive(spark, batch, schema, tmp_path))
        found = streams.run_to_end(stream, str(tmp_path / "run"), ["id"], history.history_current, 8)
    want = history.history_current(spark.createDataFrame([r for b in batches for r in b], schema))
    key = lambda df: sorted((r["id"], r["current_chunk"], r["ts"]) for r in df.collect())
    assert key(found) == key(want)
    assert len(list((tmp_path / "run/table/data/version=3").glob("bucket=*"))) == 1
    assert len(list((tmp_path / "run/table/manifest").glob("batch=*"))) <= 3


def total(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def test_current_table(spark, tmp_path):
    """A batch counts once: not again when replayed, not at all when it failed before its manifest."""
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n long")
    table = CurrentTable(spark, str(tmp_path / "t"), rows().schema, ["k"], total, 4)
    values = lambda t: {r["k"]: r["n"] for r in t.read().collect()}
    assert values(table) == {}
    table.apply(rows(("a", 1), ("a", 2), ("b", 1), (None, 5)), 0)
    table.apply(rows(("a", 1), ("a", 2), ("b", 1), (None, 5)), 0)
    table.apply(rows(), 1)
    assert values(table) == {"a": 3, "b": 1, None: 5}
    written = table._manifest
    table._manifest = lambda *x: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        table.apply(rows(("a", 10), (None, 1)), 2)
    assert values(table) == {"a": 3, "b": 1, None: 5}
    table._manifest = written
    table.apply(rows(("a", 10), ("c", 1)), 2)
    again = CurrentTable(spark, str(tmp_path / "t"), rows().schema, ["k"], total, 4)
    again.apply(rows(("a", 10), ("c", 1)), 2)
    for batch in range(3, 7):
        again.apply(rows(("b", 1)), batch)
    assert values(again) == {"a": 13, "b": 5, "c": 1, None: 5}
    with pytest.raises(ValueError, match="buckets"):
        CurrentTable(spark, str(tmp_path / "t"), rows().schema, ["k"], total, 5).read()
