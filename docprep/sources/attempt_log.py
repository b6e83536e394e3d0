"""A log of model calls that survives lost executors and ended runs.

The rows of a chunk are one line of JSON, committed as soon as the chunk has ended. A task appends the lines of all its
documents to one file, `chunks/<part>/<name>.json`, so that files are as many as tasks and not as chunks; a line without its
end is not read, so that a chunk is whole or absent. On stores whose objects can't grow each line is a file. Whoever comes to
the same chunk later, a retried task or a new run, takes the rows from there and calls nothing. `table` gives all rows as a
DataFrame, and `compact` moves those of given documents into Parquet.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    return pyarrow.fs.FileSystem.from_uri("file:///" + folder[5:].lstrip("/") if folder.startswith("file:") else folder)


def place(doc_id: int | None, chunk_no: int) -> tuple:
    """A chunk's place in the order of documents, those without an id first."""
    return doc_id is not None, doc_id or 0, chunk_no


class Segment:
    """The file to which a task appends; it is made with the first line."""

    def __init__(self, files: pyarrow.fs.FileSystem, folder: str):
        self.files, self.folder, self.out = files, folder, None

    def add(self, doc_id, chunk_no: int, rows: list[dict]) -> None:
        line = json.dumps({"doc_id": doc_id, "chunk_no": chunk_no, "rows": rows}, ensure_ascii=False, default=lambda t: t.isoformat())
        if self.out is None:
            self.files.create_dir(self.folder, recursive=True)
            self.out = self.files.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}.json")
        self.out.write((line + "\n").encode("utf-8", "surrogatepass"))
        self.out.flush()
        if self.files.type_name not in ("local", "hdfs"):
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
        self.out = None


class AttemptLog:
    def __init__(self, folder: str, schema: str):
        self.folder, self.schema = folder.rstrip("/"), schema

    def _files(self, path: str) -> tuple[pyarrow.fs.FileSystem, str]:
        return opened(f"{self.folder}/{path}")

    def segment(self, part: str) -> Segment:
        return Segment(*self._files(f"chunks/{part}"))

    def earlier(self, part: str) -> Iterator[tuple[tuple, list[dict]]]:
        """The place and the rows of each chunk that earlier tries of a part have committed, in order: a try goes through its
        chunks in order, so its lines are merged and never held."""
        files, path = self._files(f"chunks/{part}")

        def lines(file):
            rest = b""
            with files.open_input_stream(file.path) as stream:
                while block := stream.read(1 << 20):
                    *whole, rest = (rest + block).split(b"\n")
                    for line in whole:
                        found = json.loads(line.decode("utf-8", "surrogatepass"))
                        yield place(found["doc_id"], found["chunk_no"]), found["rows"]

        found = files.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
        return heapq.merge(*map(lines, found), key=lambda x: x[0])

    def chunks(self, doc_id) -> dict[int, list[dict]]:
        """Chunk number -> rows of a document that was committed by itself."""
        return {key[2]: rows for key, rows in self.earlier(str(doc_id))}

    def commit(self, doc_id, chunk_no: int, rows: list[dict]) -> None:
        """Commit a chunk by itself, to a part of its document's name."""
        segment = self.segment(str(doc_id))
        segment.add(doc_id, chunk_no, rows)
        segment.close()

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        files, path = self._files(name)
        files.create_dir(path, recursive=True)
        row = spark.createDataFrame([], self.schema).schema.simpleString()
        reader = spark.read.schema(f"doc_id long, chunk_no int, rows array<{row}>")
        if name == "done":
            return reader.parquet(f"{self.folder}/done")
        return reader.option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED").json(f"{self.folder}/chunks")

    def records(self, spark: SparkSession) -> DataFrame:
        """`doc_id`, `chunk_no` and `rows` of each chunk once, the latest if it was committed again."""
        every = self._read(spark, "chunks").unionByName(self._read(spark, "done"))
        return every.groupBy("doc_id", "chunk_no").agg(F.max_by("rows", F.element_at("rows", -1)["ts"]).alias("rows"))

    def table(self, spark: SparkSession) -> DataFrame:
        """All rows, each (document, chunk, attempt) once."""
        return self.records(spark).select(F.explode("rows").alias("r")).select("r.*")

    def compact(self, documents: DataFrame) -> None:
        """Put the rows of these documents (`doc_id`) into Parquet and remove the parts that hold rows of no other document.
        Rows in both places count once. No run may use the log meanwhile."""
        spark, documents = documents.sparkSession, documents.select("doc_id").distinct()
        rows = self._read(spark, "chunks").join(documents, "doc_id", "left_semi")
        rows.join(self._read(spark, "done").select("doc_id", "chunk_no"), ["doc_id", "chunk_no"], "left_anti").write.mode("append").parquet(f"{self.folder}/done")
        part = F.element_at(F.split("_metadata.file_path", "/"), -2)
        seen = self._read(spark, "chunks").select("doc_id", part.alias("part")).distinct().join(documents.withColumn("ended", F.lit(True)), "doc_id", "left")
        spent = seen.groupBy("part").agg(F.count("*").alias("n"), F.count("ended").alias("ended")).where("n = ended").select("part")

        def forget(parts):
            for frame in parts:
                for name in frame["part"]:
                    files, path = self._files(f"chunks/{name}")
                    files.delete_dir(path)
                yield frame

        spent.mapInPandas(forget, "part string").agg(F.count("*")).collect()
