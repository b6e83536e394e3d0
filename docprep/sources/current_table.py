"""A table of the current row of each key, in buckets, of which a batch rewrites only those that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import session_files

#: Buckets that keys are dealt to; each that a batch touches is a file at least. Tables of many files want more, so that a batch
#: of few keys rewrites little.
BUCKETS = 16


class CurrentTable:
    """Batches of rows go in with `apply`; `read` gives what `merge` makes of all of them.

    `merge` turns rows of `schema` into one row for each of `keys`, and must give the same whether it is applied to all rows
    at once or to its own results and more rows: a latest record, a sum, a maximum.

    A batch writes the buckets that it touches anew, under its own number, and then one small manifest, which says the
    version of every bucket. Until that is there readers see the table before the batch. A batch that is run again after its
    manifest was written changes nothing, and one that failed before it is overwritten. Batches come one at a time, in
    rising order. The manifests and versions before the last two go, so a reader has one batch's time to read. The number of
    buckets can't be changed later. The driver holds one number for each bucket.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, keys: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.keys, self.merge, self.buckets = spark, folder.rstrip("/"), schema, keys, merge, buckets
        self._manifest([], -1)  # there may be no batch at all

    def _manifest(self, versions: list[tuple[int, int]], batch: int) -> None:
        rows = self.spark.createDataFrame([(b, v, self.buckets) for b, v in versions], "bucket int, version long, buckets int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={batch}")

    def _last(self) -> tuple[int, dict[int, int]]:
        """The last batch and the version of each bucket that has rows."""
        rows = self.spark.read.schema("bucket int, version long, buckets int, batch long").parquet(f"{self.folder}/manifest").collect()
        if any(r["buckets"] != self.buckets for r in rows):
            raise ValueError("the table has another number of buckets")
        last = max((r["batch"] for r in rows), default=-1)
        return last, {r["bucket"]: r["version"] for r in rows if r["batch"] == last}

    def _rows(self, spark: SparkSession, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in versions.items()]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def apply(self, changed: DataFrame, batch: int) -> None:
        last, versions = self._last()
        if batch <= last:
            return
        spark, bucket = changed.sparkSession, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        incoming = f"{self.folder}/incoming"
        self.merge(changed).write.mode("overwrite").parquet(incoming)  # what the stream computes is computed once
        new = spark.read.schema(self.schema).parquet(incoming)
        touched = [r[0] for r in new.select(bucket).distinct().collect()]
        if touched:
            old = self._rows(spark, {b: v for b, v in versions.items() if b in touched})
            rows = self.merge(old.unionByName(new)).withColumn("bucket", bucket).hint("rebalance", "bucket")
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/version={batch}")
            before, versions = versions, versions | dict.fromkeys(touched, batch)
            self._manifest(sorted(versions.items()), batch)
            self._clear(last, before)

    def _clear(self, last: int, kept: dict[int, int]) -> None:
        """Versions that neither this batch's manifest nor the one before it names."""
        files, path = session_files(self.spark, self.folder)
        for old in files.listStatus(path(f"{self.folder}/manifest")):
            name = old.getPath().getName()
            if name.startswith("batch=") and int(name[6:]) not in (-1, last) and int(name[6:]) < last:
                files.delete(old.getPath(), True)
        for version in files.listStatus(path(f"{self.folder}/data")):
            v = int(version.getPath().getName().split("=")[1])
            parts = [p.getPath() for p in files.listStatus(version.getPath()) if p.getPath().getName().startswith("bucket=")] if v <= last else []
            gone = [p for p in parts if kept.get(int(p.getName()[7:])) != v]
            for p in gone:
                files.delete(p, True)
            if parts and len(gone) == len(parts):
                files.delete(version.getPath(), True)

    def read(self) -> DataFrame:
        """The current rows, as of the last batch."""
        return self._rows(self.spark, self._last()[1])
