"""What the corpus operators share: table reading, durable cuts of lineage, word rules."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch of texts that a Python worker gets at once.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Long texts go to Python in batches of BATCH_ROWS rows from now on, in place of Spark's 10,000, which bounds what the
    workers of a session of many stages hold. A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. A local session without one gets a temporary
    folder; on a cluster, where executors could not read it, that is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="docprep-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, which survives lost executors."""
    context, base = df.sparkSession.sparkContext, shared_base(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder, for what is too large for a checkpoint, which is not compressed.

    The files of a plan's shuffles go as soon as its table is written; tables go when dropped, or when the session ends.
    """

    _CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    _WRITERS = "spark.sql.maxConcurrentOutputFileWriters"

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_base(spark)}/docprep-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        self._files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.deleteOnExit(folder)

    def write(self, name: str, df: DataFrame, by: str | None = None, parts: int = 0) -> DataFrame:
        """Add the rows to a table, in folders by a column if `by` is given, and return the table. If `by` has up to `parts`
        values, a task writes to all their files at once and does not sort its rows first."""
        wanted = {self._CLEANUP: "true", self._WRITERS: str(parts)}
        before = {key: self.spark.conf.get(key, None) for key in wanted}
        try:
            for key, value in wanted.items():
                self.spark.conf.set(key, value)
            df.write.mode("append").partitionBy(*[by] if by else []).parquet(f"{self.base}/{name}")
        finally:
            for key, value in before.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}"), True)


def named(column: str) -> Column:
    """The column of exactly that name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def split_join(rows: DataFrame, aggregate: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows with an aggregate of one row a key, so that Spark can split a hot key.

    Where an aggregate's own shuffle serves the join, adaptive execution can't deal a large partition to more tasks. One
    more key, derived from the others, makes it shuffle the aggregate, the smaller side, once more.
    """
    side = F.pmod(F.xxhash64(*keys), F.lit(2))
    return rows.withColumn("__side", side).join(aggregate.withColumn("__side", side), [*keys, "__side"], how).drop("__side")


def n_words(text: Column) -> Column:
    """Words of a text, zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without_lines(text: Column, gone: Column) -> Column:
    """A text without the lines whose numbers, counted from 0 over lines with a word, are in `gone`."""
    lines = F.split(text, "\n", -1)
    worded = F.filter(F.transform(lines, lambda x, p: F.when(x.rlike(HAS_WORD), p)), lambda p: p.isNotNull())
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(gone, lambda g: F.get(worded, g)))
    return F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n")


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`__id`, `__th`, `__text`: rows that share a doc_id stay apart unless their text is equal too."""
    text = F.coalesce(named(text_col), F.lit(""))
    return docs.select(named(id_col).alias("__id"), F.xxhash64(text).alias("__th"), text.alias("__text"))
