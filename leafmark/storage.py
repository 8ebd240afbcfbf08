"""The shared folder: where lineage is cut and intermediate tables live."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a staged table in a file, where their number is known; files at least.
ROWS_A_FILE, LEAST_FILES = 100_000, 8

#: Rows of a table that a task has at most, where a plan puts many sorts of what comes of them into one stage; and rows that such a stage sorts itself.
ROWS_A_TASK, SORTED_A_TASK = 20_000, 400_000

#: The innermost block that takes in all that stage() writes.
_PASSING: ContextVar[Scratch | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors and the driver share.

    Where it is unset (tests, a laptop) and the master is local, a temporary
    folder is set; on a cluster an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="leafmark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _write(df: DataFrame, name: str, rows: int | None, most: int | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // ROWS_A_FILE)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", most or 0).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str, rows: int | None = None, most: int | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there.

    Where about so many rows at most are known, files aren't smaller than that needs.
    most: rows of a file, at most.
    """
    out, path = _write(df, name, rows, most)
    if (block := _PASSING.get()) is not None:
        block.paths[id(out)] = (out, path)
    return out


def dealt(df: DataFrame, *keys: str, sorted_rows: Column | None = None) -> DataFrame:
    """A staged table dealt out by keys to as many partitions as its rows need, or the rows that are made of each (sorted_rows).

    What is derived from it by these keys stays there: a shuffle of small rows
    would be merged by its size on disk, and one task would sort all of them.
    """
    n = -(-df.count() // ROWS_A_TASK) if sorted_rows is None else -(-int(df.agg(F.sum(sorted_rows)).first()[0] or 0) // SORTED_A_TASK)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, n), *keys)


class Scratch:
    """Staged tables that nobody reads any more when the block ends; their folders go then.

    What is to outlive the block is written by stage() within it, or, where
    the block takes in all that stage() writes meanwhile (every=True), by keep().
    """

    def __init__(self, spark: SparkSession, every: bool = False):
        self.spark, self.paths, self.every, self.before = spark, {}, every, None

    def __enter__(self) -> Scratch:
        if self.every:
            self.before = _PASSING.set(self)
        return self

    def stage(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        out, path = _write(df, name, rows)
        self.paths[id(out)] = (out, path)
        return out

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return _write(df, name, None)[0]

    def drop(self, *tables: DataFrame) -> None:
        """Remove the folders of staged tables that no later step reads."""
        for table in tables:
            _, path = self.paths.pop(id(table))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def __exit__(self, *_) -> None:
        if self.every:
            _PASSING.reset(self.before)
        self.drop(*[table for table, _ in list(self.paths.values())])
