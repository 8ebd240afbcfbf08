"""Extension: keep a record baseline current from a stream of record files.

The reference work is batch only; this applies its upsert to micro-batches.
A run's rows may come in several of them, and a replayed one changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmark.storage import Scratch


def maintain_baseline(stream: DataFrame, folder: str, checkpoint: str, key: str = "evaluation", within: tuple[str, ...] = ("case", "step"), run: str = "run") -> StreamingQuery:
    """Bring the partitions (by evaluation) up to date that a micro-batch has rows of.

    A record is named by the evaluation and by those of `within` that the rows
    have: a new row takes the place of the old one of its name.  Where the rows
    have a column `run`, those of an evaluation's latest run alone stay, so
    that steps which a later run no longer has go.
    """

    def replace(batch: DataFrame, _: int) -> None:
        spark, names = batch.sparkSession, [key, *[c for c in within if c in batch.columns]]
        with Scratch(spark) as scratch:
            new = scratch.stage(batch.dropDuplicates(names), "batch")
            old = spark.read.schema(batch.schema).parquet(folder).select(*batch.columns).join(F.broadcast(new.select(key).distinct()), key, "left_semi")
            rows = old.join(new, names, "left_anti").select(*batch.columns).unionByName(new)
            if run in batch.columns:
                rows = rows.withColumn("_last", F.max(run).over(Window.partitionBy(key))).where(F.col(run).eqNullSafe(F.col("_last"))).drop("_last")
            rows = scratch.stage(rows, "merged")  # the folder that is written isn't read any more
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)

    return stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
