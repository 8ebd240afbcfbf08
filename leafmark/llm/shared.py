"""The shared folder, as the rest of the library has it, and how much goes to Python at a time."""

from pyspark.sql import DataFrame

from leafmark.storage import Scratch, shared_dir, stage

__all__ = ["Scratch", "lean", "shared_dir", "stage"]

#: Bytes of an Arrow batch between Spark and Python, at most.
ARROW_BYTES = 8 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(df: DataFrame) -> DataFrame:
    """df, after bounding its session's Arrow batches: rows hold whole texts, and Spark's own bound allows for ten thousand of them, or 64 MB, twice a task."""
    spark = df.sparkSession
    now = str(spark.conf.get(_SETTING)).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= ARROW_BYTES:
        spark.conf.set(_SETTING, str(ARROW_BYTES))
    return df
