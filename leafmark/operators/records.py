"""Evaluation records: what changed against a baseline, summaries, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.functions.verdicts import label

KEY = ("evaluation", "case", "step")


def compare(baseline: DataFrame, current: DataFrame, key: tuple[str, ...], signature: list[str], case: tuple[str, ...]) -> DataFrame:
    """Every key of both tables with its status.

    same, changed (any signature column differs, null-safely), only_current,
    only_baseline, or case_not_run: a key is missing because its case has no
    current row at all.  A column changes lists what differs.
    """
    old = baseline.select(*key, F.struct(*signature).alias("_old"))
    new = current.select(*key, F.struct(*signature).alias("_new"))
    ran = current.select(*case).distinct().withColumn("_ran", F.lit(True))
    both = old.join(new, list(key), "full_outer").join(ran, list(case), "left")
    differs = [F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in signature]
    changes = F.array_compact(F.array(*differs))
    status = (
        F.when(F.col("_old").isNull(), F.lit("only_current"))
        .when(F.col("_new").isNull() & F.col("_ran").isNull(), F.lit("case_not_run"))
        .when(F.col("_new").isNull(), F.lit("only_baseline"))
        .when(F.size(changes) > 0, F.lit("changed"))
        .otherwise(F.lit("same"))
    )
    return both.select(*key, status.alias("status"), F.when(status == "changed", changes).otherwise(F.array().cast("array<string>")).alias("changes"))


def summary(records: DataFrame, keys: list[str], outcome: str, tiers: list[str]) -> DataFrame:
    """Counts by key and measure: steps, each outcome, and each tier as yes, no or unverified."""
    measures = F.array(
        F.lit("steps"), F.concat(F.lit("outcome:"), F.coalesce(outcome, F.lit("unknown"))), *[F.concat(F.lit(t + ":"), label(F.col(t))) for t in tiers]
    )
    return records.select(*keys, F.explode(measures).alias("measure")).groupBy(*keys, "measure").agg(F.count("*").alias("n"))


def upsert(baseline: DataFrame, current: DataFrame, key: str = "evaluation") -> DataFrame:
    """The baseline with the rows of every evaluation that ran replaced, and all others kept."""
    kept = baseline.join(current.select(key).distinct(), key, "left_anti")
    return kept.unionByName(current, allowMissingColumns=True)


def merged(tables: list[DataFrame]) -> DataFrame:
    """Records of several shapes as one table; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
