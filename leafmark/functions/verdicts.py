"""Three-valued verdicts: null means not measured, and is never counted as a pass or a failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REQUIRED, MUST_NOT_FAIL, SHOWN = "required", "must_not_fail", "shown"


def verdict(ok: str = "ok", role: str = "role") -> Column:
    """Aggregate: false if any criterion that isn't merely shown failed, null if a required one wasn't measured, else true."""
    failed = F.count_if((F.col(role) != SHOWN) & (F.col(ok) == F.lit(False)))
    missing = F.count_if((F.col(role) == REQUIRED) & F.col(ok).isNull())
    return F.when(failed > 0, F.lit(False)).when(missing > 0, F.lit(None).cast("boolean")).otherwise(F.lit(True))


def all_true(ok: str) -> Column:
    """Aggregate AND that keeps null: false over null over true."""
    return F.when(F.count_if(F.col(ok) == F.lit(False)) > 0, F.lit(False)).when(F.count_if(F.col(ok).isNull()) > 0, F.lit(None).cast("boolean")).otherwise(F.lit(True))


def reasons(checks: list[tuple[str, Column]]) -> Column:
    """All reasons whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in checks]))


def label(ok: Column) -> Column:
    return F.when(ok, F.lit("yes")).when(~ok, F.lit("no")).otherwise(F.lit("unverified"))
