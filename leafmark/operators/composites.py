"""Row-set operators made of several primitives: selections, claims, clips, expected rows, placements, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.operators.matching import assert_empty


def select_rows(catalog: DataFrame, include: list[tuple[DataFrame, str]], exclude: DataFrame, ident: str, strict: bool = False) -> DataFrame:
    """Ids of the catalog named by any of (ids, column), without those named by exclude (same column as the first).

    In strict mode an id that the catalog doesn't have is an error.
    """
    found = None
    for ids, column in include:
        if strict:
            assert_empty(ids.join(catalog, column, "left_anti"), f"unknown {column}")
        part = catalog.join(ids.select(column).distinct(), column, "left_semi").select(ident)
        found = part if found is None else found.unionAll(part)
    gone = catalog.join(exclude.select(include[0][1]).distinct(), include[0][1], "left_semi").select(ident)
    return found.distinct().join(gone, ident, "left_anti")


def claim_conflicts(claims: DataFrame, item: str, plan: str) -> DataFrame:
    """Items that more than one plan claims."""
    return claims.groupBy(item).agg(F.count_distinct(plan).alias("n_plans"), F.min(plan).alias("first_plan")).where("n_plans > 1")


def clip_limits(clips: DataFrame, keys: list[str], x0: str, x1: str, reason: Column) -> DataFrame:
    """The intersection of all clips of a key: null with reasons if any can't be proved or nothing is left."""
    out = clips.groupBy(*keys).agg(F.max(x0).alias("x0"), F.min(x1).alias("x1"), F.sort_array(F.collect_set(reason)).alias("reasons"))
    empty = F.col("x0") >= F.col("x1")
    reasons = F.when(empty & (F.size("reasons") == 0), F.array(F.lit("empty"))).otherwise(F.col("reasons"))
    good = F.size(reasons) == 0
    return out.select(*keys, F.when(good, F.col("x0")).alias("x0"), F.when(good, F.col("x1")).alias("x1"), F.array_join(reasons, ",").alias("reasons"))


def expected_rows(base: DataFrame, consumed: DataFrame, moved: DataFrame, key: str, value: str, shift: str) -> DataFrame:
    """base without consumed rows, moved ones shifted."""
    kept = base.join(consumed.select(key).distinct(), key, "left_anti")
    return kept.join(moved.select(key, shift), key, "left").withColumn(value, F.col(value) + F.coalesce(F.col(shift), F.lit(0))).drop(shift)


def compare_positions(expected: DataFrame, actual: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows paired by their place in each key: how many pairs, rows on one side only, and the largest difference."""
    w = Window.partitionBy(*keys).orderBy(*order)
    place = lambda df, name: df.select(*keys, F.row_number().over(w).alias("_at"), F.col(value).alias(name))
    both = place(expected, "_e").join(place(actual, "_a"), [*keys, "_at"], "full_outer")
    return both.groupBy(*keys).agg(F.count_if(F.col("_e").isNotNull() & F.col("_a").isNotNull()).alias("n_pairs"), F.count_if(F.col("_e").isNull() | F.col("_a").isNull()).alias("n_unpaired"), F.max(F.abs(F.col("_e") - F.col("_a"))).alias("max_error"))


def median_or_wider(df: DataFrame, fine: list[str], coarse: list[str], value: str, least: int = 3) -> DataFrame:
    """The median of each fine key with enough rows, else that of its coarse key."""
    a = df.groupBy(*fine).agg(F.median(value).alias("_own"), F.count("*").alias("n"))
    b = df.groupBy(*coarse).agg(F.median(value).alias("_wide"))
    return a.join(b, coarse).select(*fine, "n", F.when(F.col("n") >= least, F.col("_own")).otherwise(F.col("_wide")).alias("width"))


def assign_by_count(lines: DataFrame, parts: DataFrame, key: str, line: str, n: str, part: str) -> DataFrame:
    """The part that holds each line, by running counts of characters; null where a line crosses a part's end."""
    def spans(df, at, prefix):
        w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(prefix + "hi", F.sum(n).over(w)).withColumn(prefix + "lo", F.col(prefix + "hi") - F.col(n))
    left = spans(lines, line, "l_").select(key, line, F.col("l_lo").alias("_at"), "l_hi", F.lit(1).alias("_kind"))
    # parts that hold characters don't overlap: the one that began last is the only one that can hold a line
    right = spans(parts, part, "p_").where("p_lo < p_hi").select(key, F.col("p_lo").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col("p_hi"), F.col(part).alias("part")).alias("_p"))
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right, allowMissingColumns=True).withColumn("_p", F.last("_p", ignorenulls=True).over(w)).where("_kind = 1")
    held = (F.col("_at") < F.col("_p.p_hi")) & (F.col("l_hi") <= F.col("_p.p_hi"))
    return found.groupBy(key, line).agg(F.min(F.when(held, F.col("_p.part"))).alias(part))


def placement_faults(lines: DataFrame, flow: str, order: list[str], region: str, top: str, height: str) -> DataFrame:
    """By flow: lines whose region falls back, and lines that begin above the end of the one before in their region."""
    w = Window.partitionBy(flow).orderBy(*order)
    before = F.lag(F.struct(region, F.col(top) + F.col(height))).over(w)
    marked = lines.withColumn("_b", before)
    back = F.col(region) < F.col(f"_b.{region}")
    over = (F.col(region) == F.col(f"_b.{region}")) & (F.col(top) < F.col("_b.col2"))
    return marked.groupBy(flow).agg(F.count("*").alias("n_lines"), F.count_if(back).alias("n_back"), F.count_if(over).alias("n_over"))


def tree_changes(before: DataFrame, after: DataFrame, path: list[str], value: str) -> DataFrame:
    """Paths whose values differ, null-safely, or that one side lacks."""
    a, b = before.select(*path, F.col(value).alias("before"), F.lit(True).alias("_a")), after.select(*path, F.col(value).alias("after"), F.lit(True).alias("_b"))
    both = a.join(b, path, "full_outer")
    change = F.when(F.col("_a").isNull(), F.lit("added")).when(F.col("_b").isNull(), F.lit("removed")).when(~F.col("before").eqNullSafe(F.col("after")), F.lit("changed"))
    return both.select(*path, "before", "after", change.alias("change")).where("change is not null")


def sole_witness(df: DataFrame, key: str, witness: list[str]) -> DataFrame:
    """Keys with one distinct witness, and it; ambiguous keys are dropped."""
    return df.select(key, *witness).distinct().groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in witness]).where("_n = 1").drop("_n")


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Values in the order in which they first occur."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias("_first"))
    return first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_first", value))).alias("_v")).select(*keys, F.transform("_v", lambda v: v[value]).alias("values"))


def broken_links(chain: DataFrame, child: str, parent: str, table: DataFrame, ident: str) -> DataFrame:
    """Rows whose parent doesn't exist."""
    return chain.where(F.col(parent).isNotNull()).join(table.select(F.col(ident).alias(parent)).distinct(), parent, "left_anti").select(child, parent)
