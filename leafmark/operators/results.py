"""Results of evaluations: nested steps, outcomes, scopes, pairings, approvals; edits of decorations and styles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.geometry import Rect
from leafmark.operators import islands, records, spans
from leafmark.storage import stage


def steps(results: DataFrame, case: str, value: str) -> DataFrame:
    """(case, path, step): every step of nested results (JSON text), a step being an object with an outcome.

    path: keys and places (from 1) down to it, joined by slashes.  Steps aren't
    looked into.  A turn opens one level of all cases; text that isn't JSON has no steps.
    """
    spark = results.sparkSession
    level = results.select(F.col(case).alias("case"), F.lit("").alias("path"), F.try_parse_json(F.col(value)).alias("v"))
    found = []
    while True:
        kind, has = F.schema_of_variant("v"), F.try_variant_get("v", "$.outcome", "variant").isNotNull()
        level = stage(level.select("case", "path", F.to_json("v").alias("json"), (kind.startswith("OBJECT") & has).alias("is_step"), (kind.startswith("OBJECT") | kind.startswith("ARRAY")).alias("is_box")), "steps")
        found.append(level.where("is_step").select("case", "path", F.col("json").alias("step")))
        boxes = level.where("is_box and not is_step")
        if boxes.isEmpty():
            return reduce(DataFrame.unionAll, found)
        opened = spark.sql("SELECT b.case, b.path, e.key, e.pos, e.value AS v FROM {boxes} b, LATERAL variant_explode(parse_json(b.json)) e", boxes=boxes)
        part = F.coalesce(F.col("key"), (F.col("pos") + 1).cast("string"))
        level = opened.select("case", F.when(F.col("path") == "", part).otherwise(F.concat_ws("/", "path", part)).alias("path"), "v")


def grouped_cases(cases: DataFrame, case: str, fixtures: DataFrame, name: str) -> DataFrame:
    """cases with `group`: fixture if the case, or what is before its first dash, is one of the fixtures, else real."""
    known = fixtures.select(F.col(name).cast("string").alias("_f")).distinct()
    at = F.explode(F.array_distinct(F.array(F.col(case), F.substring_index(case, "-", 1))))
    hits = cases.select(case).distinct().select(F.col(case).alias("_c"), at.alias("_f")).join(known, "_f").select("_c").distinct().withColumn("_hit", F.lit(True))
    return cases.join(hits, F.col(case) == F.col("_c"), "left").withColumn("group", F.when(F.col("_hit"), F.lit("fixture")).otherwise(F.lit("real"))).drop("_c", "_hit")


def audit_outcome(outcome: Column) -> tuple[Column, Column]:
    """(safety, quality) of an audit by its outcome; null is not measured."""
    safety = F.when(outcome.isin("success", "quality-audit-failed"), True).when(outcome == "safety-audit-failed", False)
    return safety, F.when(outcome == "success", True).when(outcome == "quality-audit-failed", False)


def split_failures(failed: Column, safety: list[str]) -> tuple[Column, Column]:
    """(safety, quality) by the failing checks: those of the safety class and all others; null if nothing was measured."""
    serious = F.exists(failed, lambda x: x.isin(*safety))
    return ~serious, ~F.exists(failed, lambda x: ~x.isin(*safety))


def uniform(parts: list[tuple[str, DataFrame, dict[str, Column]]], columns: list[str]) -> DataFrame:
    """Records of several shapes as one table: (evaluation name, rows, what each column is); columns that a shape lacks are null."""
    shaped = [rows.select(F.lit(name).alias("evaluation"), *[what[c].alias(c) for c in columns if c in what]) for name, rows, what in parts]
    return records.merged(shaped).select("evaluation", *columns)


def compare_scoped(baseline: DataFrame, current: DataFrame, key: tuple[str, ...], signature: list[str], case: tuple[str, ...], scope: str, chosen: list | None = None) -> DataFrame:
    """records.compare() of the evaluations (column scope) that are chosen, or else that the current rows are of: others were not run."""
    if chosen is None:
        ran = current.select(scope).distinct()
        return records.compare(baseline.join(ran, scope, "left_semi"), current, key, signature, case)
    keep = F.col(scope).isin(*chosen)
    return records.compare(baseline.where(keep), current.where(keep), key, signature, case)


def paired(new: DataFrame, old: DataFrame, keys: list[str], outcome: str, reason: str) -> DataFrame:
    """(keys, before, before_reason, after, after_reason): each new row beside the old one, `absent` where there is none."""
    before = old.select(*keys, F.col(outcome).alias("before"), F.col(reason).alias("before_reason"))
    after = new.select(*keys, F.col(outcome).alias("after"), F.col(reason).alias("after_reason"))
    return after.join(before, keys, "left").select(*keys, F.coalesce("before", F.lit("absent")).alias("before"), "before_reason", "after", "after_reason")


def tracked(refused: DataFrame, current: DataFrame, place: list[str], key: str, cell: float) -> DataFrame:
    """(place, key, match, outcome, reason): where refused rows went (x0, y0, x1, y1; current rows with outcome and reason).

    Found again by the key, or else by the rows that are drawn over them on the
    same place, met in grid cells: proposed if any is, else refused as the
    first of them (by key) that was surveyed, else not surveyed.
    """
    own = refused.select(*place, key, "x0", "y0", "x1", "y1")
    same = own.join(current.select(*place, key, F.col("outcome").alias("_o"), F.col("reason").alias("_r")), [*place, key])
    by_key = same.select(*place, key, F.lit("key").alias("match"), F.when(F.col("_o") == "proposed", "proposed").otherwise("refused").alias("outcome"), F.when(F.col("_o") != "proposed", F.col("_r")).alias("reason"))
    rest = own.join(current.select(*place, key), [*place, key], "left_anti")
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))).alias("_cell")
    others = current.select(*place, F.col(key).alias("_key"), "outcome", "reason", *[F.col(c).alias("o" + c) for c in ("x0", "y0", "x1", "y1")], cells("y0", "y1"))
    met = rest.select("*", cells("y0", "y1")).join(others, [*place, "_cell"]).where(Rect.of().intersects(Rect.of("o"))).dropDuplicates([*place, key, "_key"])
    seen = F.col("outcome") != "skipped"
    found = met.groupBy(*place, key).agg(F.bool_or(F.col("outcome") == "proposed").alias("_any"), F.min(F.when(seen, F.struct("_key", "reason"))).alias("_first"))
    outcome = F.when(F.col("_any"), "proposed").when(F.col("_first").isNotNull(), "refused").otherwise("not surveyed")
    by_place = rest.select(*place, key).join(found, [*place, key], "left").select(*place, key, F.lit("place").alias("match"), outcome.alias("outcome"), F.when(outcome == "refused", F.col("_first.reason")).alias("reason"))
    return by_key.unionAll(by_place)


def approvals(approved: DataFrame, candidates: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason, n): ids approved that were no candidates, made without approval, or approved and not made (tables of keys and id)."""
    missing = lambda a, b, why: a.join(b, [*keys, "id"], "left_anti").groupBy(*keys).agg(F.count_distinct("id").alias("n")).select(*keys, F.lit(why).alias("reason"), "n")
    return missing(approved, candidates, "approved without candidate").unionAll(missing(made, approved, "made without approval")).unionAll(missing(approved, made, "approved and not made"))


def disjoint_partners(edits: DataFrame, case: str, ident: str, cell: float = 8.0) -> DataFrame:
    """(case, ident, n_pairs, partners): for each edit (start, end) of a case, how many of larger id don't overlap it, and the sum of these ids; edits without any have no row.

    All that come later, less those that overlap: only overlapping edits are paired, in grid cells.
    """
    of = edits.groupBy(case, ident).agg(F.count("*").alias("_n"))
    later = Window.partitionBy(case).orderBy(F.desc(ident)).rowsBetween(Window.unboundedPreceding, -1)
    after = of.select(case, ident, "_n", F.sum("_n").over(later).alias("_later"), F.sum(F.col("_n") * F.col(ident)).over(later).alias("_ids"))
    met = spans.overlap_pairs(edits, [case], ident, "start", "end", cell).groupBy(case, F.col("a").alias(ident)).agg(F.count("*").alias("_met"), F.sum("b").alias("_met_ids"))
    both = after.join(met, [case, ident], "left")
    n, ids = F.col("_n") * F.col("_later") - F.coalesce("_met", F.lit(0)), F.col("_n") * F.col("_ids") - F.coalesce("_met_ids", F.lit(0))
    return both.select(case, ident, n.alias("n_pairs"), ids.alias("partners")).where("n_pairs > 0")


def relocated(recorded: DataFrame, drawn: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, entry, moved): whether every glyph (keys, entry, ch, x, y) of an entry is drawn (keys, ch, x, y) exactly once within the tolerance.

    Glyphs drawn at one place are counted before they meet; a recorded glyph
    asks in the grid cells that its tolerance touches, mostly one.
    """
    cell = tolerance * 64
    at = lambda c: F.floor(c.cast("double") / cell).cast("long")
    near = lambda c: F.explode_outer(F.sequence(at(F.col(c) - tolerance * 1.001), at(F.col(c) + tolerance * 1.001)))
    own = recorded.select(*keys, "entry", "ch", "x", "y", F.monotonically_increasing_id().alias("_g"))
    there = drawn.groupBy(*keys, "ch", F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.count("*").alias("_m")).withColumns({"_cx": at(F.col("_x")), "_cy": at(F.col("_y"))})
    asked = own.withColumn("_cx", near("x")).withColumn("_cy", near("y"))
    hit = (F.abs(F.col("x") - F.col("_x")) <= tolerance) & (F.abs(F.col("y") - F.col("_y")) <= tolerance)
    counted = asked.join(there, [*keys, "ch", "_cx", "_cy"], "left").groupBy(*keys, "entry", "_g").agg(F.sum(F.when(hit, F.col("_m")).otherwise(0)).alias("_n"))
    return counted.groupBy(*keys, "entry").agg(F.bool_and(F.col("_n") == 1).alias("moved"))


def reinterpreted(current: DataFrame, actions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(decorations, refusals) after one action a key: add, remove, or a new recipe.

    current: keys, id, start, end, recipe.  actions: keys, verb, id, start, end,
    recipe.  A remove or recipe names the decoration as it is (id, start and
    end); a stale name, a recipe that changes nothing, or an unknown verb is
    refused, and the decorations of its key stay.
    """
    a = actions.select(*keys, "verb", F.col("id").alias("_id"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("recipe").alias("_r"))
    named = (F.col("id") == F.col("_id")) & (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e"))
    hits = a.join(current, keys, "left").groupBy(*keys, "verb", "_id", "_s", "_e", "_r").agg(F.bool_or(F.coalesce(named, F.lit(False))).alias("_hit"), F.bool_or(F.coalesce(named & (F.col("recipe") == F.col("_r")), F.lit(False))).alias("_same"))
    reason = (
        F.when(~F.col("verb").isin("add", "remove", "recipe"), "unknown action")
        .when((F.col("verb") != "add") & ~F.col("_hit"), "stale reference")
        .when((F.col("verb") == "recipe") & F.col("_same"), "recipe doesn't change")
    )
    judged = hits.withColumn("reason", reason)
    good = judged.where("reason is null").drop("_hit", "_same", "reason")
    both = current.join(good, keys, "left")
    mine = F.coalesce(named & (F.col("verb") != "add"), F.lit(False))
    kept = both.where(~(mine & (F.col("verb") == "remove"))).select(*keys, "id", "start", "end", F.when(mine, F.col("_r")).otherwise(F.col("recipe")).alias("recipe"))
    added = good.where("verb = 'add'").select(*keys, F.col("_id").alias("id"), F.col("_s").alias("start"), F.col("_e").alias("end"), F.col("_r").alias("recipe"))
    return kept.unionByName(added), judged.where("reason is not null").select(*keys, "reason")


def restyled(spans: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """(key, run, style, start, length, refusal): style spans (key, start, end, style) after one edit (key, start, end, n inserted) of each key.

    What is inserted has the style of what it replaces, or around it; where
    that are several, the edit is refused and the spans stay.  Neighbours of one
    style are one span; keys without an edit keep theirs.
    """
    e = edits.select(F.col(key), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("n").alias("_n"))
    rows = spans.join(e, key, "left").withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("start", "end")))
    lo, hi = F.when(F.col("_s") < F.col("_e"), F.col("_s")).otherwise(F.col("_s") - 1), F.when(F.col("_s") < F.col("_e"), F.col("_e")).otherwise(F.col("_s") + 1)
    touched = F.when((F.col("start") < hi) & (F.col("end") > lo), F.col("style"))
    every = Window.partitionBy(key)
    rows = rows.withColumn("_own", F.min(touched).over(every)).withColumn("refusal", F.coalesce(F.min(touched).over(every) != F.max(touched).over(every), F.lit(False)) & (F.col("_n") > 0))
    acts = F.col("_s").isNotNull() & ~F.col("refusal")
    shift = F.col("_n") - (F.col("_e") - F.col("_s"))
    before = F.when(acts, F.struct(F.col("start").alias("start"), F.least("end", "_s").alias("end"), F.col("style").alias("style")))
    after = F.when(acts, F.struct((F.greatest("start", "_e") + shift).alias("start"), (F.col("end") + shift).alias("end"), F.col("style").alias("style")))
    same = F.when(~acts, F.struct("start", "end", "style"))
    # what is inserted comes with the first span
    put = F.when(acts & (F.col("_n") > 0) & (F.col("_k") == 1), F.struct(F.col("_s").alias("start"), (F.col("_s") + F.col("_n")).alias("end"), F.col("_own").alias("style")))
    both = rows.select(key, "refusal", F.explode(F.array_compact(F.array(before, after, same, put))).alias("p")).select(key, "refusal", "p.*").where("start < end")
    runs = islands.islands(both.withColumn("_new", islands.changed("style", [key], ["start"])), [key], ["start"], F.col("_new"), "run")
    return runs.groupBy(key, "run").agg(F.first("style").alias("style"), F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"), F.bool_or("refusal").alias("refusal"))


def changed_run(before: Column, after: Column) -> tuple[Column, Column, Column]:
    """(start, end, inserted) of the smallest replacement that turns one text into another; an insertion takes in the character before it, or after it at the start."""
    a, b = F.split(before, ""), F.split(after, "")
    shorter = F.least(F.char_length(before), F.char_length(after))

    def common(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.lit(False))
        return F.when(at == 0, shorter).otherwise(F.least(at - 1, shorter))

    prefix = common(a, b)
    suffix = F.least(common(F.reverse(a), F.reverse(b)), shorter - prefix)
    start, end = prefix, F.char_length(before) - suffix
    grows = start == end
    first = F.when(grows & (start > 0), start - 1).otherwise(start)
    last = F.when(grows & (start == 0), end + 1).otherwise(end)
    new_end = F.char_length(after) - (F.char_length(before) - last)
    return first.cast("long"), last.cast("long"), F.substring(after, first + 1, new_end - first)


def ready_order(tasks: DataFrame, needs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, task, position): tasks by the rule `again and again the first task, in the given order, that needs nothing which isn't done`.

    needs: (keys, task, need).  Tasks on or behind a cycle have a null position.
    Flows are streamed: a task holds one flow's tasks and needs.
    """
    import heapq

    import pyarrow as pa

    from leafmark.operators.sequential import _runs

    listed = needs.groupBy(*keys, "task").agg(F.collect_set("need").alias("needs"))
    rows = tasks.select(*keys, "task", F.col(order).alias("_o")).join(listed, [*keys, "task"], "left").withColumn("needs", F.coalesce("needs", F.array().cast("array<long>")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def work(batches):
        for run in _runs(batches, keys):
            ids, wants = run["task"].to_pylist(), run["needs"].to_pylist()
            place, known = {t: i for i, t in enumerate(ids)}, set(ids)
            open_ = [len(w) for w in wants]
            waiting: dict[int, list[int]] = {}
            for i, w in enumerate(wants):
                for n in w:
                    if n in known:
                        waiting.setdefault(place[n], []).append(i)
            ready = [i for i, n in enumerate(open_) if not n]
            heapq.heapify(ready)
            position, at = [None] * len(ids), 0
            while ready:
                i = heapq.heappop(ready)
                position[i], at = at, at + 1
                for k in waiting.get(i, ()):
                    open_[k] -= 1
                    if not open_[k]:
                        heapq.heappush(ready, k)
            yield from run.select([*keys, "task"]).append_column("position", pa.array(position, pa.int64())).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, "_o", "task").mapInArrow(work, f"{kinds}, task long, position long")
