"""Queries over results of evaluations, approvals, and edits of decorations and styles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.operators import results
from leafmark.plans.rules import _split
from leafmark.sources.tables import table
from leafmark.storage import dealt, stage

#: An order's results as nested JSON: steps at several depths, values that are none.
_NESTED = """'{"first":{"outcome":"' || o_orderstatus || '","n":1},"n":' || o_custkey || ',"list":[{"outcome":"x"},{"deep":{"a":{"outcome":"' || o_orderpriority || '"},"b":[{"outcome":null},7]}},"s"],"none":{}' || CASE WHEN o_orderkey % 5 = 0 THEN ',"outcome":"whole"' ELSE '' END || '}'"""


def nested_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the orders' nested results, by its path."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", f"CASE WHEN o_orderkey % 11 = 3 THEN 'no json {{' ELSE {_NESTED} END AS j")
    return results.steps(rows, "k", "j").select("case", "path", F.get_json_object("step", "$.outcome").alias("outcome")).withColumnRenamed("case", "order_key")


NESTED_STEPS = f"""WITH r AS (SELECT o_orderkey AS k, CAST({_NESTED} AS JSON) AS j FROM orders WHERE o_orderkey % 11 <> 3),
t AS (SELECT k, x.fullkey AS f, x.value AS v, x.type AS ty FROM r, json_tree(j) x),
s AS (SELECT k, f, v FROM t WHERE ty = 'OBJECT' AND list_contains(json_keys(v), 'outcome')),
o AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM s u WHERE u.k = s.k AND u.f <> s.f AND (starts_with(s.f, u.f || '.') OR starts_with(s.f, u.f || '['))))
SELECT k AS order_key, CASE WHEN f = '$' THEN '' ELSE array_to_string(list_transform(regexp_extract_all(replace(f, '$', ''), '[^.\\[\\]"]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN CAST(CAST(p AS INT) + 1 AS VARCHAR) ELSE p END), '/') END AS path,
json_extract_string(v, '$.outcome') AS outcome FROM o"""


def case_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases named after orders: fixtures by their name or by what is before the dash."""
    cases = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '-' || o_orderkey ELSE '' END AS case")
    fixtures = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    return results.grouped_cases(cases, "case", fixtures, "c_custkey").select("o_orderkey", "case", F.col("group").alias("grp")).withColumnRenamed("case", "case_name")


CASE_GROUPS = """WITH c AS (SELECT o_orderkey, o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '-' || o_orderkey ELSE '' END AS case_name FROM orders)
SELECT o_orderkey, case_name, CASE WHEN split_part(case_name, '-', 1) IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0) THEN 'fixture' ELSE 'real' END AS grp FROM c"""

_SAFETY = ["click", "error"]


def audit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' audits: what their outcomes and failing checks say of safety and of quality, as uniform records of two shapes."""
    e = table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_id") % 5 == 0, "success").when(F.col("event_id") % 5 == 1, "quality-audit-failed").when(F.col("event_id") % 5 == 2, "safety-audit-failed").when(F.col("event_id") % 5 == 3, "refused")
    safety, quality = results.audit_outcome(outcome)
    failed = e.where("value > 100").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("failed"))
    of_failed = results.split_failures(F.col("failed"), _SAFETY)
    return results.uniform(
        [("outcomes", e, {"case": F.col("event_id"), "outcome": outcome, "safety": safety, "quality": quality}), ("failures", failed, {"case": F.col("user_id"), "failed": F.array_join("failed", ","), "safety": of_failed[0], "quality": of_failed[1]})],
        ["case", "outcome", "failed", "safety", "quality"],
    ).withColumnRenamed("case", "case_id")


AUDIT_OUTCOMES = """WITH o AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'quality-audit-failed' WHEN 2 THEN 'safety-audit-failed' WHEN 3 THEN 'refused' END AS outcome FROM events),
f AS (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS failed, NOT bool_or(event_type IN ('click', 'error')) AS s, NOT bool_or(event_type NOT IN ('click', 'error')) AS q FROM events WHERE value > 100 GROUP BY user_id)
SELECT 'outcomes' AS evaluation, event_id AS case_id, outcome, NULL AS failed, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS safety, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS quality FROM o
UNION ALL SELECT 'failures', user_id, NULL, failed, s, q FROM f"""


def scoped_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a baseline, priorities as evaluations: those without a current order were not run and aren't compared."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderpriority AS evaluation", "o_custkey AS case", "o_orderkey AS step", "o_orderstatus AS outcome")
    base = o.where("step % 7 <> 1").withColumn("outcome", F.when(F.col("step") % 10 == 4, "X").otherwise(F.col("outcome")))
    now = o.where("step % 9 <> 2 and case % 13 <> 5 and evaluation < '4'")
    return results.compare_scoped(base, now, ("evaluation", "case", "step"), ["outcome"], ("evaluation", "case"), "evaluation").groupBy("evaluation", "status").agg(F.count("*").alias("n"))


SCOPED_DIFF = """WITH o AS (SELECT o_orderpriority AS e, o_custkey AS c, o_orderkey AS s, o_orderstatus AS x FROM orders), b AS (SELECT e, c, s, CASE WHEN s % 10 = 4 THEN 'X' ELSE x END AS x FROM o WHERE s % 7 <> 1 AND e < '4'),
n AS (SELECT * FROM o WHERE s % 9 <> 2 AND c % 13 <> 5 AND e < '4'), r AS (SELECT DISTINCT e, c FROM n)
SELECT evaluation, status, count(*) AS n FROM (SELECT coalesce(b.e, n.e) AS evaluation, CASE WHEN b.s IS NULL THEN 'only_current' WHEN n.s IS NULL THEN CASE WHEN r.c IS NULL THEN 'case_not_run' ELSE 'only_baseline' END WHEN b.x IS DISTINCT FROM n.x THEN 'changed' ELSE 'same' END AS status
FROM b FULL JOIN n ON b.e = n.e AND b.c = n.c AND b.s = n.s LEFT JOIN r ON r.e = coalesce(b.e, n.e) AND r.c = coalesce(b.c, n.c)) GROUP BY evaluation, status"""


def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each surveyed line beside what it was before, absent where it wasn't."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_returnflag").alias("outcome"), F.min("l_linestatus").alias("reason"))
    return results.paired(rows.where("l_partkey % 3 > 0"), rows.where("l_orderkey % 4 > 0"), ["l_orderkey", "l_partkey"], "outcome", "reason")


PAIRED_OUTCOMES = """WITH r AS (SELECT l_orderkey, l_partkey, max(l_returnflag) AS o, min(l_linestatus) AS w FROM lineitem GROUP BY 1, 2)
SELECT a.l_orderkey, a.l_partkey, coalesce(b.o, 'absent') AS before, b.w AS before_reason, a.o AS after, a.w AS after_reason FROM r a LEFT JOIN (SELECT * FROM r WHERE l_orderkey % 4 > 0) b USING (l_orderkey, l_partkey) WHERE a.l_partkey % 3 > 0"""

_SURVEY = "event_id AS k, user_id AS doc, hour(ts) * 40 AS x0, event_id % 50 * 20 AS y0, hour(ts) * 40 + 60 AS x1, event_id % 50 * 20 + 30 AS y1, CASE WHEN event_type = 'click' THEN 'proposed' WHEN event_type = 'view' THEN 'skipped' ELSE 'refused' END AS outcome, event_type AS reason"


def tracked_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where refused events went: found by number, or else by what is drawn over them."""
    e = table(spark, sf_dir, "events").selectExpr(*[c.strip() for c in _split(_SURVEY)])
    now = e.where("k % 3 > 0").withColumn("outcome", F.when(F.col("k") % 5 == 0, "proposed").otherwise(F.col("outcome")))
    return results.tracked(e.where("outcome = 'refused'"), now, ["doc"], "k", 100.0)


TRACKED_REFUSALS = f"""WITH e AS (SELECT {_SURVEY} FROM events), r AS (SELECT * FROM e WHERE outcome = 'refused'), n AS (SELECT * REPLACE (CASE WHEN k % 5 = 0 THEN 'proposed' ELSE outcome END AS outcome) FROM e WHERE k % 3 > 0),
o AS (SELECT r.doc, r.k, bool_or(n.outcome = 'proposed') AS anyp, arg_min(n.reason, n.k) FILTER (n.outcome <> 'skipped') AS why, count(*) FILTER (n.outcome <> 'skipped') AS seen FROM r JOIN n ON r.doc = n.doc AND r.x0 < n.x1 AND n.x0 < r.x1 AND r.y0 < n.y1 AND n.y0 < r.y1 GROUP BY r.doc, r.k)
SELECT r.doc, r.k, CASE WHEN n.k IS NOT NULL THEN 'key' ELSE 'place' END AS match, CASE WHEN n.k IS NOT NULL THEN CASE WHEN n.outcome = 'proposed' THEN 'proposed' ELSE 'refused' END WHEN o.anyp THEN 'proposed' WHEN o.seen > 0 THEN 'refused' ELSE 'not surveyed' END AS outcome,
CASE WHEN n.k IS NOT NULL THEN CASE WHEN n.outcome <> 'proposed' THEN n.reason END WHEN NOT coalesce(o.anyp, false) AND o.seen > 0 THEN o.why END AS reason FROM r LEFT JOIN n ON r.doc = n.doc AND r.k = n.k LEFT JOIN o ON r.doc = o.doc AND r.k = o.k"""


def approval_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as proposals: parts approved, offered and made, and what doesn't agree."""
    l = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_returnflag", "l_partkey AS id")  # noqa: E741
    return results.approvals(l.where("id % 3 > 0"), l.where("id % 7 > 0"), l.where("id % 2 > 0"), ["l_orderkey", "l_returnflag"])


APPROVAL_CHECK = """WITH l AS (SELECT DISTINCT l_orderkey, l_returnflag, l_partkey AS id FROM lineitem)
SELECT l_orderkey, l_returnflag, reason, count(*) AS n FROM (SELECT *, unnest(list_filter(['approved without candidate', 'made without approval', 'approved and not made'], lambda w: CASE w WHEN 'approved without candidate' THEN id % 3 > 0 AND id % 7 = 0 WHEN 'made without approval' THEN id % 2 > 0 AND id % 3 = 0 ELSE id % 3 > 0 AND id % 2 = 0 END)) AS reason FROM l) GROUP BY ALL"""


def edit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two edits of a conversation that don't overlap: how many each edit has."""
    e = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "turn % 5 * 10 AS start", "turn % 5 * 10 + turn % 4 * 6 AS end")
    return results.disjoint_partners(e, "conv_id", "turn")


EDIT_PAIRS = """WITH e AS (SELECT conv_id, turn, turn % 5 * 10 AS s, turn % 5 * 10 + turn % 4 * 6 AS z FROM conversations)
SELECT a.conv_id, a.turn, count(*) AS n_pairs, CAST(sum(b.turn) AS BIGINT) AS partners FROM e a JOIN e b ON a.conv_id = b.conv_id AND a.turn < b.turn AND NOT (a.s < b.z AND b.s < a.z) GROUP BY 1, 2"""


def change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approved changes of each order as one list: its text, what moved with it, panels that grew."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    text = o.select("o_orderkey", F.lit("text").alias("kind"), F.lit("paragraph").alias("what"), F.lit(0).cast("long").alias("id"), F.lit(None).cast("double").alias("dy"))
    moved = l.where("abs(l_quantity - 25) > 0.01 and l_returnflag = 'R'").select("l_orderkey", F.lit("translate"), F.lit("object"), "l_partkey", F.col("l_quantity") - 25)
    panels = l.where("l_returnflag = 'A'").select("l_orderkey", F.lit("panel"), F.lit("panel"), "l_partkey", F.col("l_discount"))
    every = text.unionAll(moved).unionAll(panels)
    return every.groupBy("o_orderkey", "kind", "what").agg(F.count("*").alias("n"), F.round(F.sum("dy"), 4).alias("dy"), F.max("id").alias("last_id"))


CHANGE_SET = """WITH c AS (SELECT o_orderkey, 'text' AS kind, 'paragraph' AS what, 0 AS id, CAST(NULL AS DOUBLE) AS dy FROM orders UNION ALL SELECT l_orderkey, 'translate', 'object', l_partkey, l_quantity - 25 FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <> 25
UNION ALL SELECT l_orderkey, 'panel', 'panel', l_partkey, l_discount FROM lineitem WHERE l_returnflag = 'A') SELECT o_orderkey, kind, what, count(*) AS n, round(sum(dy), 4) AS dy, CAST(max(id) AS BIGINT) AS last_id FROM c GROUP BY ALL"""

_DRAWN = "l_orderkey AS page, l_returnflag AS ch, l_quantity AS x, l_linenumber * 1.0 AS y"


def relocated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded rows that every page still draws exactly as recorded, each glyph once."""
    drawn = table(spark, sf_dir, "lineitem").selectExpr(*_DRAWN.split(", "))
    kept = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_suppkey % 3 AS entry", "l_returnflag AS ch", "l_quantity + CASE WHEN l_partkey % 10 = 1 THEN 0.3 WHEN l_partkey % 10 = 2 THEN 0.008 ELSE 0 END AS x", "l_linenumber * 1.0 AS y")
    return results.relocated(kept, drawn, ["page"], 0.01)


RELOCATED_ROWS = f"""WITH d AS (SELECT {_DRAWN} FROM lineitem), k AS (SELECT row_number() OVER () AS g, l_orderkey AS page, l_suppkey % 3 AS entry, l_returnflag AS ch, l_quantity + CASE WHEN l_partkey % 10 = 1 THEN 0.3 WHEN l_partkey % 10 = 2 THEN 0.008 ELSE 0 END AS x, l_linenumber AS y FROM lineitem),
c AS (SELECT k.page, k.entry, k.g, count(d.page) AS n FROM k LEFT JOIN d ON d.page = k.page AND d.ch = k.ch AND abs(d.x - k.x) <= 0.01 AND abs(d.y - k.y) <= 0.01 GROUP BY 1, 2, 3)
SELECT page, entry, bool_and(n = 1) AS moved FROM c GROUP BY 1, 2"""

_ACTION = "o_orderkey AS l_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' WHEN 2 THEN 'recipe' WHEN 3 THEN 'remove' ELSE 'paint' END AS verb"


def decoration_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One action on each order's decorations: what they are afterwards, and why an action was refused."""
    start = F.min("l_linenumber").cast("long") * 10
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_partkey").alias("id")).agg(start.alias("start"), (start + 5).alias("end"), F.min("l_returnflag").alias("recipe"))
    first = d.groupBy("l_orderkey").agg(F.min(F.struct("id", "start", "end")).alias("f")).select("l_orderkey", "f.*")
    acts = table(spark, sf_dir, "orders").selectExpr(*[c.strip() for c in _split(_ACTION)]).join(first, "l_orderkey")
    stale = F.when(F.col("l_orderkey") % 5 == 3, F.col("end") + 1).otherwise(F.col("end"))
    acts = acts.select("l_orderkey", "verb", F.when(F.col("verb") == "add", -1).otherwise(F.col("id")).alias("id"), "start", stale.alias("end"), F.lit("N").alias("recipe"))
    after, refused = results.reinterpreted(d, acts, ["l_orderkey"])
    sums = after.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("recipe") == "N").alias("n_new"), F.sum("id").alias("ids"))
    return refused.join(sums, "l_orderkey", "full_outer")


DECORATION_ACTIONS = f"""WITH d AS (SELECT l_orderkey, l_partkey AS id, min(l_returnflag) AS recipe FROM lineitem GROUP BY 1, 2), f AS (SELECT l_orderkey, min(id) AS id, arg_min(recipe, id) AS old FROM d GROUP BY 1),
a AS (SELECT x.l_orderkey, x.verb, f.id, CASE WHEN verb = 'paint' THEN 'unknown action' WHEN x.l_orderkey % 5 = 3 THEN 'stale reference' WHEN verb = 'recipe' AND old = 'N' THEN 'recipe doesn''t change' END AS reason FROM (SELECT {_ACTION} FROM orders) x JOIN f ON x.l_orderkey = f.l_orderkey),
r AS (SELECT d.l_orderkey, d.id, CASE WHEN a.reason IS NULL AND a.verb = 'recipe' AND a.id = d.id THEN 'N' ELSE d.recipe END AS recipe FROM d LEFT JOIN a ON a.l_orderkey = d.l_orderkey WHERE NOT coalesce(a.reason IS NULL AND a.verb = 'remove' AND a.id = d.id, false)
UNION ALL SELECT l_orderkey, -1, 'N' FROM a WHERE verb = 'add' AND reason IS NULL), g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (recipe = 'N') AS n_new, CAST(sum(id) AS BIGINT) AS ids FROM r GROUP BY l_orderkey)
SELECT coalesce(g.l_orderkey, a.l_orderkey) AS l_orderkey, n, n_new, ids, reason FROM g FULL JOIN (SELECT * FROM a WHERE reason IS NOT NULL) a ON g.l_orderkey = a.l_orderkey"""


def styled_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles of each text, a span for every ten characters, after an edit; refused where it would cross styles."""
    d = stage(table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast("long").alias("n")).where("n > 0"), "lengths")
    d = dealt(d, "doc_id", sorted_rows=F.col("n") / 10)
    spans = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 10))).alias("i")).select("doc_id", (F.col("i") * 10).alias("start"), F.least(F.col("i") * 10 + 10, F.col("n")).alias("end"), F.concat(F.lit("s"), F.floor(F.col("i") / 2) % 3).alias("style"))
    s = F.floor(F.col("n") * (F.col("doc_id") % 7) / 8)
    edits = d.where("doc_id % 5 > 0").select("doc_id", s.alias("start"), F.least("n", s + F.col("doc_id") % 4 * 3).alias("end"), (F.col("doc_id") % 3 * 4).alias("n"))
    return results.restyled(spans, edits, "doc_id").select("doc_id", "run", "style", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "refusal")


# characters one by one: each with its style, then runs of equal ones
STYLED_EDITS = """WITH d AS (SELECT doc_id, length(text) AS n, CAST(floor(length(text) * (doc_id % 7) / 8) AS BIGINT) AS s, doc_id % 3 * 4 AS k FROM documents WHERE length(text) > 0), e AS (SELECT *, least(n, s + doc_id % 4 * 3) AS z FROM d),
c AS (SELECT doc_id, s, z, k, doc_id % 5 > 0 AS edits, unnest(range(n)) AS p FROM e), y AS (SELECT *, 's' || (p // 20 % 3) AS st FROM c),
t AS (SELECT doc_id, min(st) AS a, max(st) AS b FROM y WHERE CASE WHEN s < z THEN p >= s AND p < z ELSE p IN (s - 1, s) END GROUP BY doc_id),
q AS (SELECT y.*, t.a, edits AND k > 0 AND coalesce(t.a <> t.b, false) AS refusal FROM y LEFT JOIN t ON y.doc_id = t.doc_id),
o AS (SELECT doc_id, refusal, CASE WHEN edits AND NOT refusal AND p >= z THEN p + k - (z - s) ELSE p END AS p, st FROM q WHERE refusal OR NOT edits OR p < s OR p >= z
UNION ALL SELECT doc_id, false, s + unnest(range(k)), a FROM (SELECT DISTINCT doc_id, s, k, a FROM q WHERE edits AND NOT refusal AND k > 0)),
g AS (SELECT *, CAST(st IS DISTINCT FROM lag(st) OVER w AND row_number() OVER w > 1 AS INT) AS ch FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY p)), h AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT doc_id, CAST(run AS BIGINT) AS run, any_value(st) AS style, CAST(min(p) AS BIGINT) AS start, count(*) AS length, bool_or(refusal) AS refusal FROM h GROUP BY doc_id, run"""


def normalized_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against a changed text: the smallest run that changed, and whether one owner (of seven characters each) has it."""
    t = table(spark, sf_dir, "conversations").where("text <> ''")
    t = t.select("conv_id", "turn", F.col("text").alias("a"), F.char_length("text").alias("n"))
    at = F.floor(F.col("n") * (F.col("turn") % 5) / 5).cast("int")
    b = F.concat(F.substring("a", F.lit(1), at), F.when(F.col("turn") % 3 > 0, F.substring(F.col("a"), at + 1, F.lit(2))).otherwise(F.lit("")), F.when(F.col("conv_id") % 2 == 0, F.lit("Q")).otherwise(F.lit("")), F.substring("a", at + 3, F.col("n")))
    rows = t.withColumn("b", b).where("a <> b")
    start, end, inserted = results.changed_run(F.col("a"), F.col("b"))
    out = rows.select("conv_id", "turn", start.alias("start"), end.alias("end"), inserted.alias("inserted"))
    owner = F.when(F.floor(F.col("start") / 7) == F.floor((F.col("end") - 1) / 7), F.floor(F.col("start") / 7))
    return out.select("conv_id", "turn", F.col("start").alias("first_at"), F.col("end").alias("last_at"), "inserted", owner.alias("owner"))


NORMALIZED_EDITS = """WITH t AS (SELECT conv_id, turn, text AS a, length(text) AS n, CAST(floor(length(text) * (turn % 5) / 5) AS INT) AS at_ FROM conversations WHERE text <> ''),
b AS (SELECT *, substr(a, 1, at_) || CASE WHEN turn % 3 > 0 THEN substr(a, at_ + 1, 2) ELSE '' END || CASE WHEN conv_id % 2 = 0 THEN 'Q' ELSE '' END || substr(a, at_ + 3, n) AS b FROM t), c AS (SELECT *, length(b) AS m FROM b WHERE a <> b),
p AS (SELECT *, list_max(list_filter(range(0, least(n, m) + 1), lambda i: left(a, i) = left(b, i))) AS pre FROM c), s AS (SELECT *, list_max(list_filter(range(0, least(n, m) - pre + 1), lambda i: right(a, i) = right(b, i))) AS suf FROM p),
e AS (SELECT *, CASE WHEN pre = n - suf AND pre > 0 THEN pre - 1 ELSE pre END AS f, CASE WHEN pre = n - suf AND pre = 0 THEN 1 ELSE n - suf END AS l FROM s)
SELECT conv_id, turn, CAST(f AS BIGINT) AS first_at, CAST(l AS BIGINT) AS last_at, substr(b, f + 1, m - (n - l) - f) AS inserted, CASE WHEN f // 7 = (l - 1) // 7 THEN CAST(f // 7 AS BIGINT) END AS owner FROM e"""


def ready_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as tasks that need others: the order in which they can be done."""
    t = table(spark, sf_dir, "events").selectExpr("user_id", "event_id AS task", "value")
    n = t.selectExpr("user_id", "task", "CAST(value * 7 AS BIGINT) % 1000 AS need").join(t.selectExpr("user_id", "task AS need"), ["user_id", "need"]).where("need <> task")
    return results.ready_order(t, n.select("user_id", "task", "need"), ["user_id"], "task")


_F = (
    nested_steps, case_groups, audit_outcomes, scoped_diff, paired_outcomes, tracked_refusals, approval_check, edit_pairs, change_set, relocated_rows, decoration_actions, styled_edits, normalized_edits, ready_order,
)
QUERIES = {f.__name__: f for f in _F}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _F if f.__name__.upper() in globals()}
