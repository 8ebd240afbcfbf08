"""Queries of the composed operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions import verdicts as V
from leafmark.operators import aggregates, composites, spans
from leafmark.sources.tables import table
from leafmark.storage import stage


def make_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders picked by order and by part, without those of some orders."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey k", "l_partkey p", "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber id")
    by_order, by_part = lines.where("k % 50 = 1").select("k").distinct(), lines.where("p % 97 = 3").select("p").distinct()
    return composites.select_rows(lines, [(by_order, "k"), (by_part, "p")], lines.where("k % 100 = 1").select("k"), "id", strict=False)


MAKE_SELECTION = "SELECT DISTINCT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id FROM lineitem WHERE (l_orderkey % 50 = 1 OR l_partkey % 97 = 3) AND l_orderkey % 100 <> 1"


def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that several suppliers claim: every line is a claim."""
    return composites.claim_conflicts(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


CLAIM_CONFLICTS = "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_plans, min(l_suppkey) AS first_plan FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1"


claim_conflicts_all, CLAIM_CONFLICTS_ALL = claim_conflicts, CLAIM_CONFLICTS


def clip_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By user: the clip that all clicks leave; events of value below 0.2 can't be proved."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'").selectExpr("user_id", "cast(value as double) a", "cast(100 + event_id % 400 as double) b", "value")
    return composites.clip_limits(e, ["user_id"], "a", "b", F.when(F.col("value") < 0.2, F.lit("unproved")))


CLIP_CONSTRAINT = """WITH c AS (SELECT user_id, max(value) AS x0, min(CAST(100 + event_id % 400 AS DOUBLE)) AS x1, bool_or(value < 0.2) AS bad FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, CASE WHEN NOT bad AND x0 < x1 THEN x0 END AS x0, CASE WHEN NOT bad AND x0 < x1 THEN x1 END AS x1, CASE WHEN bad THEN 'unproved' WHEN x0 >= x1 THEN 'empty' ELSE '' END AS reasons FROM c"""


def expected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after some were consumed and others moved by their priority."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey at", "o_orderstatus", "cast(substr(o_orderpriority, 1, 1) as long) dy")
    return composites.expected_rows(o.select("o_orderkey", "at"), o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'O'"), "o_orderkey", "at", "dy")


EXPECTED_ROWS = "SELECT o_orderkey, o_custkey + CASE WHEN o_orderstatus = 'O' THEN CAST(substr(o_orderpriority, 1, 1) AS BIGINT) ELSE 0 END AS at FROM orders WHERE o_orderstatus <> 'P'"


def glyph_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views of a user paired by their place: pairs, rows without a partner, largest difference."""
    e = table(spark, sf_dir, "events")
    return composites.compare_positions(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id"], ["ts", "event_id"], "value")


GLYPH_COMPARE = """WITH c AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events WHERE event_type = 'click'), v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events WHERE event_type = 'view')
SELECT coalesce(c.user_id, v.user_id) AS user_id, count(*) FILTER (c.pos IS NOT NULL AND v.pos IS NOT NULL) AS n_pairs, count(*) FILTER (c.pos IS NULL OR v.pos IS NULL) AS n_unpaired, max(abs(c.value - v.value)) AS max_error FROM c FULL OUTER JOIN v ON c.user_id = v.user_id AND c.pos = v.pos GROUP BY 1"""


def set_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median quantity of a part and flag with three lines or more, else of the part."""
    return composites.median_or_wider(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_returnflag"], ["l_partkey"], "l_quantity")


SET_WIDTH = """WITH a AS (SELECT l_partkey, l_returnflag, median(l_quantity) AS own, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_partkey, median(l_quantity) AS wide FROM lineitem GROUP BY 1)
SELECT a.l_partkey, l_returnflag, n, CASE WHEN n >= 3 THEN own ELSE wide END AS width FROM a JOIN b ON a.l_partkey = b.l_partkey"""


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of a user's and type's values, refused where one is too far off."""
    return aggregates.snapped_median(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", 150.0, 15.0)


TRACKING = """WITH m AS (SELECT user_id, event_type, median(value) AS m FROM events GROUP BY 1, 2), d AS (SELECT e.user_id, e.event_type, any_value(m) AS m, max(abs(value - m)) AS deviation FROM events e JOIN m ON e.user_id = m.user_id AND e.event_type = m.event_type GROUP BY 1, 2)
SELECT user_id, event_type, CASE WHEN deviation <= 150 THEN CASE WHEN abs(m) < 15 THEN 0.0 ELSE m END END AS tracking, deviation FROM d"""


def paragraph_of_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as lines, pairs of turns as paragraphs of longer text: which holds which, by running counts."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("n"))
    parts = t.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("part")).agg(F.sum(F.col("n") + F.col("turn") % 2 * 7).alias("n"))
    return composites.assign_by_count(t, parts, "conv_id", "turn", "n", "part")


PARAGRAPH_OF_LINE = """WITH t AS (SELECT conv_id, turn, length(text) AS n FROM conversations), p AS (SELECT conv_id, turn // 2 AS part, sum(n + turn % 2 * 7) AS n FROM t GROUP BY 1, 2),
l AS (SELECT conv_id, turn, sum(n) OVER w AS hi, sum(n) OVER w - n AS lo FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)), q AS (SELECT conv_id, part, sum(n) OVER w AS hi, sum(n) OVER w - n AS lo FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY part ROWS UNBOUNDED PRECEDING))
SELECT l.conv_id, l.turn, min(part) AS part FROM l LEFT JOIN q ON l.conv_id = q.conv_id AND q.lo <= l.lo AND l.hi <= q.hi AND l.lo < q.hi GROUP BY 1, 2"""


def placement_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as lines of a flow: regions that fall back and lines that overlap."""
    l = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_linenumber div 3 region", "l_quantity top", "10.0D height")  # noqa: E741
    return composites.placement_faults(l, "l_orderkey", ["l_linenumber", "l_partkey", "top"], "region", "top", "height")


PLACEMENT_CHECK = """WITH l AS (SELECT l_orderkey, l_linenumber // 3 AS region, l_quantity AS top, lag(l_linenumber // 3) OVER w AS br, lag(l_quantity + 10) OVER w AS bt FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity))
SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (region < br) AS n_back, count(*) FILTER (region = br AND top < bt) AS n_over FROM l GROUP BY 1"""


def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of odd against those of even events of a user and type, by path."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("u"), F.col("event_type").alias("t"), F.get_json_object("props", "$.k").alias("v"))
    side = lambda r: e.where(F.col("event_id") % 2 == r).groupBy("u", "t").agg(F.max("v").alias("v"))
    return composites.tree_changes(side(0), side(1), ["u", "t"], "v")


TREE_DIFF = """WITH e AS (SELECT event_id, user_id AS u, event_type AS t, json_extract_string(props, '$.k') AS v FROM events), a AS (SELECT u, t, max(v) AS v FROM e WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT u, t, max(v) AS v FROM e WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT * FROM (SELECT coalesce(a.u, b.u) AS u, coalesce(a.t, b.t) AS t, a.v AS before, b.v AS after, CASE WHEN a.u IS NULL THEN 'added' WHEN b.u IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END AS change FROM a FULL OUTER JOIN b ON a.u = b.u AND a.t = b.t) WHERE change IS NOT NULL"""


def sole_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders have one status and priority, and these."""
    return composites.sole_witness(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


SOLE_WITNESS = "SELECT o_custkey, min(o_orderstatus) AS o_orderstatus, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus || o_orderpriority) = 1"


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event types of a user in the order in which they first occur."""
    out = composites.ordered_distinct(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")
    return out.select("user_id", F.array_join("values", ">").alias("types"))


ORDERED_DISTINCT = "WITH f AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, '>' ORDER BY f) AS types FROM f GROUP BY 1"


def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of texts that don't exist among the odd ids."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 5 <> 0")
    return composites.broken_links(table(spark, sf_dir, "labels").selectExpr("doc_id label", "doc_id"), "label", "doc_id", docs, "doc_id")


BROKEN_LINKS = "SELECT doc_id AS label, doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)"


def conditional_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By kind of event: rows, those that pass each check, and those of which nothing is known."""
    e = table(spark, sf_dir, "events")
    checks = {"large": F.col("value") > 60, "tiny": F.col("value") < 1, "late": F.hour("ts") >= 18}
    return e.groupBy("event_type").agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{k}") for k, c in checks.items()], F.count_if(V.reasons(list(checks.items())) == F.array().cast("array<string>")).alias("n_none"))


CONDITIONAL_TOTALS = "SELECT event_type, count(*) AS n, count(*) FILTER (value > 60) AS n_large, count(*) FILTER (value < 1) AS n_tiny, count(*) FILTER (hour(ts) >= 18) AS n_late, count(*) FILTER (NOT (value > 60 OR value < 1 OR hour(ts) >= 18)) AS n_none FROM events GROUP BY 1"


def area_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of views and clicks of a user: the area that each pair covers, and how far the rest are apart."""
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_type", "cast(event_id % 300 as double) x0", "cast(event_id % 17 as double) y0")
    e = e.selectExpr("*", "x0 + event_id % 40 x1", "y0 + event_id % 11 y1")
    return spans.rectangle_cover(e.where("event_type = 'error'"), e.where("event_type = 'signup'"), ["user_id"], 32.0)


AREA_COVER = """WITH e AS (SELECT user_id, event_type, event_id % 300 AS x0, event_id % 17 AS y0, event_id % 300 + event_id % 40 AS x1, event_id % 17 + event_id % 11 AS y1 FROM events)
SELECT a.user_id, count(*) FILTER (a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1) AS n_meet, count(*) FILTER (a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1) AS n_inside,
CAST(sum(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)) AS DOUBLE) AS area, CAST(min(greatest(b.x0 - a.x1, a.x0 - b.x1, b.y0 - a.y1, a.y0 - b.y1)) AS DOUBLE) AS least_gap
FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'signup' GROUP BY 1"""


def top_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty largest order lines, ties by keys: a report with its limit."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(30).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


TOP_ERRORS = "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 30"


def page_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines nested, as the digest of canonical JSON."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p")))).alias("lines"))  # noqa: E741
    return l.select("l_orderkey", F.size("lines").cast("long").alias("n_lines"), F.sha2(F.to_json("lines"), 256).alias("digest"))


PAGE_CATALOG = """SELECT l_orderkey, count(*) AS n_lines, sha256('[' || string_agg('{"n":' || l_linenumber || ',"p":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']') AS digest FROM lineitem GROUP BY 1"""


def coverage_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in English and French against each other's characters: those that are missing; coverage_candidates_all has all languages."""
    d = table(spark, sf_dir, "documents")
    chars = lambda lang: d.where(F.col("lang") == lang).select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").distinct()
    return chars("fr").join(chars("en"), "ch", "left_anti").select("ch", F.lit("en").alias("missing_in")).unionAll(chars("en").join(chars("fr"), "ch", "left_anti").select("ch", F.lit("fr")))


COVERAGE_CANDIDATES = """WITH c AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS ch FROM documents WHERE lang IN ('en', 'fr'))
SELECT ch, 'en' AS missing_in FROM c WHERE lang = 'fr' AND ch <> '' AND ch NOT IN (SELECT ch FROM c WHERE lang = 'en') UNION ALL SELECT ch, 'fr' FROM c WHERE lang = 'en' AND ch <> '' AND ch NOT IN (SELECT ch FROM c WHERE lang = 'fr')"""


def coverage_candidates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the texts of each language (null is one) that no text of another language has, for every ordered pair of languages."""
    chars = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").distinct()
    chars = stage(chars, "chars")
    langs = chars.select(F.col("lang").alias("missing_in")).distinct().unionAll(table(spark, sf_dir, "documents").select("lang")).distinct()
    # every character is asked of every other language, as the result has them; languages are dealt out, not broadcast
    dealt = langs.withColumn("_part", F.pmod(F.xxhash64("missing_in"), F.lit(16)).cast("int"))
    every = chars.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(15))))
    asked = every.join(dealt, "_part").where(~F.col("lang").eqNullSafe(F.col("missing_in"))).drop("_part")
    have = chars.select(F.col("lang").alias("_lang"), F.col("ch").alias("_ch"))
    return asked.join(have, (F.col("ch") == F.col("_ch")) & F.col("missing_in").eqNullSafe(F.col("_lang")), "left_anti").select("ch", "lang", "missing_in")


COVERAGE_CANDIDATES_ALL = """WITH c AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS ch FROM documents), l AS (SELECT DISTINCT lang AS missing_in FROM documents)
SELECT ch, lang, missing_in FROM c JOIN l ON lang IS DISTINCT FROM missing_in WHERE ch <> '' AND NOT EXISTS (SELECT 1 FROM c o WHERE o.ch = c.ch AND o.lang IS NOT DISTINCT FROM l.missing_in)"""

_ALL = (
    make_selection, claim_conflicts, clip_constraint, expected_rows, glyph_compare, set_width, tracking, paragraph_of_line, placement_check, tree_diff, sole_witness, ordered_distinct, broken_links, conditional_totals, area_cover,
    top_errors, page_catalog, coverage_candidates, coverage_candidates_all,
)
QUERIES = {f.__name__: f for f in _ALL} | {"claim_conflicts_all": claim_conflicts}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
