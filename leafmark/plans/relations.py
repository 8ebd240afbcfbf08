"""Relations between rows: overlaps, matches, nearest rows, intervals, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.operators import graph, islands, matching, spans
from leafmark.sources.tables import table

#: Events as intervals: from the second of the day on, as long as the value says.
_SPAN = "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT)"
_EVENTS = f"e AS (SELECT event_id, user_id, event_type, value, {_SPAN} AS lo, {_SPAN} + CAST(ceil(value) AS BIGINT) AS hi FROM events)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", lo.alias("lo"), (lo + F.ceil("value").cast("long")).alias("hi"))


def rect_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's events whose intervals overlap, by kind of pair."""
    e = _spans(spark, sf_dir)
    return spans.overlap_pairs(e, ["user_id"], "event_id", "lo", "hi", 256).groupBy("user_id").agg(F.count("*").alias("n_pairs"), F.min("a").alias("first_a"), F.max("b").alias("last_b"))


RECT_OVERLAP_PAIRS = f"WITH {_EVENTS} SELECT a.user_id, count(*) AS n_pairs, min(a.event_id) AS first_a, max(b.event_id) AS last_b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.lo < b.hi AND b.lo < a.hi GROUP BY a.user_id"


def no_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that no error of the same user overlaps."""
    e = _spans(spark, sf_dir)
    return spans.free_of(e.where("event_type = 'click'").select("event_id", "user_id", "lo", "hi"), e.where("event_type = 'error'"), ["user_id"], "lo", "hi")


NO_COLLISION = f"WITH {_EVENTS} SELECT event_id, user_id, lo, hi FROM e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM e x WHERE x.event_type = 'error' AND x.user_id = e.user_id AND e.lo < x.hi AND x.lo < e.hi)"


def clearance_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By user: the least gap between a click and an error, how many pairs aren't separated, and the number of pairs."""
    e = _spans(spark, sf_dir)
    return spans.clearance(e.where("event_type = 'click'"), e.where("event_type = 'error'"), ["user_id"], "lo", "hi", 256)


CLEARANCE_MIN = f"WITH {_EVENTS} SELECT a.user_id, count(*) AS n_pairs, min(greatest(b.lo - a.hi, a.lo - b.hi)) AS clearance, count(*) FILTER (greatest(b.lo - a.hi, a.lo - b.hi) <= 0) AS n_touching FROM e a JOIN e b ON a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'error' GROUP BY a.user_id"


def unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and lines of one order that agree within a tolerance on price, each the only partner of the other."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey k", "l_linenumber ln", "l_partkey part", "l_quantity q")
    a, b = lines.where("ln % 2 = 1").toDF("k", "ln_a", "part_a", "q_a"), lines.where("ln % 2 = 0").toDF("k", "ln_b", "part_b", "q_b")
    pairs = a.join(b, "k").where("abs(q_a - q_b) < 3")
    return matching.unique_pairs(pairs, ["k", "ln_a", "part_a"], ["k", "ln_b", "part_b"]).selectExpr("k order_key", "ln_a", "ln_b", "part_a", "part_b")


UNIQUE_MATCH = """WITH p AS (SELECT a.l_orderkey AS k, a.l_linenumber AS ln_a, b.l_linenumber AS ln_b, a.l_partkey AS part_a, b.l_partkey AS part_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber % 2 = 1 AND b.l_linenumber % 2 = 0 AND abs(a.l_quantity - b.l_quantity) < 3)
SELECT k AS order_key, ln_a, ln_b, part_a, part_b FROM (SELECT *, count(*) OVER (PARTITION BY k, ln_a, part_a) AS ca, count(*) OVER (PARTITION BY k, ln_b, part_b) AS cb FROM p) WHERE ca = 1 AND cb = 1"""


def one_to_one_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with exactly one line, mapped to it, and whether status and flag agree as witnesses."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_partkey").alias("part"), F.min("l_linestatus").alias("status")).where("n = 1")
    orders = table(spark, sf_dir, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("o_orderkey", "part", (F.col("status") == F.col("o_orderstatus")).alias("witness"))


ONE_TO_ONE_MAP = "WITH l AS (SELECT l_orderkey, min(l_partkey) AS part, min(l_linestatus) AS status FROM lineitem GROUP BY 1 HAVING count(*) = 1) SELECT o_orderkey, part, status = o_orderstatus AS witness FROM l JOIN orders ON l_orderkey = o_orderkey"


def nearest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error the nearest view of its user, within ten minutes of the day; ties to the smaller id."""
    e = _spans(spark, sf_dir)
    return matching.nearest_along(e.where("event_type = 'error'"), e.where("event_type = 'view'").withColumnRenamed("event_id", "view_id"), ["user_id"], "event_id", "lo", "view_id", "lo", 600)


NEAREST_LINE = f"""WITH {_EVENTS}, p AS (SELECT a.user_id, a.event_id, b.event_id AS view_id, abs(a.lo - b.lo) AS distance FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'view' AND abs(a.lo - b.lo) <= 600)
SELECT user_id, event_id, view_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY distance, view_id) AS rn FROM p) WHERE rn = 1"""


def next_right_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the next event of its user that begins after it ends, by start and id."""
    e = _spans(spark, sf_dir)
    return matching.next_along(e.where("event_type = 'purchase'"), e.selectExpr("user_id", "event_id next_id", "lo next_lo"), ["user_id"], "event_id", "hi", "next_id", "next_lo")


NEXT_RIGHT_NEIGHBOUR = f"""WITH {_EVENTS}, p AS (SELECT a.user_id, a.event_id, b.event_id AS next_id, b.lo AS next_lo, row_number() OVER (PARTITION BY a.event_id ORDER BY b.lo, b.event_id) AS rn FROM e a JOIN e b ON a.user_id = b.user_id AND b.lo >= a.hi WHERE a.event_type = 'purchase')
SELECT user_id, event_id, next_id, next_lo FROM p WHERE rn = 1"""


def band_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half gaps of an event to its neighbours by start, capped: the band that it may use."""
    w = Window.partitionBy("user_id").orderBy("lo", "event_id")
    e = _spans(spark, sf_dir)
    up, down = F.least((F.col("lo") - F.lag("lo").over(w)) / 2, F.lit(300.0)), F.least((F.lead("lo").over(w) - F.col("lo")) / 2, F.lit(300.0))
    return e.select("event_id", F.coalesce(up, F.lit(300.0)).alias("above"), F.coalesce(down, F.lit(300.0)).alias("below"))


BAND_NEIGHBOURS = f"WITH {_EVENTS} SELECT event_id, CAST(coalesce(least((lo - lag(lo) OVER o) / 2.0, 300), 300) AS DOUBLE) AS above, CAST(coalesce(least((lead(lo) OVER o - lo) / 2.0, 300), 300) AS DOUBLE) AS below FROM e WINDOW o AS (PARTITION BY user_id ORDER BY lo, event_id)"


def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups and the intervals of the user's other events that contain their start."""
    e = _spans(spark, sf_dir)
    points = e.where("event_type = 'signup'").selectExpr("user_id", "event_id point_id", "lo at")
    found = spans.points_in(points, e.where("event_type <> 'signup'").selectExpr("user_id u", "event_id span_id", "lo start", "hi end").withColumnRenamed("u", "user_id"), ["user_id"], "at", "start", "end")
    return found.select("point_id", "span_id", "at", "start", "end")


POINT_IN_INTERVAL = f"WITH {_EVENTS} SELECT a.event_id AS point_id, b.event_id AS span_id, a.lo AS at, b.lo AS start, b.hi AS \"end\" FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type <> 'signup' AND b.lo <= a.lo AND a.lo < b.hi"

_EDITS = "ed AS (SELECT conv_id, turn * 40 AS start, turn * 40 + turn % 3 * 5 AS \"end\", length(role) AS len, role FROM conversations)"


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", (turn * 40).alias("start"), (turn * 40 + turn % 3 * 5).alias("end"), F.char_length("role").cast("long").alias("length"), F.col("role").alias("insert"))


def offset_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of conversations after the edits of their turns; null where an edit consumed them."""
    edits = _edits(spark, sf_dir)
    points = edits.select("conv_id", F.explode(F.array(F.col("start") + 3, F.col("start") + 20)).alias("at"))
    return spans.map_offsets(points, edits, "conv_id")


OFFSET_MAP = f"""WITH {_EDITS}, pt AS (SELECT DISTINCT conv_id, start + unnest([3, 20]) AS at FROM ed)
SELECT p.conv_id, p.at, CASE WHEN count(*) FILTER (e.start <= p.at AND p.at < e."end") = 0 THEN p.at + CAST(coalesce(sum(CASE WHEN e."end" <= p.at THEN e.len - (e."end" - e.start) ELSE 0 END), 0) AS BIGINT) END AS mapped
FROM pt p LEFT JOIN ed e ON p.conv_id = e.conv_id AND e.start <= p.at GROUP BY p.conv_id, p.at"""


def mutation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's replacements that conflict; errors are insertions, and two of them are an ordered pair."""
    e = _spans(spark, sf_dir).select("event_id", "user_id", "lo", F.when(F.col("event_type") == "error", F.col("lo")).otherwise(F.col("hi")).alias("end"), (F.col("event_type") == "error").alias("o"))
    pairs = spans.conflict_pairs(e, ["user_id"], "event_id", "lo", "end", "o", 256)
    return pairs.groupBy("user_id").agg(F.count("*").alias("n_conflicts"), F.count_if(F.col("a_ordered") | F.col("b_ordered")).alias("n_with_insertion"))


MUTATION_CONFLICTS = f"""WITH {_EVENTS}, m AS (SELECT event_id, user_id, lo, CASE WHEN event_type = 'error' THEN lo ELSE hi END AS en, event_type = 'error' AS o FROM e)
SELECT a.user_id, count(*) AS n_conflicts, count(*) FILTER (a.o OR b.o) AS n_with_insertion FROM m a JOIN m b ON a.user_id = b.user_id AND a.event_id < b.event_id
AND ((a.lo < b.en AND b.lo < a.en) OR ((a.lo = a.en OR b.lo = b.en) AND a.lo <= b.en AND b.lo <= a.en AND NOT (a.o AND b.o))) GROUP BY a.user_id"""


def edit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts after the edits of the conversation with their number."""
    docs = table(spark, sf_dir, "documents")
    edits = _edits(spark, sf_dir).withColumnRenamed("conv_id", "doc_id")
    joined = edits.join(docs.select("doc_id", F.char_length("text").alias("n")), "doc_id").where("end <= n").select("doc_id", "start", "end", "insert")
    out = spans.apply_edits(docs.select("doc_id", "text"), joined, "doc_id")
    return out.select("doc_id", F.char_length("edited").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))


EDIT_APPLY = f"""WITH {_EDITS}, k AS (SELECT d.doc_id, d.text, e.start, e."end" AS en, e.role, lead(e.start) OVER (PARTITION BY d.doc_id ORDER BY e.start) AS nxt, row_number() OVER (PARTITION BY d.doc_id ORDER BY e.start) AS n
FROM documents d JOIN ed e ON d.doc_id = e.conv_id AND e."end" <= length(d.text)),
p AS (SELECT doc_id, string_agg(CASE WHEN n = 1 THEN substr(text, 1, start) ELSE '' END || role || substr(text, en + 1, coalesce(nxt, length(text)) - en), '' ORDER BY n) AS t FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(length(coalesce(t, text)) AS BIGINT) AS n_chars, sha256(coalesce(t, text)) AS edited_sha256 FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id"""


def range_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range in the middle of each text after one edit whose place depends on the id."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast("long").alias("n"))
    d = d.select("doc_id", (F.col("n") / 4).cast("long").alias("lo"), (F.col("n") / 2).cast("long").alias("hi"), (F.col("n") * (F.col("doc_id") % 7) / 8).cast("long").alias("start"))
    d = d.withColumn("end", F.col("start") + F.col("doc_id") % 5)
    lo, hi, crosses = spans.project_range(F.col("lo"), F.col("hi"), F.col("start"), F.col("end"), F.lit(9), F.col("doc_id") % 2 == 0)
    return d.select("doc_id", lo.cast("long").alias("new_lo"), hi.cast("long").alias("new_hi"), crosses.alias("crosses"))


RANGE_PROJECT = """WITH d AS (SELECT doc_id, length(text) // 4 AS lo, length(text) // 2 AS hi, length(text) * (doc_id % 7) // 8 AS s, doc_id % 2 = 0 AS inside FROM documents),
e AS (SELECT *, s + doc_id % 5 AS en, 9 - doc_id % 5 AS delta FROM d),
c AS (SELECT *, (s < lo AND lo < en) OR (s < hi AND hi < en) AS crosses, s = en AS ins FROM e)
SELECT doc_id, CAST(CASE WHEN NOT crosses THEN CASE WHEN en < lo OR (en = lo AND NOT (ins AND inside)) THEN lo + delta ELSE lo END END AS BIGINT) AS new_lo,
CAST(CASE WHEN NOT crosses THEN CASE WHEN en < lo OR (en = lo AND NOT (ins AND inside)) THEN hi + delta WHEN s > hi OR (s = hi AND NOT (ins AND inside)) THEN hi ELSE hi + delta END END AS BIGINT) AS new_hi, crosses FROM c"""


def style_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event types of a user, in the order of time."""
    return islands.run_lengths(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "run", "event_type", F.col("start").cast("long"), "length")


STYLE_RUNS = """WITH o AS (SELECT user_id, event_type, row_number() OVER w - 1 AS pos, CAST(event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 AS INT) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, min(pos) AS start, count(*) AS length FROM r GROUP BY user_id, run"""


def rle_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the runs of a user follow each other without gap and differ from the next, and how many rows they hold; some runs are lost, moved or doubled."""
    runs = islands.run_lengths(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    broken = runs.where("not (user_id % 5 = 1 and run = 2)").withColumn("start", F.col("start") + F.when((F.col("user_id") % 5 == 2) & (F.col("run") == 3), 1).otherwise(0))
    doubled = broken.where("user_id % 5 = 3 and run = 1").withColumns({"start": F.col("start") + F.col("length"), "run": F.col("run") + 1})
    return islands.runs_are_partition(broken.unionByName(doubled), ["user_id"], "event_type")


# by the places that the runs cover: each of 0 to n - 1 once, and no two neighbours of one type
RLE_VALIDATE = """WITH o AS (SELECT user_id, event_type, row_number() OVER w - 1 AS pos, CAST(event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 AS INT) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, event_type, pos, sum(c) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM o),
g AS (SELECT user_id, run, any_value(event_type) AS t, min(pos) AS s, count(*) AS n FROM r GROUP BY user_id, run),
b AS (SELECT user_id, run, t, s + CASE WHEN user_id % 5 = 2 AND run = 3 THEN 1 ELSE 0 END AS s, n FROM g WHERE NOT (user_id % 5 = 1 AND run = 2) UNION ALL SELECT user_id, run + 1, t, s + n, n FROM g WHERE user_id % 5 = 3 AND run = 1),
k AS (SELECT user_id, t, unnest(range(s, s + n)) AS p, s FROM b),
v AS (SELECT user_id, count(*) = count(DISTINCT p) AND min(p) = 0 AND max(p) = count(*) - 1 AS whole, count(*) AS total FROM k GROUP BY user_id),
x AS (SELECT a.user_id, bool_or(a.t = c.t) AS same FROM b a JOIN b c ON a.user_id = c.user_id AND c.s = a.s + a.n GROUP BY a.user_id)
SELECT v.user_id, whole AND NOT coalesce(same, false) AS contiguous, CAST(total AS BIGINT) AS total FROM v LEFT JOIN x ON v.user_id = x.user_id"""


def chain_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of a user's events that follow within the hour: where each begins and its links."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.lead("event_id").over(w).alias("nxt"), (F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("gap"))
    return graph.chains(e.where("gap <= 3600000000").select("user_id", "event_id", "nxt"), ["user_id"], "event_id", "nxt")


CHAIN_FOLLOWING = """WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap, row_number() OVER w AS pos FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(CAST(coalesce(gap > 3600000000, true) AS INT)) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isl FROM e)
SELECT user_id, arg_min(event_id, pos) AS head, count(*) - 1 AS n FROM i GROUP BY user_id, isl HAVING count(*) > 1"""


def fallback_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents matched to the smallest other id of equal source, language and size; those without, of a near size."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    exact, near = matching.neighbours_in_size(d, "doc_id", ["lang", "source"], "n_chars", 50)
    return matching.with_fallback(exact, d, near, "doc_id")


FALLBACK_MATCH = """WITH x AS (SELECT a.doc_id, min(b.doc_id) AS other FROM documents a JOIN documents b ON a.lang = b.lang AND a.source = b.source AND a.n_chars = b.n_chars AND a.doc_id <> b.doc_id GROUP BY 1),
y AS (SELECT doc_id, other FROM (SELECT a.doc_id, b.doc_id AS other, row_number() OVER (PARTITION BY a.doc_id ORDER BY abs(a.n_chars - b.n_chars), b.doc_id) AS rn FROM documents a JOIN documents b ON a.lang = b.lang AND a.source = b.source AND a.n_chars // 50 = b.n_chars // 50 AND a.doc_id <> b.doc_id) WHERE rn = 1)
SELECT doc_id, other, 1 AS rule FROM x UNION ALL SELECT doc_id, other, 2 FROM y WHERE doc_id NOT IN (SELECT doc_id FROM x)"""


def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that sold at least one part of every brand."""
    facts = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, sf_dir, "part").selectExpr("p_partkey l_partkey", "p_brand"), "l_partkey")
    return matching.divide(facts, ["l_suppkey"], ["p_brand"], table(spark, sf_dir, "part"))


RELATIONAL_DIVISION = "SELECT l_suppkey, count(DISTINCT p_brand) AS got FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT p_brand) = (SELECT count(DISTINCT p_brand) FROM part)"


def multiset_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs, with multiplicity, between the lines of odd and of even parts."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    side = lambda r: l.where(F.col("l_partkey") % 2 == r).select("l_quantity", "l_returnflag", "l_linestatus", "l_linenumber")
    out = matching.residue(side(1), side(0))
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


MULTISET_RESIDUE = """WITH a AS (SELECT l_quantity, l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_partkey % 2 = 1), b AS (SELECT l_quantity, l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_partkey % 2 = 0),
r AS (SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT l_quantity, l_returnflag, l_linestatus, l_linenumber, side, count(*) AS n FROM r GROUP BY ALL"""


def tolerant_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks of a user matched by value within 0.5, each once and in order: what is left over."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    return matching.tolerant_residue(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", "value", "event_id", 0.5)


def ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of nations, customers and orders: order, customer, nation, region."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = (
        table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent"))
        .unionAll(table(spark, sf_dir, "customer").select(key("c", "c_custkey"), key("n", "c_nationkey")))
        .unionAll(table(spark, sf_dir, "orders").select(key("o", "o_orderkey"), key("c", "o_custkey")))
    )
    return graph.descendants(edges, "child", "parent")


ANCESTOR_CHAIN = """WITH RECURSIVE e(child, parent) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
w(node, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT w.node, e.parent, w.depth + 1 FROM w JOIN e ON w.ancestor = e.child)
SELECT ancestor, depth, count(*) AS n_descendants FROM w GROUP BY ancestor, depth"""


#: Turns that follow others: gaps, forks and cycles among them.
_FOLLOWS = "CASE WHEN conv_id % 5 = 1 AND turn = 0 THEN 2 WHEN turn = 0 THEN NULL WHEN turn % 4 = 3 THEN turn - 2 WHEN (conv_id + turn) % 9 = 5 THEN turn + 1000 ELSE turn - 1 END AS prev"


def follow_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of each turn along the turns that it follows; none where the chain has a gap or goes round."""
    links = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", _FOLLOWS)
    return graph.positions(links, ["conv_id"], "turn", "prev").select("conv_id", "turn", "position", "status")


FOLLOW_ORDER = f"""WITH RECURSIVE f AS (SELECT conv_id, turn, {_FOLLOWS} FROM conversations),
w(conv_id, turn, n, status) AS (SELECT conv_id, turn, 0, CASE WHEN prev IS NULL THEN 'ordered' ELSE 'gap' END FROM f WHERE prev IS NULL OR NOT EXISTS (SELECT 1 FROM f g WHERE g.conv_id = f.conv_id AND g.turn = f.prev)
UNION ALL SELECT f.conv_id, f.turn, w.n + 1, w.status FROM w JOIN f ON f.conv_id = w.conv_id AND f.prev = w.turn)
SELECT f.conv_id, f.turn, CASE WHEN w.status = 'ordered' THEN CAST(w.n AS BIGINT) END AS position, coalesce(w.status, 'cycle') AS status FROM f LEFT JOIN w ON f.conv_id = w.conv_id AND f.turn = w.turn"""


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two words begin in each text, overlaps counted."""
    return table(spark, sf_dir, "documents").select("doc_id", T.occurrences(F.col("text"), F.lit("the")).cast("long").alias("n_the"), T.occurrences(F.col("text"), F.lit("ana")).cast("long").alias("n_ana"))


# a piece after "an" goes on with "a" if it begins so, or is empty and another "an" follows
OCCURRENCES = """WITH p AS (SELECT doc_id, text, string_split(text, 'an') AS ps FROM documents)
SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n_the,
CAST(len(list_filter(ps[2:], lambda x: starts_with(x, 'a'))) + len(list_filter(ps[2:len(ps) - 1], lambda x: x = '')) AS BIGINT) AS n_ana FROM p"""


_F = (
    rect_overlap_pairs, no_collision, clearance_min, unique_match, one_to_one_map, nearest_line, next_right_neighbour, band_neighbours, point_in_interval, offset_map, mutation_conflicts, edit_apply, range_project,
    style_runs, rle_validate, chain_following, fallback_match, relational_division, multiset_residue, tolerant_residue, ancestor_chain, follow_order, occurrences,
)
QUERIES = {f.__name__: f for f in _F}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _F if f.__name__.upper() in globals()}
