"""Queries over painted elements, flows and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.functions.geometry import Rect
from leafmark.operators import elements, graph
from leafmark.plans.layout import _LINES
from leafmark.plans.rules import _split
from leafmark.sources.tables import table, text_lines
from leafmark.storage import stage


def _cols(expression: str) -> list[str]:
    """Select expressions as Spark has them."""
    return [c.strip().replace("//", "div") for c in _split(expression)]


_ID = "l_orderkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT)"
_TEXT = f"l_orderkey // 8 AS page, {_ID} AS id, l_quantity * 8 AS x0, l_linenumber * 30.0 AS y0, l_quantity * 8 + 30 + l_partkey % 60 AS x1, l_linenumber * 30.0 + 12 AS y1, l_partkey % 20 AS first"
_PAINT = "o_orderkey // 8 AS page, o_orderkey AS paint, CASE WHEN o_custkey % 3 = 0 THEN 'stroke' ELSE 'fill' END AS kind, o_custkey % 20 AS seq, o_custkey % 60 * 7 AS x0, o_orderkey % 7 * 30.0 - 2 AS y0, o_custkey % 60 * 7 + o_orderkey % 9 * 40 AS x1, o_orderkey % 7 * 30.0 - 2 + o_custkey % 4 * 10 + 1 AS y1"


def paint_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the paints of a page may relate to its texts: each kind of hint by text."""
    texts, paints = table(spark, sf_dir, "lineitem").selectExpr(*_cols(_TEXT)), table(spark, sf_dir, "orders").selectExpr(*_cols(_PAINT))
    hints = stage(elements.paint_hints(texts, paints, "page"), "hints")
    related = hints.groupBy("id", "hint").agg(F.count("*").alias("n"), F.min("paint").alias("first_paint"))
    return related.unionAll(elements.unrelated_paints(texts, paints, hints, "page").select("id", F.lit("unrelated"), "n", "first"))


PAINT_HINTS = f"""WITH t AS (SELECT {_TEXT} FROM lineitem), p AS (SELECT {_PAINT} FROM orders),
h AS (SELECT t.id, p.paint, CASE WHEN NOT (p.x0 < t.x1 AND t.x0 < p.x1 AND p.y0 < t.y1 AND t.y0 < p.y1) THEN 'unrelated' WHEN kind = 'fill' AND p.x0 <= t.x0 AND p.y0 <= t.y0 AND p.x1 >= t.x1 AND p.y1 >= t.y1 AND seq < first THEN 'background'
WHEN p.y1 - p.y0 < 2 AND seq >= first THEN 'decoration' ELSE 'overlap or border' END AS hint FROM t JOIN p ON t.page = p.page)
SELECT id, hint, count(*) AS n, min(paint) AS first_paint FROM h GROUP BY id, hint"""

_MARKED = f"l_orderkey // 8 AS page, {_ID} AS line, l_partkey % 4 * 100.0 AS x0, l_partkey % 4 * 100 + 60.0 AS x1, l_linenumber * 15.0 AS baseline, 12.0 AS size, l_suppkey % 9 AS seq"
_MARK = "o_orderkey // 8 AS page, o_orderkey AS mark, o_custkey % 4 * 100 + o_custkey % 5 * 0.5 AS x0, o_orderkey % 7 * 15 + 15 + o_custkey % 6 * 0.7 AS y0, o_custkey % 4 * 100 + 60 + o_custkey % 3 * 1.5 AS x1, o_orderkey % 7 * 15 + 15 + o_custkey % 6 * 0.7 + 0.4 + o_custkey % 2 * 1.1 AS y1, 5 AS seq"


def line_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one line that each thin mark of a page belongs to."""
    found = elements.line_anchors(table(spark, sf_dir, "lineitem").selectExpr(*_cols(_MARKED)), table(spark, sf_dir, "orders").selectExpr(*_cols(_MARK)), "page")
    return found.select("mark", "line", F.round(F.col("offset").cast("double"), 4).alias("off"))


LINE_ANCHORS = f"""WITH l AS (SELECT {_MARKED} FROM lineitem), m AS (SELECT {_MARK} FROM orders),
f AS (SELECT m.mark, l.line, m.y0 - baseline AS o FROM l JOIN m ON l.page = m.page AND m.seq > l.seq AND m.y1 - m.y0 > 0 AND m.y1 - m.y0 < 2.4 AND m.y0 - baseline >= 0 AND m.y0 - baseline < 3.6 AND abs(m.x0 - l.x0) <= 1.8 AND abs(m.x1 - l.x1) <= 3.6)
SELECT mark, min(line) AS line, round(CAST(min(o) AS DOUBLE), 4) AS off FROM f GROUP BY mark HAVING count(*) = 1"""


def frame_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The width that the narrowest drawing around each text gives it."""
    return elements.frame_widths(table(spark, sf_dir, "lineitem").selectExpr(*_cols(_TEXT)), table(spark, sf_dir, "orders").selectExpr(*_cols(_PAINT)), "page", 300.0)


FRAME_WIDTHS = f"""WITH t AS (SELECT {_TEXT} FROM lineitem), p AS (SELECT {_PAINT} FROM orders)
SELECT t.id, min(p.x1 - t.x0) AS width FROM t LEFT JOIN p ON t.page = p.page AND p.x0 <= t.x0 AND p.y0 <= t.y0 AND p.x1 >= t.x1 AND p.y1 >= t.y1 AND p.x1 - p.x0 <= 300 GROUP BY t.id"""

_BESIDE = "event_id, event_id % 90 * 5.0 AS bx0, event_id % 30 * 6.0 AS by0, event_id % 90 * 5 + 40.0 AS bx1, event_id % 30 * 6 + user_id * 3.0 AS by1, 100.0 AS cx0, 50.0 AS cy0, 260.0 AS cx1, 120.0 AS cy1, 90 + user_id % 40 * 1.0 AS ox0, 0.0 AS oy0, 200 + user_id * 4.0 AS ox1, 0.0 AS oy1, 125 + user_id % 7 * 4.0 AS row1"


def side_of_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paints that stand beside a column of text."""
    e = table(spark, sf_dir, "events").selectExpr(*_cols(_BESIDE))
    return e.where(elements.beside_column(Rect.of("b"), Rect.of("c"), Rect.of("o"), F.col("row1"))).select("event_id")


SIDE_OF_COLUMN = f"SELECT event_id FROM (SELECT {_BESIDE} FROM events) WHERE (bx0 >= greatest(cx1, ox1) + 0.5 OR bx1 <= least(cx0, ox0) - 0.5) AND by0 <= cy1 AND by1 >= row1 - 0.5"


def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a page joined to lines by their heights: rows and reach of each line."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey div 8 AS page", f"{_ID} AS ord", "l_linenumber * 14.0 + l_partkey % 9 AS top", "l_linenumber * 14.0 + l_partkey % 9 + 6 + l_suppkey % 9 AS bottom")
    return elements.visual_lines(rows, ["page"]).groupBy("page", "line").agg(F.count("*").alias("n_rows"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))


def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line of a text is found, one after the other."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", "\n").alias("lines"))
    return elements.line_ranges(d, "doc_id", "text", "lines").groupBy("key").agg(F.count("start").alias("n_found"), F.max("end").alias("last_end"), F.sum(F.col("end") - F.col("start")).alias("n_chars")).withColumnRenamed("key", "doc_id")


_SPLIT = "event_id, 40 + user_id AS nf, 90 + user_id AS n, event_id % 97 AS s, event_id % 97 + event_id % 6 AS z, event_id % 4 AS k, 40 + user_id + event_id % 9 - 6 AS b"


def edit_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of two neighbouring owners' texts: characters kept, moved and inserted, or why an edit isn't allowed."""
    e = table(spark, sf_dir, "events").selectExpr(*_cols(_SPLIT))
    counts, reason = elements.provenance(*[F.col(c) for c in ("nf", "n", "s", "z", "k", "b")])
    return e.select("event_id", *[v.alias(k) for k, v in counts.items()], reason.alias("reason"))


# every resulting character with where it comes from
EDIT_PROVENANCE = f"""WITH e AS (SELECT {_SPLIT} FROM events), q AS (SELECT *, n + k - (z - s) AS m, CASE WHEN s < nf AND z <= nf THEN 0 WHEN s > nf THEN 1 END AS o FROM e),
c AS (SELECT event_id, nf, b, o, i, CASE WHEN i < s THEN i WHEN i < s + k THEN NULL ELSE i - k + (z - s) END AS src FROM (SELECT *, unnest(range(0, greatest(m, 0))) AS i FROM q)),
g AS (SELECT event_id, count(*) FILTER (src < nf AND i < b) AS fr, count(*) FILTER (src < nf AND i >= b) AS mv, count(*) FILTER (src >= nf AND i >= b) AS sr, count(*) FILTER (src IS NULL) AS ins, count(*) FILTER (src >= nf AND i < b) AS wrong, count(*) FILTER (src IS NULL AND (i >= b) <> (o = 1)) AS out_ FROM c GROUP BY event_id),
r AS (SELECT q.*, g.*, CASE WHEN s <= 0 OR s > z OR z >= n OR (s = z AND k = 0) THEN 'no internal edit' WHEN o IS NULL THEN 'across the owners' WHEN b <= 0 OR b >= m THEN 'an owner without text' WHEN out_ > 0 AND o = 0 THEN 'inserted text leaves its owner' WHEN wrong > 0 OR out_ > 0 THEN 'into the first owner' END AS reason FROM q LEFT JOIN g ON q.event_id = g.event_id)
SELECT event_id, CASE WHEN reason IS NULL THEN fr END AS first_retained, CASE WHEN reason IS NULL THEN mv END AS relocated, CASE WHEN reason IS NULL THEN sr END AS second_retained, CASE WHEN reason IS NULL THEN ins END AS inserted, reason FROM r"""


def region_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as paragraphs in slots: the breaks between those that hold text."""
    s = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", f"{_ID} AS slot", "l_partkey AS start", "l_partkey + l_suppkey % 4 AS end", "l_linenumber div 3 AS page")
    # two lines of an order may have one price: the SQL leaves their order open, here it is the same in every run
    return elements.region_breaks(s, ["l_orderkey"], "slot", "page", ("page", "start", "end")).withColumnRenamed("offset", "at_offset").withColumnRenamed("before", "slot_before").withColumnRenamed("after", "slot_after")


REGION_BREAKS = f"""WITH s AS (SELECT l_orderkey, {_ID} AS slot, l_partkey + l_suppkey % 4 AS en, l_linenumber // 3 AS page FROM lineitem WHERE l_suppkey % 4 > 0),
n AS (SELECT *, lead(slot) OVER w AS nx, lead(page) OVER w AS np FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY slot)) SELECT l_orderkey, en AS at_offset, slot AS slot_before, nx AS slot_after, CASE WHEN np <> page THEN 'page_break' ELSE 'container_break' END AS kind FROM n WHERE nx IS NOT NULL"""

_FLOW = "SELECT o_orderkey AS node, CASE WHEN o_orderkey % 40 > 0 THEN o_orderkey - 1 - o_custkey % 2 * (o_orderkey % 40 // 2) END AS prev, CAST(o_custkey % 9 AS DOUBLE) + CASE WHEN o_orderkey % 40 > 0 THEN 14 ELSE 100 END AS step FROM orders"


def flow_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that follow others in a flow: the last baseline of each, along the tree of what it follows."""
    links = spark.sql(_FLOW.replace("//", "div").replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return graph.positions(links, [], "node", "prev", weight="step").select("node", F.col("total").alias("last_baseline"), "status")


FLOW_BASELINES = f"""WITH RECURSIVE f AS ({_FLOW}), w(node, total) AS (SELECT node, step FROM f WHERE prev IS NULL UNION ALL SELECT f.node, w.total + f.step FROM w JOIN f ON f.prev = w.node)
SELECT f.node, w.total AS last_baseline, CASE WHEN w.node IS NULL THEN 'gap' ELSE 'ordered' END AS status FROM f LEFT JOIN w ON f.node = w.node"""

_BELOW = f"l_orderkey // 8 AS page, {_ID} AS ord, l_partkey % 40 * 9.0 AS top, l_partkey % 40 * 9.0 + 6 + l_suppkey % 30 AS bottom"


def chain_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a page that a growing area takes in from the first down."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_cols(_BELOW))
    return elements.chain_reach(rows, ["page"], F.lit(3.0)).groupBy("page").agg(F.count("*").alias("n_rows"), F.max("bottom").alias("reach"))


CHAIN_REACH = f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY top, ord) AS i FROM (SELECT {_BELOW} FROM lineitem)),
w(page, i, reach) AS (SELECT page, i, bottom FROM r WHERE i = 1 UNION ALL SELECT r.page, r.i, greatest(w.reach, r.bottom) FROM w JOIN r ON r.page = w.page AND r.i = w.i + 1 AND r.top < w.reach + 3)
SELECT page, count(*) AS n_rows, max(reach) AS reach FROM w GROUP BY page"""

_ROLES = "SELECT 'c' || c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN 'P' WHEN c_custkey % 31 = 1 THEN 'c' || c_custkey ELSE 'c' || (c_custkey - 1) END AS target FROM customer"


def role_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names mapped to names: where each leads in the end, or that it goes round."""
    return graph.terminals(spark.sql(_ROLES.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer")), "name", "target")


ROLE_MAP = f"""WITH RECURSIVE m AS ({_ROLES}), w(name, at_, n) AS (SELECT name, target, 1 FROM m UNION ALL SELECT w.name, m.target, n + 1 FROM w JOIN m ON m.name = w.at_ WHERE n < 100)
SELECT m.name, any_value(w.at_) FILTER (w.at_ NOT IN (SELECT name FROM m)) AS mapped, CASE WHEN count(*) FILTER (w.at_ NOT IN (SELECT name FROM m)) > 0 THEN 'mapped' ELSE 'cycle' END AS status FROM m JOIN w ON w.name = m.name GROUP BY m.name"""


def justified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By text: what the spaces of its lines are widened by, to the widest line of it."""
    lines = text_lines(table(spark, sf_dir, "documents")).where(F.btrim("line") != "")
    ink = F.rtrim("line")
    spaces = F.char_length(F.ltrim(ink)) - F.char_length(F.replace(F.ltrim(ink), F.lit(" "), F.lit("")))
    widest = lines.groupBy("doc_id").agg(F.max("line_width").alias("widest"))
    share = elements.space_share(F.col("widest"), F.col("line_width"), spaces, F.lit(12))
    return lines.join(widest, "doc_id").withColumn("share", share).groupBy("doc_id").agg(F.count_if(F.col("share") > 0).alias("n_justified"), F.round(F.sum("share"), 4).alias("total_share"))


JUSTIFIED_LINES = rf"""WITH {_LINES}, l AS (SELECT doc_id, line_width AS w, len(string_split(trim(line, ' '), ' ')) - 1 AS k, max(line_width) OVER (PARTITION BY doc_id) AS m FROM measured WHERE regexp_matches(line, '[^ ]')),
s AS (SELECT doc_id, CASE WHEN k > 0 AND m > w AND m - w <= k * 12 THEN (m - w) / k ELSE 0 END AS sh FROM l) SELECT doc_id, count(*) FILTER (sh > 0) AS n_justified, round(CAST(sum(sh) AS DOUBLE), 4) AS total_share FROM s GROUP BY doc_id"""


def pixel_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rasters of each page, lines of orders as pixels: how many differ and where, without those of a mask."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey div 8").alias("page"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 48).alias("y")).agg(F.max("l_quantity").alias("v"))
    after = p.where("x % 13 > 0").withColumn("v", F.col("v") + F.when(F.col("x") % 5 == 0, F.col("y") % 12).otherwise(0))
    return elements.pixel_differences(p, after, "page", p.where("y % 6 = 0"))


PIXEL_DIFFERENCES = """WITH p AS (SELECT l_orderkey // 8 AS page, l_partkey % 64 AS x, l_suppkey % 48 AS y, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3),
d AS (SELECT page, x, y, CASE WHEN x % 13 = 0 THEN v WHEN x % 5 = 0 THEN y % 12 ELSE 0 END AS d FROM p WHERE y % 6 > 0)
SELECT page, count(*) FILTER (d > 0) AS n_differ, count(*) FILTER (d > 8) AS n_strong, min(x) FILTER (d > 0) AS x0, min(y) FILTER (d > 0) AS y0, max(x) FILTER (d > 0) AS x1, max(y) FILTER (d > 0) AS y1 FROM d GROUP BY page"""


def weight_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far three faces' glyph weights are from those of the first letters of each user's events."""
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id AS ord", "event_type || event_id % 11 AS ch", "CAST(event_id % 17 AS DOUBLE) / 17 AS weight")
    faces = table(spark, sf_dir, "events").selectExpr("event_id % 3 AS face", "event_type || event_id % 11 AS ch").distinct().withColumn("weight", (F.char_length("ch") * (F.col("face") + 1) % 7) / 7)
    return elements.weight_scores(e, faces, ["user_id"])


WEIGHT_SCORES = """WITH e AS (SELECT user_id, event_id AS o, event_type || event_id % 11 AS ch, CAST(event_id % 17 AS DOUBLE) / 17 AS w FROM events), f AS (SELECT DISTINCT event_id % 3 AS face, event_type || event_id % 11 AS ch FROM events),
s AS (SELECT user_id, ch, min(o) AS o, arg_min(w, o) AS w FROM e GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) AS i FROM s)
SELECT k.user_id, f.face, round(avg(abs(CAST(length(f.ch) * (f.face + 1) % 7 AS DOUBLE) / 7 - k.w)), 5) AS distance, count(*) AS n FROM k JOIN f ON k.ch = f.ch WHERE i <= 24 GROUP BY 1, 2"""

_OBJECT = """CASE event_id % 6 WHEN 0 THEN '{"id":1,"kind":"a"}' WHEN 1 THEN '{"id":2}' WHEN 2 THEN '{"id":3,"kind":"b","note":null}' WHEN 3 THEN '{"kind":"c","' || event_type || '":1}' WHEN 4 THEN '[1]' ELSE '{}' END"""


def contract_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored objects against a closed set of keys: what is missing and what is unknown."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", f"{_OBJECT} AS j")
    missing, unknown = elements.contract_faults(F.col("j"), ["id", "kind"], ["note"])
    return e.select("event_id", F.array_join(F.sort_array(missing), ",").alias("missing"), F.array_join(F.sort_array(unknown), ",").alias("unknown"))


CONTRACT_FAULTS = f"""WITH e AS (SELECT event_id, {_OBJECT} AS j FROM events), k AS (SELECT event_id, CASE WHEN json_type(j) = 'OBJECT' THEN json_keys(j) END AS ks FROM e)
SELECT event_id, array_to_string(list_filter(['id', 'kind'], lambda x: CASE WHEN ks IS NULL THEN NULL ELSE NOT list_contains(ks, x) END), ',') AS missing0, NULL AS unknown FROM k WHERE false
UNION ALL SELECT event_id, CASE WHEN ks IS NOT NULL THEN array_to_string(list_filter(['id', 'kind'], lambda x: NOT list_contains(ks, x)), ',') END, CASE WHEN ks IS NOT NULL THEN array_to_string(list_sort(list_filter(ks, lambda x: x NOT IN ('id', 'kind', 'note'))), ',') END FROM k""".replace("missing0", "missing")

_SLOT = f"l_orderkey // 8 AS page, {_ID} AS slot, l_quantity * 4 AS x0, l_linenumber * 30.0 AS y0, l_quantity * 4 + 50 AS x1, l_linenumber * 30.0 + 14 AS y1"


def occupancy_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots whose planned ink, fourteen points lower, meets other texts: what each needs done before it."""
    s = table(spark, sf_dir, "lineitem").selectExpr(*_cols(_SLOT))
    return elements.occupancy_needs(s.withColumns({"y0": F.col("y0") + 20, "y1": F.col("y1") + 20}), s, ["page"]).groupBy("page", "task").agg(F.count("*").alias("n_needs"), F.min("need").alias("first_need"))


OCCUPANCY_NEEDS = f"""WITH s AS (SELECT {_SLOT} FROM lineitem) SELECT a.page, a.slot AS task, count(DISTINCT b.slot) AS n_needs, min(b.slot) AS first_need FROM s a JOIN s b ON a.page = b.page AND a.slot <> b.slot AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 + 20 < b.y1 AND b.y0 < a.y1 + 20 GROUP BY 1, 2"""

_GLYPH = "l_orderkey AS k, l_linenumber // 3 AS line, l_linenumber AS at_, l_quantity AS x0, l_quantity + 6 AS x1, CASE WHEN l_partkey % 13 = 0 THEN 61.0 ELSE 60.0 END AS baseline, l_suppkey % 3 = 0 AS blank"


def mark_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What marks over ranges of an order's glyphs cover on each line."""
    g = table(spark, sf_dir, "lineitem").selectExpr(*_cols(_GLYPH)).withColumnRenamed("at_", "at")
    m = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS mark", "o_custkey % 3 AS start", "o_custkey % 3 + o_custkey % 5 AS end")
    return elements.mark_rectangles(g, m, ["k"])


MARK_RECTANGLES = f"""WITH g AS (SELECT {_GLYPH} FROM lineitem), m AS (SELECT o_orderkey AS k, o_custkey AS mark, o_custkey % 3 AS s, o_custkey % 3 + o_custkey % 5 AS z FROM orders)
SELECT g.k, m.mark, g.line, min(x0) AS x0, max(x1) AS x1, CASE WHEN count(DISTINCT baseline) = 1 THEN min(baseline) END AS baseline FROM g JOIN m ON g.k = m.k AND at_ >= s AND at_ < z WHERE NOT blank GROUP BY 1, 2, 3"""

_ITEM = "l_orderkey // 8 AS page, l_partkey % 50 * 8 AS x0, l_suppkey % 40 * 6 AS y0, l_partkey % 50 * 8 + 20 AS x1, l_suppkey % 40 * 6 + 10 AS y1, l_returnflag AS ch"
_AREA = "o_orderkey // 8 AS page, o_custkey % 50 * 8 AS x0, o_custkey % 40 * 6 AS y0, o_custkey % 50 * 8 + 60 AS x1, o_custkey % 40 * 6 + 50 AS y1"


def kept_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a page outside the areas that were edited: what is missing afterwards, and what is new."""
    items = table(spark, sf_dir, "lineitem")
    before, after = items.where("l_linenumber <> 3").selectExpr(*_cols(_ITEM)), items.where("l_linenumber <> 2").selectExpr(*_cols(_ITEM))
    return elements.kept_outside(before, after, table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").selectExpr(*_cols(_AREA)), "page", ["ch"])


KEPT_OUTSIDE = f"""WITH a AS (SELECT {_AREA} FROM orders WHERE o_custkey % 2 = 0), b0 AS (SELECT {_ITEM} FROM lineitem WHERE l_linenumber <> 3), c0 AS (SELECT {_ITEM} FROM lineitem WHERE l_linenumber <> 2),
b AS (SELECT * FROM b0 WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.page = b0.page AND a.x0 < b0.x1 AND b0.x0 < a.x1 AND a.y0 < b0.y1 AND b0.y0 < a.y1)), c AS (SELECT * FROM c0 WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.page = c0.page AND a.x0 < c0.x1 AND c0.x0 < a.x1 AND a.y0 < c0.y1 AND c0.y0 < a.y1)),
p AS (SELECT page FROM b UNION SELECT page FROM c), m AS (SELECT page, count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM c) GROUP BY page), x AS (SELECT page, count(*) AS n FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM b) GROUP BY page)
SELECT p.page, CAST(coalesce(m.n, 0) AS BIGINT) AS n_missing, CAST(coalesce(x.n, 0) AS BIGINT) AS n_extra FROM p LEFT JOIN m ON m.page = p.page LEFT JOIN x ON x.page = p.page"""


def placement_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs of an order as planned and as drawn: those lost, and the worst position."""
    # lines of an order may have one price: places are told apart by all that a glyph is made of
    place = Window.partitionBy("l_orderkey", "id").orderBy("ch", "x", "y", "l_partkey")
    g = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", f"{_ID} AS id", "l_returnflag AS ch", "l_quantity AS x", "l_discount AS y", "l_partkey")
    g = g.withColumn("at", F.struct("id", F.row_number().over(place))).drop("id")
    drawn = g.where("l_partkey % 17 > 0").selectExpr("l_orderkey", "at", "CASE WHEN l_partkey % 23 = 0 THEN '?' ELSE ch END AS ch", "x + l_partkey % 4 * 0.25 AS x", "y")
    return elements.placement_errors(g.drop("l_partkey"), drawn, ["l_orderkey"]).withColumn("worst", F.round("worst", 6))


PLACEMENT_ERRORS = """SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_partkey % 17 = 0 OR l_partkey % 23 = 0) AS n_lost, round(CAST(max(l_partkey % 4 * 0.25) FILTER (l_partkey % 17 > 0 AND l_partkey % 23 > 0) AS DOUBLE), 6) AS worst FROM lineitem GROUP BY l_orderkey"""


_F = (
    paint_hints, line_anchors, frame_widths, side_of_column, visual_lines, line_ranges, edit_provenance, region_breaks, flow_baselines, chain_reach, role_map, justified_lines, pixel_differences, weight_scores, contract_faults, occupancy_needs,
    mark_rectangles, kept_outside, placement_errors,
)
QUERIES = {f.__name__: f for f in _F}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _F if f.__name__.upper() in globals()}
