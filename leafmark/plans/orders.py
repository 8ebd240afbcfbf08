"""Queries over orders of changes, origins, bands, reachable definitions and merged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.operators import orders
from leafmark.plans.elements import _ID, _cols
from leafmark.plans.relations import _EDITS, _edits
from leafmark.sources.tables import table

_MUTATION = f"l_orderkey AS k, {_ID} AS ord, l_linenumber * 3 AS start, l_linenumber * 3 + l_partkey % 3 AS z, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 5 END AS insertion"


def application_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which an order's mutations are applied."""
    m = table(spark, sf_dir, "lineitem").selectExpr(*_cols(_MUTATION)).withColumnRenamed("z", "end")
    return orders.application_order(m, ["k"]).select("k", "ord", F.col("position").cast("long").alias("position"))


APPLICATION_ORDER = f"WITH m AS (SELECT {_MUTATION} FROM lineitem) SELECT k, ord, count(*) OVER (PARTITION BY k) - row_number() OVER (PARTITION BY k ORDER BY start, z, coalesce(insertion, -1), ord) AS position FROM m"


def stable_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order numbered by price, whatever their order in the table."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", f"{_ID} AS id", "l_extendedprice")
    return orders.renumbered(rows, ["l_orderkey"], ["l_extendedprice", "id"]).select("l_orderkey", "id", F.col("ordinal").cast("long").alias("ordinal"))


STABLE_ORDINALS = f"WITH r AS (SELECT l_orderkey, {_ID} AS id, l_extendedprice AS p FROM lineitem) SELECT l_orderkey, id, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, id) AS ordinal FROM r"


def edit_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each text after the edits of the conversation with its number, and where they come from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast("long").alias("n"))
    edits = _edits(spark, sf_dir).withColumnRenamed("conv_id", "doc_id").join(docs, "doc_id").where("end <= n").drop("n")
    out = orders.origins(docs, edits, "doc_id")
    return out.select("doc_id", F.col("start").cast("long").alias("piece_start"), F.col("end").cast("long").alias("piece_end"), F.col("origin").cast("long").alias("origin"))


# characters one by one, with the places that they had
EDIT_ORIGINS = f"""WITH {_EDITS}, k AS (SELECT d.doc_id, length(d.text) AS n, e.start, e."end" AS z, e.len FROM documents d JOIN ed e ON d.doc_id = e.conv_id AND e."end" <= length(d.text)),
c AS (SELECT doc_id, unnest(range(length(text))) AS p FROM documents), a AS (SELECT c.doc_id, c.p, c.p AS origin, 1 AS q FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = c.doc_id AND k.start <= c.p AND c.p < k.z)
UNION ALL SELECT doc_id, z, NULL, 0 FROM (SELECT doc_id, z, unnest(range(len)) AS i FROM k)),
o AS (SELECT doc_id, origin, row_number() OVER (PARTITION BY doc_id ORDER BY p, q) - 1 AS at_ FROM a), g AS (SELECT *, CASE WHEN origin IS NULL THEN 0 ELSE at_ - origin END AS shift, CAST(origin IS NULL AS INT) AS ins FROM o),
b AS (SELECT *, CAST(ins <> lag(ins) OVER w OR shift <> lag(shift) OVER w OR row_number() OVER w = 1 AS INT) AS st FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY at_)), r AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY at_ ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT doc_id, min(at_) AS piece_start, max(at_) + 1 AS piece_end, CAST(min(origin) AS BIGINT) AS origin FROM r GROUP BY doc_id, run"""

_AUDIT = """'{"exact":' || user_id || ',"detail":[1,2],"gaps":"' || event_type || '","reason":null}'"""


def compact_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits without the fields that aren't committed: what is left of each."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", f"{_AUDIT} AS j")
    m = orders.kept_fields(F.col("j"), ["exact", "gaps", "reason", "hits"])
    return e.select("event_id", F.array_join(F.sort_array(F.map_keys(m)), ",").alias("fields"), F.element_at(m, "exact").alias("exact"), F.element_at(m, "gaps").alias("gaps"))


COMPACT_AUDITS = f"""WITH e AS (SELECT event_id, {_AUDIT} AS j FROM events) SELECT event_id, array_to_string(list_sort(list_filter(json_keys(j), lambda x: x IN ('exact', 'gaps', 'reason', 'hits'))), ',') AS fields, json_extract_string(j, '$.exact') AS exact, json_extract_string(j, '$.gaps') AS gaps FROM e"""


def page_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose owned lines skip lines of others at their edges."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_quantity AS baseline", "l_partkey % 3 = 0 AS owned")
    return orders.page_seams(lines, ["page"])


PAGE_SEAMS = """WITH l AS (SELECT l_orderkey AS page, l_quantity AS b, l_partkey % 3 = 0 AS o FROM lineitem), e AS (SELECT page, min(b) AS f, max(b) AS l FROM l WHERE o GROUP BY page)
SELECT e.page, (SELECT count(*) FROM l WHERE l.page = e.page AND NOT o AND b < f) AS n_above, (SELECT count(*) FROM l x WHERE x.page = e.page AND NOT x.o AND x.b > e.l) AS n_below FROM e"""


def misplaced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose role contradicts the body band, from 60 to 240 points."""
    lines = table(spark, sf_dir, "events").selectExpr("event_id", "value AS y0", "value + 12 AS y1", "CASE user_id % 3 WHEN 0 THEN 'header' WHEN 1 THEN 'body' ELSE 'footer' END AS role")
    return orders.misplaced_lines(lines, F.lit(60.0), F.lit(240.0)).select("event_id", "role", "fault")


MISPLACED_LINES = """WITH l AS (SELECT event_id, value AS a, value + 12 AS b, CASE user_id % 3 WHEN 0 THEN 'header' WHEN 1 THEN 'body' ELSE 'footer' END AS role FROM events),
f AS (SELECT event_id, role, CASE WHEN role <> 'body' AND b > 60 AND a < 240 THEN 'reaches into the body' WHEN role = 'body' AND (a < 60 OR b > 240) THEN 'leaves the body' END AS fault FROM l) SELECT * FROM f WHERE fault IS NOT NULL"""


def free_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The room of each event as a line: half way to its neighbours, within the clip."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_id AS ord", "value AS y0", "value + 2 AS y1")
    return orders.free_regions(rows, ["user_id"], F.lit(0.0), F.lit(300.0)).select(F.col("ord").alias("event_id"), F.round("room_top", 6).alias("room_top"), F.round("room_bottom", 6).alias("room_bottom"))


FREE_REGIONS = """WITH e AS (SELECT event_id, value AS a, value + 2 AS b, lag(value + 2) OVER w AS u, lead(value) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id))
SELECT event_id, round(CASE WHEN u IS NULL THEN 0 ELSE greatest(0, least((u + a) / 2, a)) END, 6) AS room_top, round(CASE WHEN d IS NULL THEN 300 ELSE least(300, greatest((b + d) / 2, b)) END, 6) AS room_bottom FROM e"""

_FORM = "l_orderkey // 8 AS page, l_partkey % 12 AS parent, l_suppkey % 12 AS child, l_returnflag || l_linenumber AS name"


def reachable_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definitions that a page's programs reach, each by its shortest and first path."""
    edges = table(spark, sf_dir, "lineitem").selectExpr(*_cols(_FORM))
    return orders.reachable(edges, edges.select("page", F.lit(0).cast("long").alias("node")).distinct(), "page")


REACHABLE_PROGRAMS = f"""WITH RECURSIVE e AS (SELECT DISTINCT {_FORM} FROM lineitem), w(page, node, path, d) AS (SELECT DISTINCT page, CAST(0 AS BIGINT), CAST('' AS VARCHAR), 0 FROM e
UNION SELECT page, child, path, d FROM (SELECT w.page, e.child, min(CASE WHEN w.path = '' THEN e.name ELSE w.path || '/' || e.name END) AS path, w.d + 1 AS d FROM w JOIN e ON e.page = w.page AND e.parent = w.node WHERE w.d < 12 GROUP BY w.page, e.child, w.d)),
s AS (SELECT page, node, min(d) AS d FROM w GROUP BY 1, 2) SELECT w.page, w.node, min(w.path) AS path FROM w JOIN s ON s.page = w.page AND s.node = w.node AND s.d = w.d GROUP BY 1, 2"""


def offset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows drawn beside each other on slightly different baselines, as visual lines."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", f"{_ID} AS ord", "l_linenumber div 3 * 20.0 + l_partkey % 4 * 0.8 AS baseline", "l_linenumber % 3 * 40.0 + l_suppkey % 3 AS x0", "l_linenumber % 3 * 40.0 + 38 + l_suppkey % 5 AS x1", "12.0 AS size", "l_partkey % 2 AS owner")
    return orders.merge_offset_rows(rows, ["page"]).groupBy("page", "visual").agg(F.count("*").alias("n_rows"), F.min("x0").alias("left"))


_F = (application_order, stable_ordinals, edit_origins, compact_audits, page_seams, misplaced_lines, free_regions, reachable_programs, offset_rows)
QUERIES = {f.__name__: f for f in _F}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _F if f.__name__.upper() in globals()}
