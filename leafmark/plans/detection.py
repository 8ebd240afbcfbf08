"""Queries from drawn rows to paragraphs, columns and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.operators import detection
from leafmark.plans.layout import _LINES
from leafmark.sources.tables import table, text_lines

#: Lines of orders as glyphs: eight orders are a page, an order is a drawn row.
_GLYPHS = "l_orderkey AS r, l_orderkey // 8 AS page, l_linenumber * 22 + l_quantity AS x0, l_linenumber * 22 + l_quantity + 8 + l_partkey % 3 * 4 AS x1, l_partkey % 97 * 100000000000000 + l_orderkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS paint, l_suppkey % 6 <> 0 AS inked"


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[c.strip().replace("//", "div") for c in _GLYPHS.split(", ")])


def column_gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows cut at column gutters: each piece with its edges and glyphs."""
    pieces = detection.split_gutters(_glyphs(spark, sf_dir), ["page"], ["r"], F.lit(12))
    return pieces.groupBy("r", "piece").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n_glyphs"))


COLUMN_GUTTERS = f"""WITH g AS (SELECT {_GLYPHS} FROM lineitem),
k AS (SELECT *, CASE WHEN inked THEN count(*) FILTER (inked) OVER (PARTITION BY page ORDER BY paint) END AS rk FROM g),
i AS (SELECT r, x0, lag(x1) OVER w AS px1, rk - lag(rk) OVER w AS d FROM k WHERE inked WINDOW w AS (PARTITION BY r ORDER BY x0, paint)),
c AS (SELECT r, (px1 + x0) / 2 AS at FROM i WHERE x0 - px1 > 21.6 OR (x0 - px1 > 10.8 AND d <> 1)),
p AS (SELECT g.r, g.x0, g.x1, (SELECT count(*) FROM c WHERE c.r = g.r AND c.at < g.x0) AS piece FROM g)
SELECT r, piece, min(x0) AS x0, max(x1) AS x1, count(*) AS n_glyphs FROM p GROUP BY r, piece"""


def owner_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows cut between structure elements, where each element's glyphs follow each other."""
    own = F.when(F.col("l_partkey") % 4 > 0, F.floor((F.col("l_linenumber") + F.col("l_orderkey") % 3) / 2) * (F.col("l_orderkey") % 5 + 1) % 4)
    g = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", own.alias("owner"))
    pieces = detection.split_owners(g, ["l_orderkey"], ["l_linenumber", "l_extendedprice"], "owner")
    return pieces.groupBy("l_orderkey", F.col("piece").cast("long").alias("piece")).agg(F.count("*").alias("n_glyphs"), F.max("owner").cast("long").alias("owner"))


OWNER_BLOCKS = """WITH g AS (SELECT l_orderkey AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS i, CASE WHEN l_partkey % 4 > 0 THEN (l_linenumber + l_orderkey % 3) // 2 * (l_orderkey % 5 + 1) % 4 END AS o FROM lineitem),
n AS (SELECT r, i, o, o IS DISTINCT FROM lag(o) OVER (PARTITION BY r ORDER BY i) AS new FROM g WHERE o IS NOT NULL),
q AS (SELECT r, count(*) FILTER (new) AS runs, count(DISTINCT o) AS owners FROM n GROUP BY r),
p AS (SELECT g.r, g.i, g.o, CASE WHEN q.runs >= 2 AND q.runs = q.owners THEN greatest((SELECT count(*) FROM n WHERE n.r = g.r AND n.i <= g.i AND n.new) - CASE WHEN (SELECT arg_min(h.o IS NULL, h.i) FROM g h WHERE h.r = g.r) THEN 0 ELSE 1 END, 0) ELSE 0 END AS piece FROM g LEFT JOIN q ON g.r = q.r)
SELECT r AS l_orderkey, CAST(piece AS BIGINT) AS piece, count(*) AS n_glyphs, CAST(max(o) AS BIGINT) AS owner FROM p GROUP BY r, piece"""


def paragraph_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs by all three rules: gaps (empty lines leave them), indents and short lines that end a sentence."""
    lines = text_lines(table(spark, sf_dir, "documents")).where(F.btrim("line") != "")
    lead = F.char_length("line") - F.char_length(F.ltrim("line"))
    x0 = (F.lit(40.0) + (lead + F.when(F.col("line_no") % 11 == 5, 2).otherwise(0)) * 6)
    placed = lines.select("doc_id", "line_no", F.col("line").alias("text"), (F.col("line_no") * 17.0).alias("baseline"), x0.alias("x0"), (x0 + F.col("line_width") - lead * 6).alias("x1"))
    found = detection.paragraphs(placed, ["doc_id"], F.lit(12.0))
    return found.groupBy("doc_id", "paragraph").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.round(F.first("leading"), 3).alias("leading_pt"))


PARAGRAPH_RULES = rf"""WITH {_LINES},
l AS (SELECT doc_id, line_no, line, line_no * 17.0 AS y, length(regexp_extract(line, '^ *')) AS lead, line_width FROM measured WHERE regexp_matches(line, '[^ ]')),
p AS (SELECT *, 40 + 6 * (lead + CASE WHEN line_no % 11 = 5 THEN 2 ELSE 0 END) AS x0, line_width - 6 * lead AS wd FROM l),
g AS (SELECT *, y - lag(y) OVER o AS gap, lag(x0) OVER o AS px0, lag(wd) OVER o AS pwd, lag(line) OVER o AS pline, min(x0) OVER (PARTITION BY doc_id) AS lft, max(wd) OVER (PARTITION BY doc_id) AS widest FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY y)),
r AS (SELECT doc_id, gap, row_number() OVER (PARTITION BY doc_id ORDER BY gap) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM g WHERE gap IS NOT NULL),
m AS (SELECT doc_id, median(gap) AS lead_pt FROM r WHERE k <= greatest(1, (n + 1) // 2) GROUP BY doc_id),
b AS (SELECT g.doc_id, g.line_no, g.y, coalesce(m.lead_pt, 16.8) AS lp, coalesce(gap > 1.3 * coalesce(m.lead_pt, 16.8) OR (x0 - lft >= 9 AND px0 - lft < 6) OR (pwd < 0.72 * widest AND regexp_matches(rtrim(pline), '[.!?。！？]$')), false) AS brk FROM g LEFT JOIN m ON g.doc_id = m.doc_id),
s AS (SELECT *, sum(CAST(brk AS INT)) OVER (PARTITION BY doc_id ORDER BY y ROWS UNBOUNDED PRECEDING) AS paragraph FROM b)
SELECT doc_id, CAST(paragraph AS BIGINT) AS paragraph, CAST(min(line_no) AS INT) AS first_line, count(*) AS n_lines, round(CAST(any_value(lp) AS DOUBLE), 3) AS leading_pt FROM s GROUP BY doc_id, paragraph"""


def list_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that open with a label or a marker; some are given one."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\. |\n")).alias("pos", "part"))
    given = F.get(F.array(*[F.lit(x) for x in ("", "1. ", "(a) ", "12 ", "• ", "※", "IV) ", "注1 ", "③", "2.", "１０、", "■ ")]), F.pmod(F.col("pos") + F.col("doc_id"), F.lit(12)).cast("int"))
    rows = parts.select("doc_id", "pos", F.concat(given, "part").alias("row"))
    return rows.select("doc_id", "pos", detection.label(F.col("row")).alias("label"), detection.marker(F.col("row")).alias("marker")).where("label is not null or marker is not null")


_CORE = r"(?:[(（\[［]?(?:[0-9０-９]{1,3}|[一二三四五六七八九十]{1,3}|[ivxIVX]{1,4}|[a-zA-Zａ-ｚＡ-Ｚ])|注[0-9０-９]{0,2})"
LIST_LABELS = rf"""WITH p AS (SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS part FROM (SELECT doc_id, regexp_split_to_array(text, '\. |\n') AS ps FROM documents)),
r AS (SELECT doc_id, pos, ['', '1. ', '(a) ', '12 ', '• ', '※', 'IV) ', '注1 ', '③', '2.', '１０、', '■ '][(pos + doc_id) % 12 + 1] || part AS t FROM p),
f AS (SELECT *, rtrim(regexp_extract(t, '^ *([①-⑳]|[*＊※†‡§]|{_CORE}[)）\]］.．、:：]|{_CORE} ) *[^ ]', 1), ' ') AS lb, left(ltrim(t, ' '), 1) AS m FROM r),
o AS (SELECT *, substr(ltrim(t, ' '), length(lb) + 1) AS rest FROM f),
v AS (SELECT doc_id, pos, CASE WHEN lb <> '' AND NOT regexp_matches(ltrim(rest, ' '), '[^ ](?:  +|　)[^ ]') THEN lb END AS label, CASE WHEN regexp_matches(m, '^\p{{So}}$') OR (m <> '' AND contains('•・‣⁃◦※', m)) THEN m END AS marker FROM o)
SELECT doc_id, CAST(pos AS INT) AS pos, label, marker FROM v WHERE label IS NOT NULL OR marker IS NOT NULL"""

_TEXTS = "l_orderkey // 8 AS page, l_orderkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS id, l_quantity * 8 AS x0, l_linenumber * 40.0 AS y0, l_quantity * 8 + 30 + l_partkey % 60 AS x1, l_linenumber * 40.0 + 12 AS y1, 12 AS size"
_RULES = "o_orderkey // 8 AS page, o_custkey % 60 * 9 AS x, o_orderkey % 3 * 30 AS top, o_orderkey % 3 * 30 + o_custkey % 7 * 60 AS bottom"


def cell_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right edges that drawn rules give the texts of a page."""
    expr = lambda x: [c.strip().replace("//", "div") for c in x.split(", ")]
    texts = table(spark, sf_dir, "lineitem").selectExpr(*expr(_TEXTS))
    rules = table(spark, sf_dir, "orders").selectExpr(*expr(_RULES))
    glyphs = texts.select("page", F.col("id").alias("owner"), F.col("x0").alias("gx0"), F.col("y0").alias("gy0"), F.col("x1").alias("gx1"), F.col("y1").alias("gy1"))
    return detection.cell_edges(texts, rules, glyphs, "page")


CELL_EDGES = f"""WITH t AS (SELECT {_TEXTS} FROM lineitem), r AS (SELECT {_RULES} FROM orders),
n AS (SELECT t.*, (SELECT max(x) FROM r WHERE r.page = t.page AND top <= y0 + 1 AND bottom >= y1 - 1 AND x BETWEEN x0 - 36 AND x0) AS lf, (SELECT min(x) FROM r WHERE r.page = t.page AND top <= y0 + 1 AND bottom >= y1 - 1 AND x >= x1) AS rt FROM t),
e AS (SELECT *, rt - greatest(0.5, x0 - lf) AS edge FROM n)
SELECT id, CASE WHEN lf IS NOT NULL AND edge > x1 + 0.05 AND NOT EXISTS (SELECT 1 FROM t g WHERE g.page = e.page AND g.id <> e.id AND g.x0 < e.edge AND g.x1 > e.x1 AND g.y0 < e.y1 AND g.y1 > e.y0) THEN edge END AS edge FROM e"""


def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as pages of paragraphs in columns: paragraphs of each column."""
    lines = text_lines(table(spark, sf_dir, "documents"))
    x0 = F.lit(40.0) + F.col("line_no") % 3 * 150 + F.col("line_no") % 5 * 4
    rows = lines.select("doc_id", F.col("line_no").alias("ord"), x0.alias("x0"), (x0 + 100 + F.col("line_width") % 40).alias("x1"), (F.floor(F.col("line_no") / 3) * 20.0).alias("y"), F.lit(12.0).alias("size"))
    rows = rows.withColumns({f"last_{c}": F.col(c) for c in ("x0", "x1", "y", "size")})
    found = detection.columns(rows, ["doc_id"])
    return found.groupBy("doc_id", "column").agg(F.count("*").alias("n_paragraphs"), F.min("x0").alias("left"))


def column_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of one size stacked in blocks."""
    lines = text_lines(table(spark, sf_dir, "documents"))
    x = F.lit(40.0) + F.col("line_no") % 2 * 260
    y = F.floor(F.col("line_no") / 2) * 30.0
    rows = lines.select("doc_id", F.col("line_no").alias("ord"), x.alias("x"), (x + 60 + F.col("line_width") % 150).alias("pen_end"), y.alias("first"), (y + 12).alias("last"), F.when(F.col("line_no") % 17 == 0, 18.0).otherwise(12.0).alias("size"))
    return detection.blocks(rows, ["doc_id"]).groupBy("doc_id", "block").agg(F.count("*").alias("n_paragraphs"), F.min("first").alias("top"))


_ROWS = "o_custkey AS block, o_orderkey AS grp, l_linenumber * 2 + l_partkey % 5 AS x, l_quantity + 60 AS rt, l_orderkey * 2000 + l_extendedprice / 100 AS baseline, l_orderkey * 2000 + l_extendedprice / 100 + 3 AS bottom, 10 + o_orderkey % 3 AS size"


def block_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as column blocks of orders as paragraphs: edges, pitch and gaps."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.selectExpr(*[c.strip() for c in _ROWS.replace("rt,", "right,").split(", ")])
    return detection.describe_blocks(rows, ["block"], "grp").withColumnRenamed("left", "left_edge").withColumnRenamed("right", "right_edge")


BLOCK_DESCRIPTIONS = f"""WITH r AS (SELECT {_ROWS} FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT *, baseline - lag(baseline) OVER (PARTITION BY block, grp ORDER BY baseline) AS inn, row_number() OVER (PARTITION BY block, grp ORDER BY baseline) AS k, row_number() OVER (PARTITION BY block ORDER BY grp, baseline) AS i FROM r),
o AS (SELECT block, first_line - lag(last_line) OVER (PARTITION BY block ORDER BY grp) AS gap FROM (SELECT block, grp, min(baseline) AS first_line, max(baseline) AS last_line FROM r GROUP BY block, grp)),
m AS (SELECT *, min(inn) OVER (PARTITION BY block) AS least FROM g)
SELECT m.block, coalesce(min(x) FILTER (k > 1), min(x)) AS left_edge, max(rt) AS right_edge, arg_min(baseline, i) AS top, max(baseline) AS bottom, max(m.bottom) AS ink_bottom, arg_min(size, i) AS size,
CAST(median(inn) FILTER (inn <= least * 1.15) AS DOUBLE) AS pitch, any_value((SELECT CAST(median(gap) AS DOUBLE) FROM o WHERE o.block = m.block)) AS gap, count(*) AS n_rows FROM m GROUP BY m.block"""


def column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right edge of each page's column, from the ends of its lines: orders as lines."""
    g = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey div 8 AS page", "l_orderkey AS baseline", "l_quantity * 8 + l_linenumber AS x1", "CASE WHEN l_partkey % 9 = 0 THEN '.' ELSE l_returnflag END AS ch", "l_suppkey % 5 <> 0 AS inked")
    return detection.line_ends(g.where("inked"), ["page"], F.lit(300.0), F.lit(395.0))


COLUMN_EDGES = """WITH g AS (SELECT l_orderkey // 8 AS page, l_orderkey AS baseline, l_quantity * 8 + l_linenumber AS x1, CASE WHEN l_partkey % 9 = 0 THEN '.' ELSE l_returnflag END AS ch FROM lineitem WHERE l_suppkey % 5 <> 0),
e AS (SELECT page, x1, ch FROM (SELECT *, row_number() OVER (PARTITION BY page, baseline ORDER BY x1 DESC, ch DESC) AS k FROM g) WHERE k = 1),
s AS (SELECT page, count(*) FILTER (x1 >= 300 AND x1 < 395 AND ch <> '.') AS n, max(x1) FILTER (x1 >= 300 AND x1 < 395 AND ch <> '.') AS m, count(*) FILTER (x1 >= 395) AS i FROM e GROUP BY page)
SELECT page, n AS n_supports, i AS n_ignored, CASE WHEN n >= 2 THEN m ELSE 300.0 END AS column_right FROM s"""

_SPACED = "user_id AS line, event_id AS ord, CAST(6 AS DOUBLE) AS nominal, CAST(user_id % 3 AS DOUBLE) / 4 AS tc, CASE WHEN event_id % 4 = 0 AND user_id % 5 = 1 THEN CAST(1.5 AS DOUBLE) ELSE 0 END AS tw, CAST(0 AS DOUBLE) AS tj, event_id % 4 = 0 AS blank"


def line_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as lines of glyphs whose spacing is even, by words, by repositioning, or irregular."""
    g = table(spark, sf_dir, "events").selectExpr(*[c.strip() for c in _SPACED.split(", ")])
    w = Window.partitionBy("line").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.when(F.col("line") % 7 == 2, 0.5).when((F.col("line") % 7 == 3) & (F.col("ord") % 3 == 0), 0.25).otherwise(0.0)
    g = g.withColumn("_step", F.col("nominal") + F.col("tc") + F.col("tw") + moved)
    g = g.withColumn("x", F.coalesce(F.sum("_step").over(w), F.lit(0.0)))
    return detection.spacing(g, ["line"], F.lit(0.0)).select("line", "distribution", F.round("excess", 3).alias("excess"), F.round("natural_width", 3).alias("natural_width"), F.round("measured_width", 3).alias("measured_width"), "tc", "n_glyphs")


LINE_SPACING = f"""WITH g AS (SELECT {_SPACED} FROM events), h AS (SELECT *, CASE WHEN line % 7 = 2 THEN 0.5 WHEN line % 7 = 3 AND ord % 3 = 0 THEN 0.25 ELSE 0.0 END AS mv, lead(ord) OVER (PARTITION BY line ORDER BY ord) IS NOT NULL AS gap FROM g),
e AS (SELECT *, CAST(tc + tw + mv AS DOUBLE) AS ex FROM h),
a AS (SELECT line, coalesce(max(abs(ex)) FILTER (gap) <= 0.02, true) AS flat, coalesce(bool_or(mv > 0.02) FILTER (gap), false) AS moves, coalesce(max(abs(ex)) FILTER (gap AND mv <= 0.02) <= 0.02, true) AS rest_flat, coalesce(max(ex) FILTER (gap AND mv > 0.02) - min(ex) FILTER (gap AND mv > 0.02) <= 0.02 AND min(ex) FILTER (gap AND mv > 0.02) > 0.02, false) AS moved_even,
  coalesce(max(ex) FILTER (gap) - min(ex) FILTER (gap) <= 0.02 AND min(ex) FILTER (gap) > 0.02, false) AS even, coalesce(max(abs(ex)) FILTER (gap AND NOT blank) <= 0.02, true) AS words_only, coalesce(max(ex) FILTER (gap AND blank) - min(ex) FILTER (gap AND blank) <= 0.02 AND min(ex) FILTER (gap AND blank) > 0.02, false) AS word_even,
  coalesce(sum(ex) FILTER (gap), 0) AS total, sum(nominal) AS nat, sum(nominal) + coalesce(sum(ex) FILTER (gap), 0) AS meas, any_value(tc) AS tc, count(*) AS n FROM e GROUP BY line)
SELECT line, CASE WHEN flat THEN 'none' WHEN moves THEN CASE WHEN rest_flat AND moved_even THEN 'uniform_reposition' ELSE 'irregular' END WHEN even THEN 'uniform_char' WHEN words_only AND word_even THEN 'uniform_word' ELSE 'irregular' END AS distribution,
round(total, 3) AS excess, round(CAST(nat AS DOUBLE), 3) AS natural_width, round(CAST(meas AS DOUBLE), 3) AS measured_width, CAST(CAST(tc AS DOUBLE) AS VARCHAR) AS tc, n AS n_glyphs FROM a"""

_F = (column_gutters, owner_blocks, paragraph_rules, list_labels, cell_edges, page_columns, column_blocks, block_descriptions, column_edges, line_spacing)
QUERIES = {f.__name__: f for f in _F}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _F if f.__name__.upper() in globals()}
