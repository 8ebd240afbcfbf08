"""Queries of the predicates: directions, paint, editing, checks, widths, stored records, baselines, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.functions import predicates as P
from leafmark.functions.geometry import rgb
from leafmark.functions.text import width
from leafmark.sources.tables import table, text_lines

#: Events as glyphs: a direction, a paint kind, an opacity, a layer and a mode that depend on the number.
_DX, _DY = "1.0 + (event_id % 9 - 4) * 0.0004", "(event_id % 5 - 2) * 0.0006"
_PAINT = "event_id % 11 % 3 AS kind, 1.0 - event_id % 4 * 0.0006 AS opacity, CASE event_id % 13 WHEN 0 THEN 'notes' WHEN 1 THEN '' END AS layer, CASE event_id % 17 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS wmode"


def direction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By user: glyphs that horizontal layout takes, and those it sets apart, with the last of them."""
    g = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", f"{_DX} AS dx", f"{_DY} AS dy")
    g = g.withColumn("ok", P.horizontal(F.col("dx"), F.col("dy")))
    return g.groupBy("user_id").agg(F.count_if("ok").alias("n_horizontal"), F.count_if(~F.col("ok")).alias("n_unsupported"), F.max(F.when(~F.col("ok"), F.col("event_id"))).alias("last_unsupported"))


DIRECTION_SPLIT = f"""WITH g AS (SELECT user_id, event_id, {_DX} AS dx, {_DY} AS dy FROM events), h AS (SELECT *, dx BETWEEN 0.999 AND 1.001 AND dy BETWEEN -0.001 AND 0.001 AS ok FROM g)
SELECT user_id, count(*) FILTER (ok) AS n_horizontal, count(*) FILTER (NOT ok) AS n_unsupported, max(event_id) FILTER (NOT ok) AS last_unsupported FROM h GROUP BY user_id"""


def visible_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The glyphs that are painted filled, opaque, on no layer and in horizontal mode."""
    g = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", *_PAINT.split(", "))
    return g.where(P.visible(F.col("kind"), F.col("opacity"), F.col("layer"), F.col("wmode"))).select("event_id", "user_id")


VISIBLE_GLYPHS = f"SELECT event_id, user_id FROM (SELECT event_id, user_id, {_PAINT} FROM events) WHERE kind = 0 AND opacity >= 0.999 AND ifnull(layer, '') = '' AND ifnull(wmode, 0) = 0"

_INK = "l_discount AS c, l_tax AS m, l_quantity / 50 AS y, l_linenumber / 7.0 AS k"


def rgb_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as colours of one to five components, as RGB in thousandths."""
    n = F.col("l_linenumber") % 5 + 1
    parts = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_INK.split(", "))
    own = parts.select("l_orderkey", "l_linenumber", rgb(F.slice(F.array("c", "m", "y", "k", F.lit(0.5)), F.lit(1), n)).alias("rgb"))
    at = lambda i: F.round(F.get("rgb", i) * 1000).cast("long")
    return own.select("l_orderkey", "l_linenumber", F.size("rgb").cast("long").alias("n"), at(0).alias("red"), at(1).alias("green"), at(2).alias("blue"))


RGB_COMPONENTS = f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_linenumber % 5 + 1 AS n, {_INK} FROM lineitem),
v AS (SELECT *, CASE n WHEN 1 THEN [c, c, c] WHEN 2 THEN [c, m] WHEN 4 THEN [1 - least(1, c + k), 1 - least(1, m + k), 1 - least(1, y + k)] ELSE [c, m, y] END AS v FROM p)
SELECT l_orderkey, l_linenumber, len(v) AS n, CAST(round(v[1] * 1000) AS BIGINT) AS red, CAST(round(v[2] * 1000) AS BIGINT) AS green, CAST(round(v[3] * 1000) AS BIGINT) AS blue FROM v"""


def unique_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By conversation, the turn that alone holds the words sought, and why there is none."""
    turns = table(spark, sf_dir, "conversations").where(F.contains("text", F.lit("the")))
    times = (F.char_length("text") - F.char_length(F.replace("text", F.lit("the")))) / 3
    found = turns.groupBy("conv_id").agg(F.count("*").alias("n_regions"), F.min("turn").alias("turn"), F.max(times).cast("long").alias("n_times"))
    verdict = F.when(F.col("n_regions") > 1, F.lit("several regions")).when(F.col("n_times") > 1, F.lit("several times in the region")).otherwise(F.lit("unique"))
    return found.select("conv_id", "n_regions", F.when(F.col("n_regions") == 1, F.col("turn")).alias("turn"), verdict.alias("verdict"))


UNIQUE_REGION = """WITH f AS (SELECT conv_id, count(*) AS n, min(turn) AS t, max(len(string_split(text, 'the')) - 1) AS times FROM conversations WHERE contains(text, 'the') GROUP BY conv_id)
SELECT conv_id, n AS n_regions, CASE WHEN n = 1 THEN t END AS turn, CASE WHEN n > 1 THEN 'several regions' WHEN times > 1 THEN 'several times in the region' ELSE 'unique' END AS verdict FROM f"""

_GLYPH = """l_orderkey % 23 = 0 AS rotated, 1.0 + (CASE WHEN l_partkey % 19 = 0 THEN 0.5 ELSE 0 END) AS dx, 0.0 AS dy, l_suppkey % 9 <> 0 AS seen,
CASE WHEN l_partkey % 31 = 0 THEN '�' ELSE l_returnflag END AS text, CASE WHEN l_suppkey % 29 = 0 THEN -1 ELSE l_linenumber END AS glyph_id, l_linestatus AS style, l_orderkey % 7 = 0 AS redacted"""


def editable_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as regions of glyphs: why each can't be edited, null where it can."""
    g = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", *_split(_GLYPH))
    reason = P.uneditable(F.bool_or("rotated"), "dx", "dy", "seen", "text", "glyph_id", F.col("style"), F.bool_or("redacted"))
    return g.groupBy("l_orderkey").agg(reason.alias("reason"))


def _split(columns: str) -> list[str]:
    """Select expressions that are parted by commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


EDITABLE_REGIONS = f"""WITH g AS (SELECT l_orderkey, {_GLYPH} FROM lineitem)
SELECT l_orderkey, CASE WHEN bool_or(rotated) THEN 'rotated page' WHEN max(abs(dx - 1)) > 0.001 THEN 'not horizontal' WHEN NOT bool_and(seen) THEN 'not visible'
WHEN bool_or(text = chr(65533) OR glyph_id = -1) THEN 'unmapped glyph' WHEN count(DISTINCT style) <> 1 THEN 'mixed styles' WHEN bool_or(redacted) THEN 'pending redaction' END AS reason FROM g GROUP BY l_orderkey"""

_SAID = """CASE event_id % 14 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'null' WHEN 3 THEN '{"ok":true,"n":' || user_id || '}' WHEN 4 THEN '{"identical":false}' WHEN 5 THEN '{"n":1,"exact":' || user_id % 2 || '}'
WHEN 6 THEN '{}' WHEN 7 THEN '[]' WHEN 8 THEN '["x"]' WHEN 9 THEN '3' WHEN 10 THEN '"s"' WHEN 11 THEN '{"ok":null,"exact":true}' WHEN 12 THEN '{"identical":[' || user_id || ']}' END"""


def check_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of several shapes, as JSON: true, false, or null where nothing was measured."""
    said = table(spark, sf_dir, "events").selectExpr("event_id", f"{_SAID} AS said")
    return said.select("event_id", P.check_value(F.col("said")).alias("ok"))


CHECK_VALUES = f"""WITH s AS (SELECT event_id, {_SAID} AS j FROM events),
k AS (SELECT event_id, j, json_type(j) AS t, CASE WHEN json_type(j) = 'OBJECT' THEN coalesce(json_extract(j, '$.ok'), json_extract(j, '$.identical'), json_extract(j, '$.exact')) END AS v FROM s)
SELECT event_id, CASE t WHEN 'BOOLEAN' THEN j = 'true' WHEN 'ARRAY' THEN j = '[]' WHEN 'OBJECT' THEN CASE WHEN v IS NULL THEN NULL ELSE CAST(v AS VARCHAR) NOT IN ('false', '0', 'null', '""', '[]', '{{}}') END END AS ok FROM k"""


def widths_by_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The width that each line may use: supplied, else inferred, else unknown."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_partkey % 3 = 0 THEN l_quantity END AS supplied", "CASE WHEN l_suppkey % 2 = 0 THEN l_extendedprice END AS inferred")
    value, where = P.required_width(F.col("supplied"), F.col("inferred"))
    return rows.select("l_orderkey", "l_linenumber", value.alias("width"), where.alias("provenance"))


WIDTHS_BY_PRECEDENCE = """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN l_quantity WHEN l_suppkey % 2 = 0 THEN l_extendedprice END AS width,
CASE WHEN l_partkey % 3 = 0 THEN 'explicit' WHEN l_suppkey % 2 = 0 THEN 'inferred' ELSE 'unknown' END AS provenance FROM lineitem"""


def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without the blanks before their first ink, beginning where the ink does; lines of blanks alone go."""
    lines = text_lines(table(spark, sf_dir, "documents"))
    bare = lines.withColumn("kept", F.ltrim("line")).where(F.btrim("line") != "")
    x = F.lit(40) + width(F.col("line")) - width(F.col("kept"))
    return bare.select("doc_id", "line_no", x.cast("long").alias("x"), F.char_length("kept").cast("long").alias("n_glyphs"))


CLEAN_ROWS = r"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
p AS (SELECT doc_id, line_no, line, length(regexp_extract(line, '^ *')) AS lead FROM l WHERE regexp_matches(line, '[^ ]'))
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(40 + 6 * lead AS BIGINT) AS x, CAST(length(line) - lead AS BIGINT) AS n_glyphs FROM p"""

_LINE = "CASE WHEN l_partkey % 41 = 0 THEN '' ELSE l_returnflag END AS text, l_quantity - 3 AS x, l_quantity + l_linenumber - l_partkey % 5 AS pen_end, CASE WHEN l_suppkey % 37 = 0 THEN NULL ELSE l_extendedprice / 100 END AS baseline"


def valid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records of lines: kept if every line of an order lies on its page, of 48 by 900 points."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", *_split(_LINE))
    ok = P.valid_line(F.col("text"), F.col("x"), F.col("pen_end"), F.col("baseline"), F.lit(48.0), F.lit(900.0))
    return rows.withColumn("ok", ok).groupBy("l_orderkey").agg(F.bool_and("ok").alias("valid"), F.count_if(~F.col("ok")).alias("n_malformed"))


VALID_RECORDS = f"""WITH r AS (SELECT l_orderkey, {_LINE} FROM lineitem),
v AS (SELECT l_orderkey, coalesce(text <> '' AND x BETWEEN -1 AND 49 AND pen_end BETWEEN -1 AND 49 AND baseline BETWEEN 0 AND 900 AND pen_end >= x, false) AS ok FROM r)
SELECT l_orderkey, bool_and(ok) AS valid, count(*) FILTER (NOT ok) AS n_malformed FROM v GROUP BY l_orderkey"""


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn identity of each order's row: its glyphs' text from left to right, where it begins and ends, and its styles."""
    g = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_returnflag AS ch", "l_extendedprice AS x", "l_extendedprice + l_quantity AS x1", "l_linestatus AS style")
    ordered = F.sort_array(F.collect_list(F.struct("x", "l_linenumber", "ch")))
    row = g.groupBy("l_orderkey").agg(ordered.alias("g"), F.round(F.min("x"), 3).alias("x"), F.round(F.max("x1"), 3).alias("end"), F.array_join(F.sort_array(F.collect_set("style")), ",").alias("styles"))
    return row.select("l_orderkey", F.array_join(F.transform("g", lambda e: e["ch"]), "").alias("text"), "x", "end", "styles")


LINE_RECORDS = """SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY l_extendedprice, l_linenumber) AS text, round(min(l_extendedprice), 3) AS x, round(max(l_extendedprice + l_quantity), 3) AS "end",
string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS styles FROM lineitem GROUP BY l_orderkey"""


def followed_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first baseline of each event as a paragraph that follows the user's event before it."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.lag("value").over(w).alias("last"), F.lag("event_id").over(w).alias("before"))
    i = F.col("event_id")
    base = P.follow_baseline(F.lit(100.0), i % 3 == 0, i % 6 == 0, F.col("last"), F.lit(16.0), F.lit(4.0), F.when(i % 2 == 0, 13.5), F.when(i % 10 == 1, 250.0))
    return e.select("event_id", F.round(base, 6).alias("baseline"))


FOLLOWED_BASELINES = """WITH e AS (SELECT event_id AS i, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events),
b AS (SELECT i, CASE WHEN last IS NULL OR (i % 3 = 0 AND i % 6 <> 0) THEN 100 WHEN i % 3 = 0 THEN greatest(100, last + CASE WHEN i % 2 = 0 THEN 17.5 ELSE 16 END) ELSE last + CASE WHEN i % 2 = 0 THEN 17.5 ELSE 16 END END AS b FROM e)
SELECT i AS event_id, round(CAST(CASE WHEN i % 10 = 1 THEN greatest(b, 250) ELSE b END AS DOUBLE), 6) AS baseline FROM b"""

_RANGE = "doc_id, text, length(text) AS n, CAST(floor(length(text) * (doc_id % 5) / 11) AS BIGINT) AS lo, CAST(floor(length(text) * (doc_id % 5 + 3) / 11) AS BIGINT) AS hi, CAST(floor(length(text) * (doc_id % 9) / 12) AS BIGINT) AS s"


def remapped_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decorated range of each text after an edit, shrunk where the edit crosses its edge; gone where nothing visible is left."""
    d = table(spark, sf_dir, "documents").selectExpr(*_split(_RANGE)).withColumn("e", F.least(F.col("n"), F.col("s") + F.col("doc_id") % 4 * 20))
    lo, hi = P.remapped(F.col("lo"), F.col("hi"), F.col("s"), F.col("e"), F.lit(3))
    after = F.concat(F.substring("text", F.lit(1), F.col("s")), F.lit(" + "), F.substring("text", F.col("e") + 1, F.col("n")))
    out = d.select("doc_id", lo.alias("new_lo"), hi.alias("new_hi"), after.alias("after"))
    seen = F.substring("after", F.col("new_lo") + 1, F.col("new_hi") - F.col("new_lo")).rlike(r"\S")
    return out.where(seen).select("doc_id", F.col("new_lo").cast("long").alias("new_lo"), F.col("new_hi").cast("long").alias("new_hi"))


# the places of the range that outlive the edit, and the inserted ones if it lies inside, one by one
REMAPPED_RANGES = f"""WITH d AS (SELECT {_RANGE} FROM documents), q AS (SELECT *, least(n, s + doc_id % 4 * 20) AS e FROM d),
m AS (SELECT *, list_concat(list_filter(range(lo, hi), lambda i: i < s), list_transform(list_filter(range(lo, hi), lambda i: i >= e), lambda i: i + 3 - (e - s)),
      CASE WHEN (s < e AND lo <= s AND e <= hi) OR (s = e AND lo < s AND s < hi) THEN range(s, s + 3) ELSE [] END) AS ms FROM q),
a AS (SELECT doc_id, list_min(ms) AS new_lo, list_max(ms) + 1 AS new_hi, left(text, s) || ' + ' || substr(text, e + 1) AS t FROM m WHERE len(ms) > 0)
SELECT doc_id, CAST(new_lo AS BIGINT) AS new_lo, CAST(new_hi AS BIGINT) AS new_hi FROM a WHERE regexp_matches(substr(t, new_lo + 1, new_hi - new_lo), '\\S')"""


def kept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between neighbouring turns after an edit of each conversation: those that outlive it, moved where they come after."""
    e = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "turn * 3 AS lo", "turn * 3 + 1 AS hi", "conv_id % 7 AS s", "conv_id % 7 + conv_id % 3 AS z")
    kept = e.where(P.kept_edge(F.col("lo"), F.col("hi"), F.col("s"), F.col("z")))
    shift = F.when(F.col("lo") >= F.col("z"), 5 - (F.col("z") - F.col("s"))).otherwise(0)
    return kept.select("conv_id", "turn", (F.col("lo") + shift).alias("lo"), (F.col("hi") + shift).alias("hi"))


KEPT_EDGES = """WITH e AS (SELECT conv_id, turn, turn * 3 AS lo, turn * 3 + 1 AS hi, conv_id % 7 AS s, conv_id % 7 + conv_id % 3 AS z FROM conversations),
k AS (SELECT * FROM e WHERE CASE WHEN s = z THEN hi <> s ELSE hi < s OR lo >= z END)
SELECT conv_id, turn, CASE WHEN lo >= z THEN lo + 5 - (z - s) ELSE lo END AS lo, CASE WHEN lo >= z THEN hi + 5 - (z - s) ELSE hi END AS hi FROM k"""


_F = (
    direction_split, visible_glyphs, rgb_components, unique_region, editable_regions, check_values, widths_by_precedence, clean_rows, valid_records, line_records, followed_baselines, remapped_ranges, kept_edges,
)
QUERIES = {f.__name__: f for f in _F}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _F}
