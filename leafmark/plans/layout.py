"""Page layout queries: characters, lines, paragraphs, leading, lists, wrapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.functions.text import separator, width
from leafmark.operators import aggregates, glyphs, islands, sequential
from leafmark.sources import tables
from leafmark.sources.tables import table, text_lines

_LINES = """lines AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
measured AS (SELECT *, 12 * length(line) - 6 * length(regexp_replace(line, '[^\\x00-\\x7F]', '', 'g')) AS line_width FROM lines)"""

_GLYPHS = """chars AS (SELECT doc_id, line_no, unnest(range(length(line))) AS ord, unnest(string_split(line, '')) AS ch FROM lines WHERE line <> ''),
adv AS (SELECT *, CASE WHEN regexp_matches(ch, '[\\x00-\\x7F]') THEN 6 ELSE 12 END AS advance FROM chars),
glyphs AS (SELECT *, sum(advance) OVER (PARTITION BY doc_id, line_no ORDER BY ord ROWS UNBOUNDED PRECEDING) + 40 AS x1 FROM adv)"""


def paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs by the short-terminal-line rule: lines and widest line of each."""
    lines = text_lines(table(spark, sf_dir, "documents"))
    w = Window.partitionBy("doc_id")
    before = w.orderBy("line_no")
    marked = lines.withColumn("widest", F.max("line_width").over(w))
    short = (F.lag("line_width").over(before) < 0.72 * F.col("widest")) & F.rtrim(F.lag("line").over(before)).rlike(r"[.!?。！？]$")
    parts = islands.islands(marked.withColumn("short", short), ["doc_id"], ["line_no"], F.col("short"), "paragraph")
    return parts.groupBy("doc_id", "paragraph").agg(F.count("*").alias("n_lines"), F.max("line_width").cast("long").alias("widest_line"), F.min("line_no").alias("first_line"))


PARAGRAPH_BREAKS = rf"""WITH {_LINES},
w AS (SELECT *, max(line_width) OVER (PARTITION BY doc_id) AS widest FROM measured),
b AS (SELECT *, coalesce(lag(line_width) OVER o < 0.72 * widest AND regexp_matches(rtrim(lag(line) OVER o), '[.!?。！？]$'), false) AS brk FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
p AS (SELECT *, sum(CAST(brk AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS paragraph FROM b)
SELECT doc_id, CAST(paragraph AS BIGINT) AS paragraph, count(*) AS n_lines, CAST(max(line_width) AS BIGINT) AS widest_line, CAST(min(line_no) AS INT) AS first_line FROM p GROUP BY doc_id, paragraph"""


def glyph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed characters of each text: all, visible, wide."""
    docs = table(spark, sf_dir, "documents")
    code = F.col("code")
    seen = tables.glyphs(docs).groupBy("doc_id").agg(F.count("*").alias("a"), F.count_if(~code.isin(9, 11, 12, 13, 32)).alias("v"), F.count_if(code > 127).alias("w"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return docs.select("doc_id").join(seen, "doc_id", "left").select("doc_id", count("a").alias("n_glyphs"), count("v").alias("n_visible"), count("w").alias("n_wide"))


GLYPH_SCAN = r"""WITH g AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), ''), '')) AS ch FROM documents)
SELECT d.doc_id, count(ch) FILTER (ch <> '') AS n_glyphs, count(ch) FILTER (ch <> '' AND NOT regexp_matches(ch, '[ \t\x0b\x0c\r]')) AS n_visible,
       count(ch) FILTER (ch <> '' AND NOT regexp_matches(ch, '[\x00-\x7F]')) AS n_wide FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id"""


def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around the characters of each line."""
    found = glyphs.span_bounds(tables.line_spans(table(spark, sf_dir, "documents")), ["doc_id", "line_no"])
    return found.select("doc_id", "line_no", F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1"), "n_glyphs")


BOUNDING_BOXES = rf"""WITH {_LINES}, {_GLYPHS}
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(min(x1 - advance) AS BIGINT) AS x0, CAST(max(x1) AS BIGINT) AS x1, count(*) AS n_glyphs FROM glyphs GROUP BY doc_id, line_no"""


def inferred_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the blanks of a line taken as gaps: gaps wide enough between characters of words become spaces."""
    found = glyphs.word_gaps(tables.line_spans(table(spark, sf_dir, "documents"), blanks=False), ["doc_id", "line_no"], ",;:!?.)]}")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_spaces"), F.sum("gap").cast("long").alias("total_gap"), F.max("gap").cast("long").alias("widest_gap"))


INFERRED_SPACES = rf"""WITH {_LINES}, {_GLYPHS},
s AS (SELECT doc_id, x1 - advance - lag(x1) OVER o AS gap, regexp_matches(ch, '^[\p{{L}}\p{{N}}]$') AND regexp_matches(lag(ch) OVER o, '^[\p{{L}}\p{{N}},;:!?.)\]}}]$') AS joins
      FROM glyphs WHERE ch <> ' ' WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY ord))
SELECT doc_id, count(*) AS n_spaces, CAST(sum(gap) AS BIGINT) AS total_gap, CAST(max(gap) AS BIGINT) AS widest_gap FROM s WHERE gap > 2.4 AND joins GROUP BY doc_id"""


def gutter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut where a gap is wider than 2.2 sizes, words at bars taken as columns: pieces of each line."""
    lines = text_lines(table(spark, sf_dir, "documents")).where(F.contains("line", F.lit("|")))
    cells = lines.select("doc_id", "line_no", F.posexplode(F.split("line", r"\|")).alias("cell", "cell_text"))
    w = Window.partitionBy("doc_id", "line_no").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(width(F.col("cell_text")) + F.when(F.col("cell") % 2 == 0, 40).otherwise(6)).over(w), F.lit(0))
    placed = cells.withColumn("x0", F.lit(40) + before).withColumn("x1", F.col("x0") + width(F.col("cell_text")))
    pieces = islands.gutter_pieces(placed, ["doc_id", "line_no"], ["cell"], F.lit(12))
    return pieces.groupBy("doc_id", "line_no").agg((F.max("piece") + 1).cast("long").alias("n_pieces"), F.count("*").alias("n_cells"), F.max("x1").cast("long").alias("right_edge"))


GUTTER_SPLIT = rf"""WITH {_LINES},
c AS (SELECT doc_id, line_no, unnest(range(len(cs))) AS cell, unnest(cs) AS t FROM (SELECT doc_id, line_no, string_split(line, '|') AS cs FROM lines WHERE contains(line, '|'))),
m AS (SELECT *, 12 * length(t) - 6 * length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) AS wd FROM c),
p AS (SELECT *, 40 + coalesce(sum(wd + CASE WHEN cell % 2 = 0 THEN 40 ELSE 6 END) OVER (PARTITION BY doc_id, line_no ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0 FROM m),
g AS (SELECT *, CAST(coalesce(x0 - max(x0 + wd) OVER (PARTITION BY doc_id, line_no ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 26.4, false) AS INT) AS cut FROM p)
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(sum(cut) + 1 AS BIGINT) AS n_pieces, count(*) AS n_cells, CAST(max(x0 + wd) AS BIGINT) AS right_edge FROM g GROUP BY doc_id, line_no"""


def line_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By user: the median of the lower half of the values, the pitch near the least, and which of them is used."""
    events = table(spark, sf_dir, "events").where("value > 0")
    low, near = aggregates.lower_half_median(events, ["user_id"], "value"), aggregates.pitch(events, ["user_id"], "value")
    joined = low.join(near, "user_id")
    return joined.select("user_id", "leading", "pitch", F.when(F.col("pitch") * 4 > F.col("leading"), F.lit("own")).otherwise(F.lit("column")).alias("evidence"))


LINE_LEADING = """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS rn, count(*) OVER (PARTITION BY user_id) AS n, min(value) OVER (PARTITION BY user_id) AS least FROM events WHERE value > 0),
a AS (SELECT user_id, median(value) FILTER (rn <= greatest(1, (n + 1) // 2)) AS "leading", median(value) FILTER (value <= least * 1.15) AS pitch FROM r GROUP BY user_id)
SELECT user_id, "leading", pitch, CASE WHEN pitch * 4 > "leading" THEN 'own' ELSE 'column' END AS evidence FROM a"""


def numbered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lists: sentences of a text stand for lines, numbers of one and two digits lead some of them."""
    docs = table(spark, sf_dir, "documents")
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"\. |\n")).alias("at", "part"))
    numbered = parts.withColumn("line", F.concat(F.pmod(F.col("at") + F.char_length("part"), F.lit(3)).cast("string"), F.lit(". "), "part"))
    return islands.numbered_lists(numbered, ["doc_id"], ["at"]).groupBy("doc_id").agg(F.count("*").alias("n_lists"), F.max("n_items").alias("longest"), F.min("first_number").alias("least_first"))


NUMBERED_LIST = r"""WITH p AS (SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS part FROM (SELECT doc_id, regexp_split_to_array(text, '\. |\n') AS ps FROM documents)),
n AS (SELECT doc_id, pos, (pos + length(part)) % 3 AS num FROM p),
f AS (SELECT doc_id, pos, num, CAST(coalesce(num <> lag(num) OVER o + 1, true) AS INT) AS st FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM f),
g AS (SELECT doc_id, run, min(num) AS first_number, count(*) AS n_items FROM r GROUP BY doc_id, run HAVING count(*) >= 2)
SELECT doc_id, count(*) AS n_lists, max(n_items) AS longest, CAST(min(first_number) AS INT) AS least_first FROM g GROUP BY doc_id"""


def wrap_explained_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends of each text: explained by wrapping, if the next line's first word would not have fitted, else hard."""
    lines = text_lines(table(spark, sf_dir, "documents"))
    w = Window.partitionBy("doc_id")
    nxt = F.lead("line").over(w.orderBy("line_no"))
    first_word = width(F.regexp_extract(nxt, r"^[^ ]*", 0))
    ends = lines.withColumn("widest", F.max("line_width").over(w)).withColumn("need", F.when(nxt.isNotNull(), F.col("line_width") + 6 + first_word)).where("need is not null")
    return ends.groupBy("doc_id").agg(F.count("*").alias("n_breaks"), F.count_if(F.col("need") > F.col("widest")).alias("n_explained"), F.count_if(F.col("need") <= F.col("widest")).alias("n_hard"))


WRAP_EXPLAINED_BREAKS = rf"""WITH {_LINES},
n AS (SELECT doc_id, line_width, max(line_width) OVER (PARTITION BY doc_id) AS widest, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM measured),
f AS (SELECT *, regexp_extract(nxt, '^[^ ]*', 0) AS fw FROM n WHERE nxt IS NOT NULL),
e AS (SELECT doc_id, widest, line_width + 6 + 12 * length(fw) - 6 * length(regexp_replace(fw, '[^\x00-\x7F]', '', 'g')) AS need FROM f)
SELECT doc_id, count(*) AS n_breaks, count(*) FILTER (need > widest) AS n_explained, count(*) FILTER (need <= widest) AS n_hard FROM e GROUP BY doc_id"""


def joined_paragraph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation joined as lines of a paragraph, with a space only where words meet."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.btrim(F.regexp_replace("text", r"\s+", " ")).alias("t")).where("t is not null")
    w = Window.partitionBy("conv_id").orderBy("turn", "t")
    pieces = turns.withColumn("sep", F.coalesce(separator(F.lag("t").over(w), F.col("t")), F.lit(""))).withColumn("n", F.row_number().over(w))
    joined = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "sep", "t"))).alias("ps"))
    text = F.array_join(F.transform("ps", lambda p: F.concat(p["sep"], p["t"])), "")
    return joined.select("conv_id", F.char_length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


JOINED_PARAGRAPH_TEXT = r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE text IS NOT NULL),
p AS (SELECT conv_id, turn, t, lag(t) OVER (PARTITION BY conv_id ORDER BY turn, t) AS prev, row_number() OVER (PARTITION BY conv_id ORDER BY turn, t) AS n FROM t),
s AS (SELECT conv_id, n, CASE WHEN prev IS NULL OR prev = '' OR t = '' THEN '' WHEN regexp_matches(left(t, 1), '^[\p{Latin}\p{N}]$') AND (regexp_matches(right(prev, 1), '^[\p{Latin}\p{N}]$') OR contains(',;:!?.)]}"''”’', right(prev, 1))) THEN ' ' ELSE '' END || t AS piece FROM p),
j AS (SELECT conv_id, string_agg(piece, '' ORDER BY n) AS text FROM s GROUP BY conv_id)
SELECT conv_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM j"""


def layout_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text wrapped to 360 points: lines, widest line and characters of each, and paragraphs that can't be wrapped."""
    lines = sequential.wrap(table(spark, sf_dir, "documents"), "doc_id", "text", 360)
    laid = F.col("refusal").isNull()
    return lines.groupBy("key").agg(F.count_if(laid).alias("n_lines"), F.max("width").alias("widest"), F.sum(F.when(laid, F.col("n_chars"))).alias("n_chars"), F.count_if(~laid).alias("n_refused")).withColumnRenamed("key", "doc_id")


def cluster_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a text as glyphs with jittered baselines, clustered into lines: lines and glyphs of each text."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("ord", "word"))
    placed = words.select("doc_id", "ord", (F.col("ord") % 10 * 30).cast("double").alias("x0"), (60 + F.floor(F.col("ord") / 10) * 16.8 + F.col("ord") % 3 * 0.4).cast("double").alias("y"), F.lit(12.0).alias("size"))
    found = sequential.cluster_baselines(placed, ["doc_id"])
    return found.groupBy("doc_id").agg((F.max("line") + 1).alias("n_lines"), F.count("*").alias("n_glyphs"))


def greedy_line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a text in boxes, its paragraphs set apart by indents and gaps: boxes and lines of each text."""
    lines = text_lines(table(spark, sf_dir, "documents"))
    indent = F.col("line_no") % 5 * 20.0
    rows = lines.select("doc_id", F.col("line_no").alias("ord"), (F.lit(40.0) + indent).alias("x0"), (F.lit(41.0) + indent + F.col("line_width")).alias("x1"), (F.lit(60.0) + F.col("line_no") * 16.8 + F.floor(F.col("line_no") / 7) * 30).alias("y"), F.lit(12.0).alias("size"))
    found = sequential.group_lines(rows, ["doc_id"])
    return found.groupBy("doc_id").agg((F.max("box") + 1).alias("n_boxes"), F.count("*").alias("n_lines"))


def shared_flow_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is a flow: its paragraphs, as many lines as their width needs, in regions of 40 lines."""
    lines = text_lines(table(spark, sf_dir, "documents"))
    rows = lines.select("doc_id", "line_no", F.greatest(F.lit(1), F.ceil(F.col("line_width") / 360)).alias("n_lines"), (F.col("line_no") % 4 == 0).alias("keep"))
    found = sequential.allocate(rows, "doc_id", "line_no", "n_lines", 40, "keep")
    return found.groupBy("flow").agg((F.max("region") + 1).alias("n_regions"), F.sum("n_lines").alias("n_lines"), F.count("*").alias("n_fragments")).withColumnRenamed("flow", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (paragraph_breaks, glyph_scan, bounding_boxes, inferred_spaces, gutter_split, line_leading, numbered_list, wrap_explained_breaks, joined_paragraph_text, layout_wrap, cluster_baselines, greedy_line_groups, shared_flow_allocate)
}
ORACLES = {
    "paragraph_breaks": PARAGRAPH_BREAKS, "glyph_scan": GLYPH_SCAN, "bounding_boxes": BOUNDING_BOXES, "inferred_spaces": INFERRED_SPACES, "gutter_split": GUTTER_SPLIT, "line_leading": LINE_LEADING,
    "numbered_list": NUMBERED_LIST, "wrap_explained_breaks": WRAP_EXPLAINED_BREAKS, "joined_paragraph_text": JOINED_PARAGRAPH_TEXT,
}
