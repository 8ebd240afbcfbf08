"""Queries over nested markup: depths, matching closings, nesting faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.operators import islands, spans
from leafmark.sources.tables import table, tags

_VOID = "('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr')"
_TAGS = rf"""tk AS (SELECT page_id, unnest(range(len(ts))) AS ord, unnest(ts) AS tag FROM (SELECT page_id, regexp_extract_all(html, '<(/?[A-Za-z][A-Za-z0-9]*)', 1) AS ts FROM pages)),
tags AS (SELECT page_id, ord, lower(replace(tag, '/', '')) AS name, CASE WHEN tag LIKE '/%' THEN 'close' WHEN lower(tag) IN {_VOID} THEN 'void' ELSE 'open' END AS kind FROM tk)"""


def nesting_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of a page's tags, whether it ever falls below 0, and the names whose opens and closes differ."""
    t = tags(table(spark, sf_dir, "pages"))
    deep = spans.tag_depths(t, ["page_id"], "ord", F.col("kind") == "open", F.col("kind") == "close")
    depth = deep.groupBy("page_id").agg(F.count("*").alias("n_tags"), F.max("depth").alias("deepest"), F.min("depth").alias("lowest"), F.max_by("depth", "ord").alias("final_depth"))
    names = t.groupBy("page_id", "name").agg(F.sum(F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)).alias("d"))
    return depth.join(names.groupBy("page_id").agg(F.count_if(F.col("d") != 0).alias("n_unbalanced")), "page_id")


NESTING_AUDIT = f"""WITH {_TAGS}, d AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS depth FROM tags),
n AS (SELECT page_id, count(*) FILTER (x <> 0) AS n_unbalanced FROM (SELECT page_id, name, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) AS x FROM tags GROUP BY 1, 2) GROUP BY 1)
SELECT d.page_id, count(*) AS n_tags, CAST(max(depth) AS BIGINT) AS deepest, CAST(min(depth) AS BIGINT) AS lowest, CAST(arg_max(depth, ord) AS BIGINT) AS final_depth, any_value(n_unbalanced) AS n_unbalanced FROM d JOIN n ON d.page_id = n.page_id GROUP BY d.page_id"""


def graphics_scope_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph openings and the closing of each: the next closing of the name at a smaller depth."""
    t = tags(table(spark, sf_dir, "pages")).where("name in ('li', 'ul', 'p', 'div') and kind <> 'void'")
    deep = spans.tag_depths(t, ["page_id", "name"], "ord", F.col("kind") == "open", F.col("kind") == "close")
    # an opening at depth d is closed by the next row that leaves depth d - 1: rows of one level in order
    level = F.when(F.col("kind") == "open", F.col("depth")).otherwise(F.col("depth") + 1)
    w = Window.partitionBy("page_id", "name", "level").orderBy("ord")
    matched = deep.withColumn("level", level).withColumn("end", F.when(F.lead("kind").over(w) == "close", F.lead("ord").over(w))).where("kind = 'open'")
    return matched.groupBy("page_id", "name").agg(F.count("*").alias("n_open"), F.count("end").alias("n_closed"), F.max(F.col("end") - F.col("ord")).cast("long").alias("longest"), F.max("depth").alias("deepest"))


GRAPHICS_SCOPE_MATCH = f"""WITH {_TAGS}, d AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, name ORDER BY ord ROWS UNBOUNDED PRECEDING) AS depth FROM tags WHERE name IN ('li','ul','p','div') AND kind <> 'void'),
m AS (SELECT o.page_id, o.name, o.ord, o.depth, (SELECT min(c.ord) FROM d c WHERE c.page_id = o.page_id AND c.name = o.name AND c.ord > o.ord AND c.depth < o.depth) AS en FROM d o WHERE o.kind = 'open')
SELECT page_id, name, count(*) AS n_open, count(en) AS n_closed, CAST(max(en - ord) AS BIGINT) AS longest, CAST(max(depth) AS BIGINT) AS deepest FROM m GROUP BY 1, 2"""


def paint_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each paragraph opening of a page, the links before it and after it."""
    t = islands.prefix_suffix(tags(table(spark, sf_dir, "pages")), ["page_id"], ["ord"], (F.col("name") == "a") & (F.col("kind") == "open"))
    return t.where("name = 'p' and kind = 'open'").select("page_id", F.col("ord").cast("long").alias("ord"), "n_prefix", "n_suffix")


PAINT_PREFIX_COUNTS = f"""WITH {_TAGS}, p AS (SELECT *, sum(CAST(name = 'a' AND kind = 'open' AS INT)) OVER (PARTITION BY page_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS pre, sum(CAST(name = 'a' AND kind = 'open' AS INT)) OVER (PARTITION BY page_id) AS total FROM tags)
SELECT page_id, CAST(ord AS BIGINT) AS ord, CAST(pre AS BIGINT) AS n_prefix, CAST(total - pre AS BIGINT) AS n_suffix FROM p WHERE name = 'p' AND kind = 'open'"""


QUERIES = {f.__name__: f for f in (nesting_audit, graphics_scope_match, paint_prefix_counts)}
ORACLES = {"nesting_audit": NESTING_AUDIT, "graphics_scope_match": GRAPHICS_SCOPE_MATCH, "paint_prefix_counts": PAINT_PREFIX_COUNTS}
