"""Queries over scopes and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.operators import structure
from leafmark.plans.markup import _TAGS
from leafmark.sources.tables import table, tags

# a scope ends at the first token after it that leaves its depth; unmatched closes change nothing
_SCOPES = f"""{_TAGS}, s1 AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS s FROM tags),
s2 AS (SELECT *, least(0, min(s) OVER (PARTITION BY page_id ORDER BY ord ROWS UNBOUNDED PRECEDING)) AS low FROM s1), s3 AS (SELECT *, s - low AS depth, kind = 'close' AND low < coalesce(lag(low) OVER (PARTITION BY page_id ORDER BY ord), 0) AS unmatched FROM s2),
sc AS (SELECT o.page_id, o.ord AS scope, o.name, o.depth AS level, (SELECT min(c.ord) FROM s3 c WHERE c.page_id = o.page_id AND c.ord > o.ord AND c.depth < o.depth) AS en FROM s3 o WHERE o.kind = 'open')"""
_ACTIVE = "act AS (SELECT t.page_id, t.ord, t.name, t.kind, sc.scope, sc.level, sc.en, sc.name AS scope_name FROM s3 t LEFT JOIN sc ON sc.page_id = t.page_id AND sc.scope < t.ord AND (sc.en IS NULL OR t.ord <= sc.en))"


def marked_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of each page: how many, unterminated, unmatched closes, and what is open at every token."""
    t = tags(table(spark, sf_dir, "pages"))
    s = structure.scopes(t, ["page_id"]).groupBy("page_id").agg(F.count("*").alias("n_scopes"), F.count_if(F.col("end").isNull()).alias("n_unterminated"), F.sum(F.coalesce(F.col("end") - F.col("scope"), F.lit(0))).cast("long").alias("spanned"))
    a = structure.active(t, ["page_id"]).groupBy("page_id").agg(F.count("scope").alias("n_active"), F.sum(F.coalesce((F.col("scope") + 1) * (F.col("ord") + 3), F.lit(0))).cast("long").alias("checksum"), F.max("outside").cast("long").alias("deepest"))
    return a.join(s, "page_id", "left").fillna(0)


MARKED_CONTENT = f"""WITH {_SCOPES}, {_ACTIVE},
a AS (SELECT page_id, count(scope) AS n_active, CAST(coalesce(sum((scope + 1) * (ord + 3)), 0) AS BIGINT) AS checksum, CAST(max(n) AS BIGINT) AS deepest FROM (SELECT *, count(scope) OVER (PARTITION BY page_id, ord) AS n FROM act) GROUP BY page_id),
b AS (SELECT page_id, count(*) AS n_scopes, count(*) FILTER (en IS NULL) AS n_unterminated, CAST(sum(coalesce(en - scope, 0)) AS BIGINT) AS spanned FROM sc GROUP BY page_id)
SELECT a.page_id, n_active, checksum, deepest, coalesce(n_scopes, 0) AS n_scopes, coalesce(n_unterminated, 0) AS n_unterminated, coalesce(spanned, 0) AS spanned FROM a LEFT JOIN b ON a.page_id = b.page_id"""


def enclosing_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of scopes around each link of a page, or why it can't be relied on."""
    t = tags(table(spark, sf_dir, "pages"))
    return structure.chains(t, ["page_id"], (F.col("name") == "a") & (F.col("kind") == "open") | (F.col("kind") == "void")).withColumnRenamed("outer", "outermost").withColumnRenamed("inner", "innermost").withColumn("depth", F.col("depth").cast("long"))


ENCLOSING_SCOPES = f"""WITH {_SCOPES}, {_ACTIVE},
c AS (SELECT page_id, ord, count(scope) AS depth, min(scope) AS o, max(scope) AS i, count(scope) FILTER (en IS NULL) AS loose FROM act WHERE (name = 'a' AND kind = 'open') OR kind = 'void' GROUP BY page_id, ord),
r AS (SELECT *, CASE WHEN depth > 3 THEN 'nested too deep' WHEN loose > 0 THEN 'a scope doesn''t close' END AS reason FROM c)
SELECT page_id, CAST(ord AS INT) AS ord, depth, CASE WHEN reason IS NULL THEN CAST(o AS INT) END AS outermost, CASE WHEN reason IS NULL THEN CAST(i AS INT) END AS innermost, reason FROM r"""

_BLOCK_TAGS = ("p", "li", "td", "div", "article", "section", "body")


def block_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block element that each void tag or link of a page belongs to: the innermost of the scopes around it that is one."""
    t = tags(table(spark, sf_dir, "pages"))
    around = structure.active(t, ["page_id"]).where("kind = 'void' or (name = 'a' and kind = 'open')").drop("name")
    named = around.join(structure.scopes(t, ["page_id"]).select("page_id", "scope", "name"), ["page_id", "scope"], "left")
    return named.groupBy("page_id", "ord").agg(F.max(F.when(F.col("name").isin(*_BLOCK_TAGS), F.struct("scope", "name"))).alias("b")).select("page_id", "ord", F.col("b.scope").alias("block"), F.col("b.name").alias("block_name"))


BLOCK_OWNERS = f"""WITH {_SCOPES}, {_ACTIVE} SELECT page_id, CAST(ord AS INT) AS ord, CAST(max(scope) FILTER (scope_name IN {_BLOCK_TAGS}) AS INT) AS block, arg_max(scope_name, scope) FILTER (scope_name IN {_BLOCK_TAGS}) AS block_name
FROM act WHERE kind = 'void' OR (name = 'a' AND kind = 'open') GROUP BY page_id, ord"""


def scope_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each list and paragraph of a page holds: the names of the tags within, in order."""
    t = tags(table(spark, sf_dir, "pages"))
    wanted = structure.scopes(t, ["page_id"]).where("name in ('p', 'ul', 'li', 'div')").select("page_id", "scope", F.col("name").alias("element"))
    inside = structure.active(t, ["page_id"]).where("kind <> 'close' and scope is not null").select("page_id", "scope", "ord", "name")
    held = wanted.join(inside, ["page_id", "scope"], "left").groupBy("page_id", "scope", "element").agg(F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("all"))
    names = F.array_join(F.transform("all", lambda x: x["name"]), " ")
    return held.select("page_id", "scope", "element", F.size(F.filter("all", lambda x: x["ord"].isNotNull())).cast("long").alias("n_tags"), names.alias("contents"))


SCOPE_CONTENTS = f"""WITH {_SCOPES}, {_ACTIVE}, i AS (SELECT page_id, scope, ord, name FROM act WHERE kind <> 'close')
SELECT sc.page_id, CAST(sc.scope AS INT) AS scope, sc.name AS element, count(i.ord) AS n_tags, coalesce(string_agg(i.name, ' ' ORDER BY i.ord), '') AS contents FROM sc LEFT JOIN i ON i.page_id = sc.page_id AND i.scope = sc.scope
WHERE sc.name IN ('p', 'ul', 'li', 'div') GROUP BY sc.page_id, sc.scope, sc.name"""


def invocation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every opening of a page with how often the page opens that element."""
    t = tags(table(spark, sf_dir, "pages")).where("kind = 'open'")
    n = t.groupBy("page_id", "name").agg(F.count("*").alias("n_on_page"))
    return t.join(n, ["page_id", "name"]).select("page_id", "ord", "name", "n_on_page")


INVOCATION_COUNTS = f"WITH {_TAGS} SELECT page_id, CAST(ord AS INT) AS ord, name, count(*) OVER (PARTITION BY page_id, name) AS n_on_page FROM tags WHERE kind = 'open'"

_TREE = """SELECT 'r' || r_regionkey AS node, NULL AS parent, r_regionkey AS place FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey FROM customer UNION ALL SELECT 'o' || o_orderkey, CASE WHEN o_orderkey % 97 = 5 THEN 'o' || (o_orderkey + 97) WHEN o_orderkey % 97 = 6 THEN 'x' || o_orderkey ELSE 'c' || o_custkey END, o_orderkey FROM orders
UNION ALL SELECT 'z' || r_regionkey, 'z' || (r_regionkey + 1) % 5, r_regionkey FROM region"""


def structure_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and orders as a tree with chains, strays and a cycle: each node's place in it."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders")}
    return structure.paths(spark.sql(_TREE.replace("FROM region", "FROM {region}").replace("FROM nation", "FROM {nation}").replace("FROM customer", "FROM {customer}").replace("FROM orders", "FROM {orders}"), **t), "node", "parent", "place")


STRUCTURE_PATHS = f"""WITH RECURSIVE e AS ({_TREE}), k AS (SELECT e.node, p.node AS parent, row_number() OVER (PARTITION BY p.node ORDER BY e.place, e.node) AS i FROM e LEFT JOIN e p ON e.parent = p.node),
w(node, depth, path) AS (SELECT node, 0, CAST(i AS VARCHAR) FROM k WHERE parent IS NULL UNION ALL SELECT k.node, w.depth + 1, w.path || '/' || k.i FROM w JOIN k ON k.parent = w.node)
SELECT e.node, CAST(w.depth AS INT) AS depth, w.path FROM e LEFT JOIN w ON e.node = w.node"""


_F = (marked_content, enclosing_scopes, block_owners, scope_contents, invocation_counts, structure_paths)
QUERIES = {f.__name__: f for f in _F}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _F}
