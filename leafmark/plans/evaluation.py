"""Evaluation queries: records against a baseline, verdicts, classes, modes, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.functions import verdicts as V
from leafmark.operators import aggregates, matching, records
from leafmark.sources.tables import table

#: Phrases of a refusal and their categories; the first that occurs counts.  Fixed values.
REJECT_PHRASES = [
    ("mixed styles", "mixed_style"), ("nonuniform", "nonuniform_spacing"), ("writer glyph positions", "writer_geometry"),
    ("glyph widths differ", "custom_glyph_width"), ("clipping", "clipping"), ("transparency", "paint_state"), ("invisible", "paint_state"),
    ("unmapped", "unicode_mapping"), ("requires shaping", "shaping"), ("no glyphs", "missing_glyph"), ("matching", "selection"),
    ("collides", "collision"), ("outside its", "collision"), ("intersects", "annotation"), ("vertical space", "overflow"),
    ("too narrow", "width_too_narrow"), ("removal affected", "removal_integrity"), ("rotated", "rotation"),
]
#: Fragments of words that stand for phrases where the driver's invented prose is classed.
TEXT_PHRASES = [("idiot", "insult"), ("password", "secret"), ("@", "address"), ("!!", "shouting"), ("|", "table"), ("tion", "prose")]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as records: the evaluation is a tenth of the ids, a case ten of them, the step the id."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        (d % 10).alias("evaluation"), F.floor(d / 10).alias("case"), d.alias("step"), "quality", "toxic", F.when(d % 4 != 0, F.col("quality") == 1).alias("saved"), F.when(d % 6 != 0, F.col("toxic") == 0).alias("reedit")
    )


_REC = "r AS (SELECT doc_id % 10 AS evaluation, doc_id // 10 AS \"case\", doc_id AS step, quality, toxic, CASE WHEN doc_id % 4 <> 0 THEN quality = 1 END AS saved, CASE WHEN doc_id % 6 <> 0 THEN toxic = 0 END AS reedit FROM labels)"


def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records against a later revision: some steps changed, some gone, some cases not run, some new."""
    base = _records(spark, sf_dir).select("evaluation", "case", "step", "quality", "toxic")
    step = F.col("step")
    now = base.where((step % 11 != 3) & (F.col("case") % 13 != 5)).withColumn("quality", F.when(step % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(step % 5 == 0, F.lit(None).cast("int")).otherwise(F.col("toxic")))
    new = base.where(step % 9 == 4).withColumn("step", -step - 1)
    out = records.compare(base, now.unionByName(new), ("evaluation", "case", "step"), ["quality", "toxic"], ("case",))
    return out.select("evaluation", "case", "step", "status", F.array_join("changes", ",").alias("changes"))


REVISION_DIFF = f"""WITH {_REC}, b AS (SELECT evaluation, "case", step, quality, toxic FROM r),
n AS (SELECT evaluation, "case", step, CASE WHEN step % 7 = 0 THEN 1 - quality ELSE quality END AS quality, CASE WHEN step % 5 = 0 THEN NULL ELSE toxic END AS toxic FROM b WHERE step % 11 <> 3 AND "case" % 13 <> 5
      UNION ALL SELECT evaluation, "case", -step - 1, quality, toxic FROM b WHERE step % 9 = 4),
j AS (SELECT coalesce(b.evaluation, n.evaluation) AS evaluation, coalesce(b."case", n."case") AS "case", coalesce(b.step, n.step) AS step, b.step IS NULL AS no_b, n.step IS NULL AS no_n, b.quality AS bq, n.quality AS nq, b.toxic AS bt, n.toxic AS nt
      FROM b FULL OUTER JOIN n ON b.evaluation = n.evaluation AND b."case" = n."case" AND b.step = n.step),
s AS (SELECT *, CASE WHEN no_b THEN 'only_current' WHEN no_n AND "case" NOT IN (SELECT "case" FROM n) THEN 'case_not_run' WHEN no_n THEN 'only_baseline' WHEN bq IS DISTINCT FROM nq OR bt IS DISTINCT FROM nt THEN 'changed' ELSE 'same' END AS status FROM j)
SELECT evaluation, "case", step, status, CASE WHEN status = 'changed' THEN concat_ws(',', CASE WHEN bq IS DISTINCT FROM nq THEN 'quality' END, CASE WHEN bt IS DISTINCT FROM nt THEN 'toxic' END) ELSE '' END AS changes FROM s"""


def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by evaluation and measure: steps, outcomes, and tiers as yes, no or unverified."""
    r = _records(spark, sf_dir).withColumn("outcome", F.when(F.col("step") % 17 != 0, F.when(F.col("quality") == 1, F.lit("saved")).otherwise(F.lit("refused"))))
    return records.summary(r, ["evaluation"], "outcome", ["saved", "reedit"])


OUTCOME_SUMMARY = f"""WITH {_REC}, o AS (SELECT *, CASE WHEN step % 17 <> 0 THEN CASE WHEN quality = 1 THEN 'saved' ELSE 'refused' END END AS outcome FROM r),
m AS (SELECT evaluation, unnest(['steps', 'outcome:' || coalesce(outcome, 'unknown'), 'saved:' || CASE WHEN saved THEN 'yes' WHEN NOT saved THEN 'no' ELSE 'unverified' END, 'reedit:' || CASE WHEN reedit THEN 'yes' WHEN NOT reedit THEN 'no' ELSE 'unverified' END]) AS measure FROM o)
SELECT evaluation, measure, count(*) AS n FROM m GROUP BY ALL"""


def record_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline after two evaluations ran again: theirs replaced, all others kept."""
    base = _records(spark, sf_dir).select("evaluation", "case", "step", "quality")
    now = base.where("evaluation in (2, 3) and step % 3 = 0").withColumn("quality", F.lit(9))
    return records.upsert(base, now)


RECORD_UPSERT = f"""WITH {_REC} SELECT evaluation, "case", step, quality FROM r WHERE evaluation NOT IN (SELECT evaluation FROM r WHERE evaluation IN (2, 3) AND step % 3 = 0)
UNION ALL SELECT evaluation, "case", step, 9 FROM r WHERE evaluation IN (2, 3) AND step % 3 = 0"""


def tri_state_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each user: errors are required, clicks must not fail, all else is shown; small values aren't measured."""
    e = table(spark, sf_dir, "events")
    role = F.when(F.col("event_type") == "error", F.lit(V.REQUIRED)).when(F.col("event_type") == "click", F.lit(V.MUST_NOT_FAIL)).otherwise(F.lit(V.SHOWN))
    rows = e.select("user_id", role.alias("role"), F.when(F.col("value") >= 0.5, F.col("value") < 180).alias("ok"))
    return rows.groupBy("user_id").agg(V.verdict().alias("verdict"), V.all_true("ok").alias("all_ok"), F.count("*").alias("n"))


TRI_STATE_VERDICT = """WITH c AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'r' WHEN 'click' THEN 'm' ELSE 's' END AS role, CASE WHEN value >= 0.5 THEN value < 180 END AS ok FROM events)
SELECT user_id, CASE WHEN count(*) FILTER (role <> 's' AND ok = false) > 0 THEN false WHEN count(*) FILTER (role = 'r' AND ok IS NULL) > 0 THEN NULL ELSE true END AS verdict,
CASE WHEN count(*) FILTER (ok = false) > 0 THEN false WHEN count(*) FILTER (ok IS NULL) > 0 THEN NULL ELSE true END AS all_ok, count(*) AS n FROM c GROUP BY user_id"""


def weighted_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language with the most characters of each source; of equal ones, that of the smallest id."""
    return aggregates.weighted_mode(table(spark, sf_dir, "documents"), ["source"], "lang", "doc_id", F.col("n_chars"))


WEIGHTED_MODE = """WITH t AS (SELECT source, lang, sum(n_chars) AS w, min(doc_id) AS f FROM documents GROUP BY 1, 2)
SELECT source, lang AS mode, CAST(w AS BIGINT) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, f) AS rn FROM t) WHERE rn = 1"""


def consensus_and_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user and type: the common tenth of the values if there is one, and how the intervals align."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.col("value") / 10).alias("tenth"), (F.col("event_id") % 3).cast("double").alias("x0"), (F.col("event_id") % 5 + 10).cast("double").alias("x1"))
    return e.groupBy("user_id", "event_type").agg(aggregates.consensus("tenth").alias("tenth"), aggregates.alignment(1.0).alias("aligned"), F.count("*").alias("n"))


CONSENSUS_AND_SPREAD = """WITH e AS (SELECT user_id, event_type, CAST(floor(value / 10) AS BIGINT) AS tenth, event_id % 3 AS x0, event_id % 5 + 10 AS x1 FROM events)
SELECT user_id, event_type, CASE WHEN max(tenth) = min(tenth) THEN min(tenth) END AS tenth,
CASE WHEN max(x0) - min(x0) <= 1 AND max(x1) - min(x1) <= 1 THEN 'justify' WHEN max(x0) - min(x0) <= 1 THEN 'left' WHEN max(x1) - min(x1) <= 1 THEN 'right' WHEN max(x0 + x1) - min(x0 + x1) <= 2 THEN 'center' ELSE 'unknown' END AS aligned, count(*) AS n FROM e GROUP BY 1, 2"""


def boundary_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by flag and status: all that share the least burden, each with how many the group has, and their first and last order."""
    return aggregates.boundary_groups(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey", ["l_quantity", "l_linenumber"], ["l_partkey", "l_suppkey"])


BOUNDARY_GROUPS = """WITH m AS (SELECT *, rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity, l_linenumber) AS rk FROM lineitem),
g AS (SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_orderkey) AS first_ordinal, max(l_orderkey) AS last_ordinal, count(*) FILTER (rk = 1) AS n_least, count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_suppkey) AS n_l_suppkey FROM m GROUP BY 1, 2)
SELECT g.*, m.l_quantity, m.l_linenumber, m.l_orderkey AS least_ordinal FROM g JOIN m ON rk = 1 AND g.l_returnflag IS NOT DISTINCT FROM m.l_returnflag AND g.l_linestatus IS NOT DISTINCT FROM m.l_linestatus"""


def _refusals() -> list:
    return [("short", F.col("n_chars") < 500), ("long", F.col("n_chars") > 20000), ("shouting", F.contains("text", F.lit("!!"))), ("symbols", F.contains("text", F.lit("$$$"))), ("table", F.contains("text", F.lit(" | ")))]


def refusal_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons of each text, not only the first: how often each occurs, and how often alone."""
    d = table(spark, sf_dir, "documents").select("doc_id", V.reasons(_refusals()).alias("reasons"))
    return d.select(F.explode("reasons").alias("reason"), (F.size("reasons") == 1).alias("alone")).groupBy("reason").agg(F.count("*").alias("n"), F.count_if("alone").alias("n_alone"))


REFUSAL_HISTOGRAM = """WITH r AS (SELECT list_filter([CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN n_chars > 20000 THEN 'long' END, CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN contains(text, '$$$') THEN 'symbols' END, CASE WHEN contains(text, ' | ') THEN 'table' END], lambda x: x IS NOT NULL) AS rs FROM documents),
u AS (SELECT unnest(rs) AS reason, len(rs) = 1 AS alone FROM r) SELECT reason, count(*) AS n, count(*) FILTER (alone) AS n_alone FROM u GROUP BY 1"""


def reject_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by the first phrase that they contain, in a fixed order."""
    d = table(spark, sf_dir, "documents").select("n_chars", T.first_match(F.col("text"), TEXT_PHRASES).alias("category"))
    return d.groupBy("category").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


REJECT_CATEGORY = "SELECT CASE " + " ".join(f"WHEN contains(text, '{p}') THEN '{c}'" for p, c in TEXT_PHRASES) + " ELSE 'other' END AS category, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY 1"


def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by all classes whose phrases they contain, several of which may apply."""
    classes = V.reasons([(c, F.contains("text", F.lit(p))) for p, c in TEXT_PHRASES])
    d = table(spark, sf_dir, "documents").select(F.array_join(F.array_distinct(classes), "+").alias("classes"), "n_chars")
    return d.groupBy("classes").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


TEXT_CLASSES = "WITH c AS (SELECT n_chars, [" + ", ".join(f"CASE WHEN contains(text, '{p}') THEN '{c}' END" for p, c in TEXT_PHRASES) + "] AS cs FROM documents) SELECT array_to_string(list_filter(cs, lambda x, i: x IS NOT NULL AND list_position(cs, x) = i), '+') AS classes, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM c GROUP BY 1"


_MESSAGE = "'Refused: ' || pick(ps, CAST(event_id * 7 % 20 AS INT) + 1) || '; ' || pick(ps, CAST(user_id % 20 AS INT) + 1)"
_PIECES = [p + " here" for p, _ in REJECT_PHRASES] + ["nothing known", "MATCHING"]


def refusal_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as refusal messages, by the category of the first phrase, in the fixed order, that each contains."""
    e = table(spark, sf_dir, "events").withColumn("ps", F.array(*[F.lit(p) for p in _PIECES])).selectExpr("user_id", _MESSAGE.replace("pick", "element_at") + " AS message")
    return e.groupBy(T.first_match(F.col("message"), REJECT_PHRASES).alias("category")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


REFUSAL_CATEGORIES = (
    f"WITH m AS (SELECT user_id, {_MESSAGE.replace('pick', 'list_extract')} AS message FROM (SELECT *, [" + ", ".join(f"'{p}'" for p in _PIECES) + "] AS ps FROM events)) SELECT CASE "
    + " ".join(f"WHEN strpos(message, '{p}') > 0 THEN '{c}'" for p, c in REJECT_PHRASES) + " ELSE 'other' END AS category, count(*) AS n, count(DISTINCT user_id) AS n_users FROM m GROUP BY 1"
)


#: Globs of addresses, what they concern directly and what else is related.
IMPACT_RULES = [("*/en/*", "english", "prose"), ("*/de/*", "german", "prose"), ("*example.org*", "charity", "hosts"), ("*casino*", "betting", "hosts"), ("*?page=*", "paging", "queries")]


def _glob(pattern: str) -> str:
    import re

    return "^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", r"\?") + "$"


def impact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses against glob rules: all evaluations that a page concerns; pages without a rule are uncovered."""
    pages = table(spark, sf_dir, "pages")
    hits = F.array_compact(F.array(*[F.when(F.col("url").rlike(_glob(g)), F.lit(d)) for g, d, _ in IMPACT_RULES]))
    related = F.array_distinct(F.array_compact(F.array(*[F.when(F.col("url").rlike(_glob(g)), F.lit(r)) for g, _, r in IMPACT_RULES])))
    return pages.select("page_id", F.array_join(hits, ",").alias("direct"), F.array_join(F.array_sort(related), ",").alias("related"), (F.size(hits) == 0).alias("uncovered"))


def _impact_sql() -> str:
    like = lambda g: "'" + g.replace("_", "\\_").replace("*", "%") + "'"
    hits = ", ".join(f"CASE WHEN url LIKE {like(g)} ESCAPE '\\' THEN '{d}' END" for g, d, _ in IMPACT_RULES)
    related = ", ".join(f"CASE WHEN url LIKE {like(g)} ESCAPE '\\' THEN '{r}' END" for g, _, r in IMPACT_RULES)
    return f"WITH h AS (SELECT page_id, list_filter([{hits}], lambda x: x IS NOT NULL) AS d, list_sort(list_distinct(list_filter([{related}], lambda x: x IS NOT NULL))) AS r FROM pages) SELECT page_id, array_to_string(d, ',') AS direct, array_to_string(r, ',') AS related, len(d) = 0 AS uncovered FROM h"


IMPACT_RULES_SQL = _impact_sql()


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each text and of its canonical record, and the rows that share the text's."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_digest"), T.digest("doc_id", "n_chars").alias("record_digest"))
    n = d.groupBy("text_digest").agg(F.count("*").alias("n_same"))
    return d.join(n, "text_digest").select("doc_id", "text_digest", "record_digest", "n_same")


CONTENT_DIGEST = """SELECT doc_id, sha256(text) AS text_digest, sha256('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}') AS record_digest, count(*) OVER (PARTITION BY sha256(text)) AS n_same FROM documents"""


def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, pages and their sizes by language."""
    d = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.max("n_chars").alias("longest"))
    p = table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]{2})/", 1).alias("language")).agg(F.count("*").alias("n_pages"), F.sum(F.char_length("html")).alias("n_html"))
    return d.join(p, "language", "full_outer")


CORPUS_PROFILE = r"""WITH d AS (SELECT lang AS language, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars, max(n_chars) AS longest FROM documents GROUP BY 1),
p AS (SELECT regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) AS language, count(*) AS n_pages, CAST(sum(length(html)) AS BIGINT) AS n_html FROM pages GROUP BY 1)
SELECT coalesce(d.language, p.language) AS language, n_docs, n_chars, longest, n_pages, n_html FROM d FULL OUTER JOIN p ON d.language = p.language"""


def sequence_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters kept and changed between near copies, by longest-match alignment: all linked pairs of distinct texts, and each exact copy with its first."""
    return matching.aligned_copies(table(spark, sf_dir, "documents"), "doc_id", "text")


def nfkc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each text after NFKC, white space taken out, and its grapheme clusters."""
    return T.normalized(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


_F = (revision_diff, outcome_summary, record_upsert, tri_state_verdict, weighted_mode, consensus_and_spread, boundary_groups, refusal_histogram, reject_category, text_classes, refusal_categories, impact_rules, content_digest, corpus_profile, sequence_align, nfkc_normalize)
QUERIES = {f.__name__: f for f in _F}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _F if isinstance(globals().get(f.__name__.upper()), str)} | {"impact_rules": IMPACT_RULES_SQL}
