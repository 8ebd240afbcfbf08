"""The queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import codes, decontam, fingerprints, jaccard, langid, lines, lmscore, mixing, quality, substrings, toxicity, variants, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_table(spark, sf_dir, "documents")).drop("kept_text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.trained_on_rest(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("unfit"), "toxic")
    found = toxicity.predict(docs, toxicity.train(docs, labels, ["unfit", "toxic"]))
    return found.select("doc_id", "p_unfit", "p_toxic", F.col("is_toxic").alias("toxic"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    return lmscore.score(_table(spark, sf_dir, "documents"), labels.where("quality = 1"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = lines.dedup(pages, lines.host_of(F.col("url")), lines.html_lines(F.col("html")), keep=["page_id", "url"])
    return found.select("page_id", lines.host_of(F.col("url")).alias("host"), "n_lines", "n_dropped", F.sha2(F.array_join("kept_lines", "\n"), 256).alias("kept_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(_table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(_table(spark, sf_dir, "documents"))


def queries():
    every = (
        op1_mix_sources, op2_quality_rules, op3_ngram_jaccard_join, op4_substring_dedup, op5_language_id, op6_decontaminate, op7_toxicity, op8_lm_scoring, op9_line_dedup, op10_warc,
        op11_vector_codes, op12_spelling_variants, op13_fingerprints,
    )
    return {f.__name__: f for f in every}


_WORDS = r"[^\x20\x09-\x0D]+"

_OP1 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
             sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
l AS (SELECT max((total - full_before) / rest) FILTER ((total - full_before) / rest <= cap / w) AS share FROM o),
t AS (SELECT source, source_size, least(cap, w * coalesce(share, 1e300)) AS target FROM r, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':mix-1'), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 3) AS target,
       size * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM p"""

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(f for w in quality.STOP_WORDS for f in (w, w.capitalize(), w.upper())))


def _rules_sql() -> str:
    parts = []
    for r in quality.RULES:
        tests = [f"{r.part} >= {r.low} * {r.whole}"] * (r.low is not None) + [f"{r.part} <= {r.high} * {r.whole}"] * (r.high is not None)
        parts.append(f"({r.whole} = 0 OR ({' AND '.join(tests)}))")
    return " AND ".join(parts)


_OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '{_WORDS}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS ls FROM d),
win AS (SELECT k, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT k, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM rep) GROUP BY k),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, 1 AS ones, len(ls) AS n_lines,
             length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper_chars,
             len(list_filter(ws, lambda x: x IN ({_STOP}))) AS n_stop_words,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
      FROM w LEFT JOIN cov USING (k)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {_rules_sql()}) AS kept FROM b"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_ALNUM}') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW.format("text")}, '{_ALNUM}') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
       FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT k, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS i FROM d, sizes)),
hit AS (SELECT DISTINCT dw.k, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hit) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)"""

_OP4 = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS k, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
win AS (SELECT k, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS i FROM d)),
rep AS (SELECT k, i FROM (SELECT k, i, row_number() OVER (PARTITION BY g ORDER BY k, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT k, unnest(range(i, i + 20)) AS p FROM rep),
gl AS (SELECT k, list(p) AS ps FROM gone GROUP BY k),
kept AS (SELECT d.k, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT k, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d) AS d ANTI JOIN gone ON d.k = gone.k AND d.p = gone.p GROUP BY d.k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k)"""

_OP3 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT k, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k), b AS (SELECT d.k, doc_id, n FROM d JOIN n USING (k) WHERE doc_id IS NOT NULL),
p AS (SELECT x.k AS u, y.k AS v, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.k <> y.k GROUP BY 1, 2),
l AS (SELECT DISTINCT x.doc_id AS u, y.doc_id AS v FROM p JOIN b x ON p.u = x.k JOIN b y ON p.v = y.k WHERE 100 * i >= 75 * (x.n + y.n - i)),
r(u, root) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.root = l.u),
c AS (SELECT u, min(root) AS root FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, c.root) AS component_id FROM d LEFT JOIN n USING (k) LEFT JOIN c ON c.u = d.doc_id"""

_OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""


_OP11 = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT k, j, e[j * (len(e) // 16) + 1 : (j + 1) * (len(e) // 16)] AS x FROM v, (SELECT unnest(range(16)) AS j)),
c0 AS (SELECT j, k - 1 AS i, x AS y FROM p WHERE k <= 64),
{"".join(f"""a{r} AS (SELECT k, j, min(d) AS d FROM (SELECT k, p.j, [CAST(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), i] AS d FROM p JOIN c{r} ON p.j = c{r}.j) GROUP BY k, j),
s{r} AS (SELECT j, i, list(CAST(floor(s / n) AS BIGINT) ORDER BY q) AS y FROM (SELECT p.j, d[2] AS i, q, sum(x[q]) AS s, CAST(count(*) AS DOUBLE) AS n FROM p JOIN a{r} USING (k, j), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS q) GROUP BY p.j, d[2], q) GROUP BY j, i),
c{r + 1} AS (SELECT j, i, coalesce(s{r}.y, c{r}.y) AS y FROM c{r} LEFT JOIN s{r} USING (j, i)),
""" for r in range(2))}a2 AS (SELECT k, j, min(d) AS d FROM (SELECT k, p.j, [CAST(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), i] AS d FROM p JOIN c2 ON p.j = c2.j) GROUP BY k, j),
m AS (SELECT k, string_agg(format('{{:02x}}', d[2]), '' ORDER BY j) AS code, CAST(sum(d[1]) AS BIGINT) AS error FROM a2 GROUP BY k),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY j, i)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN m USING (k), h"""

_BLOCK = r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|td|th|table|nav|article|section|header|footer|title|head|body|html|blockquote|pre|hr)\b[^>]*>|\n"

_OP9 = rf"""
WITH p AS (SELECT row_number() OVER () AS k, page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)', 1)), '.'), '') AS host,
             regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|<(?i:script)\b.*?</(?i:script)\s*>|<(?i:style)\b.*?</(?i:style)\s*>', ' ', 'g') AS t FROM pages),
l AS (SELECT k, host, trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS line, i
      FROM (SELECT k, coalesce(host, '') AS host, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM (SELECT k, host, regexp_split_to_array(t, '{_BLOCK}') AS ls FROM p))),
v AS (SELECT * FROM l WHERE line <> ''),
n AS (SELECT host, line, count(DISTINCT k) AS n FROM v GROUP BY host, line),
h AS (SELECT coalesce(host, '') AS host, count(*) AS pages FROM p GROUP BY 1),
gone AS (SELECT host, line FROM n JOIN h USING (host) WHERE n >= 2 AND n > 0.1 * pages),
m AS (SELECT v.k, v.i, v.line, gone.line IS NOT NULL AS drops FROM v LEFT JOIN gone ON v.host = gone.host AND v.line = gone.line),
r AS (SELECT k, count(*) AS n_lines, count(*) FILTER (drops) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT drops) AS kept FROM m GROUP BY k)
SELECT page_id, host, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM p LEFT JOIN r USING (k)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that SQL can express on whole tables."""
    return {"op1_mix_sources": _OP1, "op2_quality_rules": _OP2, "op3_ngram_jaccard_join": _OP3, "op4_substring_dedup": _OP4, "op6_decontaminate": _OP6, "op9_line_dedup": _OP9, "op10_warc": _OP10, "op11_vector_codes": _OP11}
