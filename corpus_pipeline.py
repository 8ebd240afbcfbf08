"""From raw documents to a training mix: five stages, each written and read again.

Stages take (spark, docs, sf_dir) and return the columns of documents; the
last also returns the number of each copy.  Every stage works on all rows that
its predecessor kept, and nothing else is carried between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import decontam, jaccard, langid, lines, mixing
from leafmark.llm.shared import Scratch

#: A text whose largest language has less than this share is no text of a language.
LEAST_SHARE = 0.4
#: Lines of fewer distinct texts of a source than this stay.
LEAST_TEXTS = 4
#: Ids (8 bytes) that are broadcast at most; more are joined by a shuffle.
BROADCAST = 1_000_000


def _few(ids: DataFrame) -> DataFrame:
    """Ids, to be broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without a letter, or without a language of LEAST_SHARE, go.

    Null and empty texts have no letter and go; rows without doc_id and
    repeated rows are judged by their texts alone; of an empty table nothing is
    learned and nothing stays.
    """
    found = langid.identify(docs, langid.trained_on_rest(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that too many distinct texts of their source have; a null text stays null.

    Copies count once here: the next stage is to find them whole.  Rows
    without source form one source; ids, null or repeated, play no part.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    marked = docs.select(*rest, "text", F.col("text").isNotNull().alias("_has_text_"))
    found = lines.dedup(marked, F.col("source"), F.split("text", "\n"), min_rows=LEAST_TEXTS, keep=[*rest, "_has_text_"], once=True)
    text = F.when(F.col("_has_text_"), F.array_join("kept_lines", "\n"))  # all lines joined are the text
    return found.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links join, the one with the smallest doc_id; of rows that repeat an id, one.

    Null and empty texts link with nothing and stay; rows without doc_id take
    no part and stay.  Of the texts of one id the first that isn't empty stays.
    Only ids are looked up: texts aren't shuffled while those ids are few.
    """
    found = jaccard.join(docs)
    goes = found.where("doc_id <> component_id").select("doc_id").distinct()
    single = docs.join(_few(goes), "doc_id", "left_anti").select(*docs.columns)
    twice = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if twice.isEmpty():
        return single
    twice = _few(twice)
    own = F.struct(*docs.columns)
    best = F.struct(F.coalesce(F.char_length("text"), F.lit(0)) == 0, F.col("text"), F.to_json(own))
    one = single.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(own, best).alias("own")).select("own.*")
    return single.join(twice, "doc_id", "left_anti").select(*docs.columns).unionAll(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that the benchmark has; those that lose all their words go.

    Null and empty texts have no words and stay; ids play no part.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.decontaminate(docs, benchmark).where("n_hit = 0 or n_hit < n_words")
    text = F.when(F.col("contaminated"), F.col("clean_text")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: documents as often as their source's weight says, with the number of the copy.

    Rows of one id are drawn alike, those without an id all alike; documents
    of a source without words have no copies.
    """
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: SQL can't express language identification; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from documents; what a stage writes for itself goes when its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        with Scratch(spark, every=True) as scratch:
            docs = scratch.keep(step(spark, docs, sf_dir), name)
    return docs
