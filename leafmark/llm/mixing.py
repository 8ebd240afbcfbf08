"""Mixing sources to target weights.

The sizes (words) of all documents are summed by source; target weights give
each source a target and so a repetition rate; each document is emitted
floor(rate) times, and once more if a hash of its id and the seed falls below
the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.components import attach
from leafmark.llm.shared import stage

WEIGHTS = (1.0, 2.0, 3.0)
MOST_REPEATS = 3.0
SEED = "mix-1"
#: Sources whose rates are broadcast at most; more are joined by a shuffle.
BROADCAST = 20_000
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _draw(doc_id: str, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the id and the seed."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":" + seed)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights=WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) of a table (source, size).

    Sources in the order of their code points, null last, take the weights in
    turn.  Targets are shares of the total by weight; a target over `most`
    times its source's size stops there, and the excess is shared again by
    weight until none is above.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = per_source.withColumn("missing", F.col("source").isNull())
    ordered = ordered.repartitionByRange(F.col("missing"), F.col("source")).sortWithinPartitions("missing", "source")
    ordered = stage(ordered.withColumn("at", F.monotonically_increasing_id()), "sources")
    # the rank of a source: its place in its partition and the sources in partitions before; one row a partition here
    before, counts = 0, {}
    for part, n in sorted(ordered.groupBy(F.shiftright("at", 33).alias("part")).count().collect()):
        counts[part], before = before, before + n
    if not counts:
        return ordered.selectExpr("source", "source_size", "0D target")
    offset = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.shiftright("at", 33)]
    rank = offset + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.array(*[F.lit(float(w)) for w in weights])
    table = ordered.withColumn("weight", F.get(weight, (rank % len(weights)).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    share, before = None, -1.0
    while share is None or share != before:
        capped = F.lit(False) if share is None else F.col("weight") * F.lit(share) > cap
        full, rest = table.agg(
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))
        ).first()
        before, share = share, (total - full) / rest if rest else before
        if not rest:
            break
    target = F.least(cap, F.col("weight") * F.lit(float(share or 0.0)))
    return table.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, most: float = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, rate, copies.

    Null and empty texts have size 0; a source of size 0 has target 0 and its
    documents no copies.  Rows without source are a source of their own.
    Repeated rows are drawn alike, rows without doc_id all alike.  Columns of
    docs with the names of the new ones are replaced.
    """
    made = ("size", "source_size", "target", "rate", "copies")
    own = [c for c in docs.columns if c not in made]
    sized = docs.select(F.struct(*own).alias("_own"), "doc_id", "source", n_words().alias("size"))
    targets = stage(source_targets(sized.select("source", "size"), weights, most), "targets").withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    if targets.count() <= BROADCAST:
        out = sized.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("of")))
    else:  # sources with many documents are split off before the shuffle
        named = lambda c: [F.col(c).isNull().alias("_missing"), F.coalesce(F.col(c), F.lit("")).alias("_source")]
        counts = sized.groupBy(*named("source")).agg(F.count("*").alias("_n"))
        facts = stage(targets.select(*named("of"), "source_size", "target").join(counts, ["_missing", "_source"]), "sources")
        total = facts.agg(F.sum("_n")).first()[0]
        out = attach(sized.select("*", *named("source")), facts, ["_missing", "_source"], "_n", total)
    out = out.withColumn("rate", rate)
    extra = _draw("doc_id", seed) < F.col("rate") - F.floor("rate")
    return out.select("_own.*", "size", "source_size", "target", "rate", (F.floor("rate") + extra.cast("long")).cast("long").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each document as often as plan() says, with its copy number from 1."""
    planned = plan(docs, weights, most, seed).where("copies > 0")
    own = [c for c in docs.columns if c in planned.columns and c != "copy" and c not in ("size", "source_size", "target", "rate", "copies")]
    return planned.select(*own, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
