"""Quality rules: a table of thresholds compiled into one projection.

measures() adds the counts of a text, with built-in functions only; rules are
rows of (name, ratio, low, high) over them, and judge() compiles the table
into a single projection of one boolean a rule.  No row is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"
WINDOW = 8

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on are as with be by this a from or an at "
    "der die das und in zu den ist von mit sich auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des du et en un une est que qui dans pour par sur au pas plus ne se ce il avec sont "
    "el la los las de que y en un una es por con para del se no su al lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """part / whole must lie in [low, high]; where whole is 0, the rule passes."""

    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("length", "n_words", "ones", 20, None),
    Rule("word_length", "word_chars", "n_words", 1.5, 20),
    Rule("symbols", "n_symbols", "n_words", None, 0.2),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("upper_case", "n_upper_chars", "word_chars", None, 0.5),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.5),
)


def _halves(hashes: Column, step: int) -> Column:
    """Hashes of pairs of values so far apart."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, step + 1, n), lambda x, y: F.xxhash64(x, y))


def _with_windows(df: DataFrame, words: str, window: int, name: str) -> DataFrame:
    """df with 64-bit hashes of all windows of so many words, made from those of windows half as long."""
    df, width = df.withColumn(name, F.transform(words, lambda w: F.xxhash64(w))), 1
    while width < window:
        step = min(width, window - width)
        df = df.withColumn(name, _halves(F.col(name), step))
        width += step
    return df


def measures(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the counts of the text; a null text counts as an empty one.

    A window of words counts as repeated when its 64-bit hash does.  Columns of
    docs with the names of the new ones are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_stop_words", "n_upper_chars", "n_repeat_words", "ones"]
    own = F.struct(*[c for c in docs.columns if c not in made]).alias("_own")  # so no name of theirs meets one of ours
    text = F.coalesce("text", F.lit(""))
    arrays = docs.select(
        own,
        F.filter(F.split(text, _SPACE), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(_WORD)).alias("_lines"),
        F.char_length(F.regexp_replace(text, _SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper_chars"),
    )
    words, lines = F.col("_words"), F.col("_lines")
    stop = list(dict.fromkeys(form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())))
    counted = arrays.select(
        "_own", "word_chars", "n_symbols", "n_upper_chars", "_words",
        F.size(words).cast("long").alias("n_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda line: line.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter(words, lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
    )
    counted = _with_windows(counted, "_words", window, "_windows")
    # positions of the windows whose hash occurs again, in order; skipped where all hashes differ
    hashes = F.col("_windows")
    paired = counted.select(
        "_own", *[c for c in counted.columns if c in made],
        F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_pairs"),
    )
    pairs = F.col("_pairs")
    again = F.filter(
        F.transform(
            pairs,
            lambda p, k: F.when(
                (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]), p["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    placed = paired.select("_own", *[c for c in paired.columns if c in made], F.sort_array(again).alias("_again"))
    at = F.col("_again")
    covered = F.aggregate(
        F.transform(at, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - i, F.lit(window)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    return placed.select(
        "_own.*", *[c for c in placed.columns if c in made], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.lit(1).cast("long").alias("ones")
    )


def compiled(rules=RULES) -> list[Column]:
    """A boolean column for each rule, rule_<name>: true where the text passes."""
    out = []
    for r in rules:
        part, whole = F.expr(r.part), F.expr(r.whole)
        passes = F.lit(True)
        if r.low is not None:
            passes &= part >= F.lit(float(r.low)) * whole
        if r.high is not None:
            passes &= part <= F.lit(float(r.high)) * whole
        out.append(((whole == 0) | passes).alias(f"rule_{r.name}"))
    return out


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with the measures, a boolean for each rule, base_failed and kept.

    Null and empty texts have no words, so base_failed is true and kept false.
    Each row is judged alone: repeated rows alike.  Columns of docs with the
    names of the new ones are replaced.
    """
    flags = compiled(rules)
    names = [f"rule_{r.name}" for r in rules]
    measured = measures(docs.drop(*names, "base_failed", "kept"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = measured.select("*", *flags, base.alias("base_failed")).drop("ones")
    passed = F.lit(True)
    for name in names:
        passed &= F.col(name)
    return judged.withColumn("kept", ~F.col("base_failed") & passed)
