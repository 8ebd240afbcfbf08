"""Small tables that hold the hard cases: nulls anywhere, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = ("chunk", "size", "target", "n_words", "kept", "token", "rank", "score", "lang_pred", "copies", "_lines", "host", "clean_text")


def words(seed: int, n: int, pool: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def rows() -> list[tuple]:
    base = words(1, 120, 100000)
    near = [*base[:60], "CHANGED", *base[61:]]
    passage = words(2, 55, 100000)
    out = [
        (1, " ".join(base), "en", "a", 1), (2, " ".join(base), "en", "a", 1), (3, " ".join(near), "en", "b", None), (4, "\n".join(near).upper(), None, "b", 1),
        (5, None, None, None, None), (6, "", "en", "a", 0), (7, " \t\n ", "de", "c", 4), (8, "one two three", "en", "c", 1), (9, "One  TWO\nthree", "en", "c", 1),
        (10, " ".join(words(3, 40) + passage), "fr", "a", 1), (11, " ".join(passage + words(4, 90)), "fr", "é", 1), (12, " ".join(["same"] * 60), "en", None, 1),
        (13, "# $ % & | < > * " * 10 + "\nline one\nline one\nline two", "en", "a", 1), (14, "日本 語の　文 ñandú x " * 8, "es", "日", 1),
        (15, " ".join(words(5, 6000, 9000)), "en", "a", 1), (15, " ".join(words(5, 6000, 9000)), "en", "a", 1), (16, "x" * 3000, "en", "b", 1), (None, " ".join(base), "en", "a", 1), (None, None, None, None, None),
        (17, " ".join(w for k in range(30) for w in words(k % 3, 12, 30)), "de", "b", 1), (-4, " ".join(near), "en", "b", 1),
    ]
    for i in range(20, 40):  # a group of near copies
        copy = list(base)
        copy[i] = f"edit{i}"
        out.append((i, " ".join(copy), "en", "a", 1))
    return out


def docs(spark, clash: bool = False):
    df = spark.createDataFrame(rows(), SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("clash").alias(c) for c in CLASH])
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
