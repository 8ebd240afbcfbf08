"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte n-grams, counted on labelled
texts.  A document is a mixture of languages: expectation-maximisation
estimates the proportions that maximise the likelihood of its n-grams, and a
language stays in the set only if it raises the log likelihood by more than a
penalty.  The likelihood is concave in the proportions, so the gradient at a
single language tells exactly, without iterating, when no mixture can gain
more than the penalty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.shared import lean
from leafmark.llm.words import bounded, text_bytes

#: Labelled texts a language that the n-grams are counted on, about; chosen by a hash of the id.
TRAIN_TEXTS = 2000
#: Byte n-grams are hashed to 2 ** BITS cells, and so a model has that many numbers a language.
BITS = 14
ORDERS = (2, 3, 4)
#: Numbers of a model, about: more than MODEL_CELLS >> BITS languages have fewer cells each, LEAST_BITS at least.
MODEL_CELLS, LEAST_BITS = 1 << 24, 8
SMOOTHING = 0.1
STEPS = 12
#: A language must add so much log likelihood for each n-gram of the text.
PENALTY = 0.02
RESULT = "doc_id long, lang_pred string, score double, languages map<string,double>"
_LETTER = r"\p{L}"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _cells(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the text's n-grams and how often each occurs; digits and marks count as spaces."""
    a = np.frombuffer(b" " + b" ".join(text.translate(_LOWER).split()) + b" ", np.uint8).astype(np.uint32)
    grams = []
    for n in ORDERS:
        if len(a) >= n:
            code = np.zeros(len(a) - n + 1, np.uint32)
            for j in range(n):
                code = code * np.uint32(257) + a[j : len(a) - n + 1 + j]
            grams.append((code * np.uint32(2654435761)) >> np.uint32(32 - bits))
    counts = np.bincount(np.concatenate(grams) if grams else np.empty(0, np.int64), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float64)


def _sample(labelled: DataFrame, rows: dict[str, int], texts: int) -> DataFrame:
    """About so many rows a language: those whose hash lies under a share of the language's rows."""
    spark = labelled.sparkSession
    share = spark.createDataFrame([(lang, texts / n) for lang, n in rows.items()], "lang string, _share double")
    draw = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.join(F.broadcast(share), "lang").where(draw < F.col("_share"))  # one row a language, as the model has


def train(labelled: DataFrame, texts: int = TRAIN_TEXTS) -> tuple[list[str], np.ndarray]:
    """The languages in order and their log probabilities of the cells (languages by cells).

    labelled: (doc_id, text, lang), rows of null text or lang already left out.
    Any number of languages is learned; above MODEL_CELLS >> BITS of them the
    cells are coarser, so that the model, which is broadcast, keeps its size
    (and above MODEL_CELLS >> LEAST_BITS, 65,536, it grows by 1 KB a language).
    """
    import pyarrow as pa

    def count(batches):
        total = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), text_bytes(b.column("text")), strict=True):
                at, n = _cells(text, bits)
                total.setdefault(lang, np.zeros(1 << bits))[at] += n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at].astype(np.int64))], ["lang", "cell", "n"])

    rows = dict(lean(labelled).groupBy("lang").count().collect())  # one row a language, as the model has
    langs = sorted(rows)
    if not langs:
        return [], np.zeros((0, 1 << BITS))
    bits = max(LEAST_BITS, min(BITS, (MODEL_CELLS // len(langs)).bit_length() - 1))
    sample = _sample(labelled, rows, texts).select("lang", "text")
    summed = sample.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = np.full((len(langs), 1 << bits), SMOOTHING)
    place = {lang: i for i, lang in enumerate(langs)}
    for lang, cell, n in summed.toLocalIterator():
        table[place[lang], cell] += n
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def _mixture(p: np.ndarray, n: np.ndarray, chosen: list[int]) -> tuple[np.ndarray, float]:
    """Proportions of the chosen languages by expectation-maximisation, and the log likelihood."""
    q = p[chosen]
    share = np.full(len(chosen), 1.0 / len(chosen))
    for _ in range(STEPS):
        both = share[:, None] * q
        share = (both / both.sum(axis=0)) @ n
        share /= share.sum()
    return share, float(n @ np.log(share @ q))


def infer(log_p: np.ndarray, cells: np.ndarray, n: np.ndarray, penalty: float = PENALTY) -> dict[int, float]:
    """The proportions of the languages of one text, by number."""
    logs = log_p[:, cells]
    p = np.exp(logs - logs.max(axis=0))
    log_q = logs - logs.max(axis=0)
    single = log_q @ n
    best, cost = int(single.argmax()), penalty * n.sum()
    chosen, share, reached = [best], np.ones(1), float(single[best])
    while len(chosen) < len(p):
        # the gain from any mixture with more languages is at most the gradient's
        gain = (p / (share @ p[chosen])) @ n - n.sum()
        gain[chosen] = -np.inf
        more = int(gain.argmax())
        if gain[more] <= cost:
            break
        wider, value = _mixture(p, n, [*chosen, more])
        if value - reached <= cost:
            break
        chosen, share, reached = [*chosen, more], wider, value
    return dict(zip(chosen, share.tolist(), strict=True))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs with lang_pred, score and languages.

    lang_pred is the language of the largest proportion (ties: the first in
    order) and score that proportion; languages has all of the set.  A null
    text or one without a letter is `und` with score 0 and no languages; so
    is every text if the model has no language.  Whether a text has a letter
    is decided on its Unicode letters.  Columns of docs with the names of the
    new ones are replaced.
    """
    import pyarrow as pa

    langs, log_p = model
    bits = log_p.shape[1].bit_length() - 1
    made = ["lang_pred", "score", "languages"]
    own = lean(docs).drop(*made, "_letters")
    model_ = docs.sparkSession.sparkContext.broadcast(log_p.astype(np.float32))

    def predict(batches):
        table = model_.value
        for b in bounded(batches):
            preds, scores, sets = [], [], []
            for text, letters in zip(text_bytes(b.column("text")), b.column("_letters").to_pylist(), strict=True):
                if not letters or not langs:
                    preds.append("und"), scores.append(0.0), sets.append([])
                    continue
                shares = infer(table, *_cells(text, bits))
                best = min(shares, key=lambda k: (-shares[k], k))
                preds.append(langs[best]), scores.append(min(1.0, shares[best])), sets.append([(langs[k], v) for k, v in sorted(shares.items())])
            rest = [i for i, name in enumerate(b.schema.names) if name != "_letters"]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in rest] + [pa.array(preds), pa.array(scores, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))],
                [b.schema.names[i] for i in rest] + made,
            )

    from pyspark.sql.types import DoubleType, MapType, StringType, StructType

    schema = StructType([*own.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()).add("languages", MapType(StringType(), DoubleType()))
    letters = F.coalesce(F.col("text").rlike(_LETTER), F.lit(False))
    return own.withColumn("_letters", letters).mapInArrow(predict, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, modulo 3, is 1: rows that no model may learn from; false for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def trained_on_rest(docs: DataFrame, texts: int = TRAIN_TEXTS) -> tuple[list[str], np.ndarray]:
    """A model of the labelled rows of docs that aren't held out."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(_LETTER)).select("doc_id", "text", "lang")
    return train(labelled, texts)
