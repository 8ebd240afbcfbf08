"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other: each model is a logistic
regression over the presence of words and the probabilities of the earlier
categories.  In training those probabilities are out of fold: a text's are
made by models that haven't seen it.

The models learn from a bounded sample of labelled texts, chosen by a hash of
the id, and are broadcast with at most so many words a category; prediction
is a pass over the texts without a shuffle.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.shared import lean
from leafmark.llm.words import ALNUM, Words, bounded, text_bytes

#: Labelled texts that are learned from, about, and their bytes, about; longer texts than LONGEST teach nothing.
TRAIN_TEXTS, TRAIN_BYTES, LONGEST = 8000, 128 << 20, 1 << 20
#: Words of a model at most, chosen by how far their share of positive texts is from that of all texts,
WORDS = 1500
#: and by at least so many standard deviations, in so many texts.
LEAST_FAR, MIN_TEXTS = 4.0, 5
FOLDS = 4
STEPS, RATE, RIDGE = 300, 0.5, 1e-2
THRESHOLD = 0.5


@dataclass
class Link:
    """One classifier of the chain: words (sorted hashes), their weights, the weights of earlier categories, a bias."""

    category: str
    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


def _word_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct word hashes of each text."""
    words = Words(texts, ALNUM)
    hashes, first = words.hashes(), words.first
    out = []
    for lo, hi in zip(first, first[1:], strict=False):
        own = np.sort(hashes[lo:hi])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _fit(category: str, sets: list[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> Link:
    """A logistic regression by gradient steps with a step size for each weight."""
    n, base = len(y), (y.sum() + 0.5) / (len(y) + 1.0)
    bias = float(np.log(base / (1 - base)))
    constant = Link(category, np.empty(0, np.uint64), np.empty(0), np.zeros(earlier.shape[1]), bias)
    if not n or not 0 < y.sum() < n:
        return constant
    every, text = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    words, place = np.unique(every, return_inverse=True)
    seen = np.bincount(place, minlength=len(words))
    positive = np.bincount(place, weights=y[text], minlength=len(words))
    far = np.abs(positive - seen * base) / np.sqrt(seen * base * (1 - base) + 1)
    far[seen < MIN_TEXTS] = 0
    chosen = np.sort(np.argsort(-far, kind="stable")[:WORDS])
    chosen = chosen[far[chosen] >= LEAST_FAR]
    spot = np.full(len(words), -1)
    spot[chosen] = np.arange(len(chosen))
    column = spot[place]
    text, column = text[column >= 0], column[column >= 0]
    w, v = np.zeros(len(chosen)), np.zeros(earlier.shape[1])
    size = [np.full(len(w), 1e-6), np.full(len(v), 1e-6), 1e-6]
    for _ in range(STEPS):
        score = np.bincount(text, weights=w[column], minlength=n) + earlier @ v + bias
        wrong = (_sigmoid(score) - y) / n
        grads = [np.bincount(column, weights=wrong[text], minlength=len(w)) + RIDGE / n * w, earlier.T @ wrong + RIDGE / n * v, wrong.sum()]
        size = [s + g * g for s, g in zip(size, grads, strict=True)]
        w -= RATE * grads[0] / np.sqrt(size[0])
        v -= RATE * grads[1] / np.sqrt(size[1])
        bias -= RATE * float(grads[2] / np.sqrt(size[2]))
    return Link(category, words[chosen], w, v, bias)


def _apply(link: Link, words: np.ndarray, text: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
    """Probabilities of n texts whose distinct words are given end to end."""
    score = earlier @ link.earlier + link.bias
    if len(link.words) and len(words):
        at = np.minimum(np.searchsorted(link.words, words), len(link.words) - 1)
        hit = link.words[at] == words
        score = score + np.bincount(text[hit], weights=link.weights[at[hit]], minlength=n)
    return _sigmoid(score)


def _predict(links: list[Link], sets: list[np.ndarray]) -> np.ndarray:
    n = len(sets)
    words, text = (np.concatenate(sets) if n else np.empty(0, np.uint64)), np.repeat(np.arange(n), [len(s) for s in sets])
    out = np.empty((n, 0))
    for link in links:
        out = np.column_stack([out, _apply(link, words, text, n, out)])
    return out


def _fold(own: np.ndarray) -> int:
    """The fold of a text, by its distinct words."""
    return int(hashlib.md5(own.tobytes()).digest()[0]) % FOLDS


def train(docs: DataFrame, labels: DataFrame, categories: list[str], texts: int = TRAIN_TEXTS) -> list[Link]:
    """The chain for 0/1 columns of labels (with doc_id), in that order.

    Rows without an id or a label of some category teach nothing; of several
    rows for an id the largest labels count; a category of which the sample
    has one value only is predicted as constant.  The sample, which goes to
    the driver, is bounded in texts and in bytes; rows of one id with the same
    words teach once, so empty ones, which have no bytes, are one.  Texts of the same words are
    in one fold, so an out-of-fold probability never comes from a copy.
    """
    import pyarrow as pa

    rows = labels.where("doc_id is not null").select(F.col("doc_id").cast("long"), *[F.col(c).cast("int") for c in categories]).dropna()
    rows = rows.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    share = texts / max(1, rows.count())
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = F.broadcast(rows.where(draw < F.lit(float(share))))  # about `texts` rows, whatever the input

    def words(batches):
        for b in bounded(batches):
            raw = [s.tobytes() for s in _word_sets(text_bytes(b.column("text")))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary()), *[b.column(c) for c in categories]], ["doc_id", "words", *categories])

    joined = lean(docs).select(F.col("doc_id").cast("long"), "text").join(sample, "doc_id").select("doc_id", "text", *categories)
    joined = joined.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    size = joined.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > TRAIN_BYTES:
        draw = F.pmod(F.xxhash64(F.lit("bytes"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        joined = joined.where(draw < F.lit(TRAIN_BYTES / size))
    table = joined.mapInArrow(words, "doc_id long, words binary, " + ", ".join(f"{c} int" for c in categories)).distinct().toArrow()
    raw, ids = table["words"].to_pylist(), table["doc_id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], raw[i]))
    sets = [np.frombuffer(raw[i], np.uint64) for i in order]
    y = np.column_stack([np.asarray(table[c])[order] for c in categories]).astype(float) if len(order) else np.zeros((0, len(categories)))
    fold = np.array([_fold(s) for s in sets], np.int64)
    links, earlier = [], np.zeros((len(sets), 0))
    for k, category in enumerate(categories):
        links.append(_fit(category, sets, earlier, y[:, k]))
        if k + 1 < len(categories):
            out = np.zeros(len(sets))
            for f in range(FOLDS):
                rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                link = _fit(category, [sets[i] for i in rest], earlier[rest], y[rest, k])
                if len(own):
                    held = [sets[i] for i in own]
                    out[own] = _apply(link, np.concatenate(held), np.repeat(np.arange(len(own)), [len(s) for s in held]), len(own), earlier[own])
            earlier = np.column_stack([earlier, out])
    return links


def predict(docs: DataFrame, links: list[Link], threshold: float = THRESHOLD) -> DataFrame:
    """docs with p_<category> and is_<category> of each link.

    Null and empty texts have no words: their probabilities are those of a
    text of unknown words.  Repeated rows are judged alike.  Columns of docs
    with the names of the new ones are replaced.
    """
    import pyarrow as pa
    from pyspark.sql.types import BooleanType, DoubleType, StructType

    made = [f"p_{k.category}" for k in links] + [f"is_{k.category}" for k in links]
    own = lean(docs).drop(*made)
    plain = [(k.category, k.words, k.weights, k.earlier, k.bias) for k in links]
    model = docs.sparkSession.sparkContext.broadcast(plain)
    schema = StructType([*own.schema.fields])
    for i, name in enumerate(made):
        schema = schema.add(name, DoubleType() if i < len(links) else BooleanType())

    def judge(batches):
        chain = [Link(*k) for k in model.value]
        for b in bounded(batches):
            p = _predict(chain, _word_sets(text_bytes(b.column("text"))))
            columns = [pa.array(p[:, k]) for k in range(len(chain))] + [pa.array(p[:, k] >= threshold) for k in range(len(chain))]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *made])

    return own.mapInArrow(judge, schema)
