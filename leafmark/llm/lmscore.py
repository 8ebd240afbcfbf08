"""Cross-entropy difference scores from matched n-gram models.

Two bigram models, of target documents and of a background of about as many
other documents, share one vocabulary.  A document's score is its loss under
the target model less its loss under the background model, a token; lower is
nearer to the target.  A document's own counts are left out of the model that
has them.

Counts are over whole texts of all chosen documents; every bigram of the
corpus is asked for and answered by its counts (see exchange), so neither
model is ever in one place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm import exchange as ex
from leafmark.llm.words import LOWER, Words, mix, places, text_bytes

#: Words that both models together have so often are in the vocabulary; all others are one unknown word.
MIN_COUNT = 2
#: The weight of the unigram model against a context's counts.
PRIOR = 20.0
RESULT = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"

_MARKS = mix(np.array([101, 202, 303], np.uint64))
_UNKNOWN, _BEGIN, _END = _MARKS


class _Chunk:
    """The documents of a chunk in order, with the models that each belongs to (0 none, 1 target, 2 background)."""

    def __init__(self, table, told):
        role = {}
        for block, answer in zip(told["block"].to_pylist(), told["answer"].to_pylist(), strict=True):
            if block < 0:
                role[int.from_bytes(answer[:8], "little", signed=True)] = answer[8]
        ids, texts = table["doc_id"].to_pylist(), text_bytes(table["text"])
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or b""))
        self.ids = [ids[i] for i in order]
        self.role = np.array([role.get(i, 0) for i in self.ids], np.int8)
        words = Words([texts[i] for i in order], LOWER)
        self.words, self.first, self.text = words.hashes(), words.first, words.text_of()
        self.known, self.place = places(self.words)

    def counts(self, place: np.ndarray, n: int, text: np.ndarray) -> list[np.ndarray]:
        role = self.role[text]
        return [np.bincount(place[role == k], minlength=n) for k in (1, 2)]

    def events(self, in_vocabulary: np.ndarray):
        """(context, word, text) of all bigrams, begin and end marks included, unknown words as one."""
        words = np.where(in_vocabulary[self.place], self.words, _UNKNOWN)
        left, right = np.insert(words, self.first[:-1], _BEGIN), np.insert(words, self.first[1:], _END)
        text = np.repeat(np.arange(len(self.ids)), np.diff(self.first) + 1)
        return left, right, text


class _Counts(ex.Reduction):
    """Counts of each key in the two models; all are told the sums."""

    values, told = "uu", "uu"


class _WordCounts(_Counts):
    """The same for words; a block also says how many words it counts, and of them those that are too rare."""

    def __init__(self, min_count: int):
        super().__init__()
        self.min_count = min_count

    def also(self, keys, values):
        a, b = values
        rare = a + b < self.min_count
        return np.array([a.sum(), b.sum(), (~rare).sum(), a[rare].sum(), b[rare].sum()], np.int64).tobytes()


def _own(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often each event's place occurs in its own text."""
    key = text.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)
    distinct, at = places(key)
    return np.bincount(at, minlength=len(distinct))[at]


def score(docs: DataFrame, targets: DataFrame, min_count: int = MIN_COUNT, prior: float = PRIOR) -> DataFrame:
    """One row a document: doc_id, n_tokens (words), loss_target, loss_background, score.

    targets: the doc_ids of the target documents.  As many others, by a hash
    of the id, are the background (all others, if there are fewer).  Null and
    empty texts and texts without words have 0 tokens and null losses and
    score.  Rows that repeat an id belong to the same models; rows without an
    id belong to none.  Without target documents the target model is uniform.
    Other columns are ignored.
    """
    import pyarrow as pa

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    targets = targets.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    plan = ex.plan_chunks(docs)
    ids = docs.where("doc_id is not null").select("doc_id").distinct().join(targets.withColumn("target", F.lit(True)), "doc_id", "left")
    n_target, n_rest = ids.agg(F.count("target"), F.count("*") - F.count("target")).first()
    share = n_target / n_rest if n_rest else 0.0
    draw = F.pmod(F.xxhash64(F.lit("background"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    roles = ids.withColumn("role", F.when(F.col("target"), F.lit(1)).when(draw < F.lit(share), F.lit(2))).where("role is not null")

    def packed(batches):
        for b in batches:
            both = [i.to_bytes(8, "little", signed=True) + bytes([r]) for i, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([-1] * len(both), pa.int64()), pa.array(both, pa.binary())], ["chunk", "block", "answer"])

    mine = roles.select(ex.chunk_of(plan).alias("chunk"), "doc_id", "role").mapInArrow(packed, ex.ANSWER)
    texts = ex.deal(docs, plan, "doc_id", "text")

    word_counts, pair_counts = _WordCounts(min_count), _Counts()

    def ask_words(table, told):
        if not table.num_rows:
            return ex.asks([])
        chunk = _Chunk(table, told)
        return ex.asks(word_counts.ask(plan, table["chunk"][0].as_py(), chunk.known, chunk.counts(chunk.place, len(chunk.known), chunk.text)))

    words = word_counts.resolve(ex.told(texts, mine, ask_words, ex.ASK), plan)

    def opened(batches):
        for b in batches:
            each = np.array([np.frombuffer(x, np.int64) for x in b.column("answer").to_pylist()], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in each.T], list("abcde"))

    # the totals of the blocks are summed and told to each chunk
    sums = words.where("chunk = -1").select("answer").mapInArrow(opened, "a long, b long, c long, d long, e long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "abcde"])
    line = F.encode(F.concat_ws(",", *[F.col(c).cast("string") for c in "abcde"]), "utf-8")
    total = sums.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(plan.chunks - 1).cast("long"))).alias("chunk"), F.lit(-2).cast("long").alias("block"), line.alias("answer"))
    first = mine.unionAll(words.where("chunk >= 0").select("chunk", "block", "answer")).unionAll(total)

    def prepared(table, told):
        chunk, got = _Chunk(table, told), ex.by_block(told)
        word = [w.astype(np.int64) for w in word_counts.read(plan, got, chunk.known)]
        return chunk, got, word, word[0] + word[1] >= min_count

    def ask_bigrams(table, told):
        if not table.num_rows:
            return ex.asks([])
        chunk, _, _, frequent = prepared(table, told)
        left, right, text = chunk.events(frequent)
        keys, place = places(mix(left * np.uint64(0x9E3779B97F4A7C15) + mix(right)))
        return ex.asks(pair_counts.ask(plan, table["chunk"][0].as_py(), keys, chunk.counts(place, len(keys), text)))

    bigrams = pair_counts.resolve(ex.told(texts, first, ask_bigrams, ex.ASK), plan)
    second = first.unionAll(bigrams.selectExpr("chunk", f"block + {plan.fan} as block", "answer"))

    def losses(table, told):
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), *[pa.float64()] * 3)], ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])
        chunk, got, word, frequent = prepared(table, told)
        total = [int(x) for x in got[-2].decode().split(",")]
        vocabulary = total[2] + 2  # and the unknown word and the end
        left, right, text = chunk.events(frequent)
        keys, place = places(mix(left * np.uint64(0x9E3779B97F4A7C15) + mix(right)))
        pair = [c.astype(np.int64)[place] for c in pair_counts.read(plan, got, keys, offset=plan.fan)]
        own_pair = _own(text, place)
        # the counts of each event's context and word in each model
        symbols, at = places(np.concatenate([left, right]))
        a, b = at[: len(left)], at[len(left) :]
        own_left, own_right = _own(text, a), _own(text, b)
        found = np.searchsorted(symbols, chunk.known[frequent])
        roles, n = chunk.role[text], np.diff(chunk.first)
        loss = []
        for k in (0, 1):
            count = np.zeros(len(symbols), np.int64)
            if len(found):
                there = np.minimum(found, len(symbols) - 1)
                hit = symbols[there] == chunk.known[frequent]
                count[there[hit]] = word[k][frequent][hit]
            documents = (n_target, n_background)[k]
            for mark, value in ((_UNKNOWN, total[3 + k]), (_BEGIN, documents), (_END, documents)):
                spot = np.searchsorted(symbols, mark)
                if spot < len(symbols) and symbols[spot] == mark:
                    count[spot] = value
            inside = (roles == k + 1).astype(np.int64)
            own_events = (n + 1)[text] * inside
            c_pair, c_left, c_right = pair[k] - own_pair * inside, count[a] - own_left * inside, count[b] - own_right * inside
            unigram = (c_right + 1.0) / (total[k] + documents - own_events + vocabulary)
            loss.append(np.bincount(text, weights=-np.log((c_pair + prior * unigram) / (c_left + prior)), minlength=len(n)) / (n + 1))
        some = n > 0
        columns = [
            pa.array(chunk.ids, pa.int64()),
            pa.array(n, pa.int64()),
            *[pa.array(x, pa.float64(), mask=~some) for x in (loss[0], loss[1], loss[0] - loss[1])],
        ]
        return pa.table(columns, ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    n_background = roles.where("role = 2").count()
    return ex.told(texts, second, losses, RESULT)
