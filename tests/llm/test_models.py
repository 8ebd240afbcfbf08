"""Language identification, toxicity and language-model scores."""

import math
import random
import zlib
from collections import Counter

import fixtures as fx
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmark.llm import langid, lmscore, toxicity


def test_held_out_rows_are_those_of_the_checksum(spark):
    got = {r.id: r.h for r in spark.range(200).select("id", langid.held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)}


def test_language_accuracy_on_held_out_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = langid.identify(docs, langid.trained_on_rest(docs)).withColumn("h", langid.held_out()).where("h")
    n, right, low, high = found.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred")), F.min("score"), F.max("score")).first()
    assert right >= 0.97 * n and 0 <= low <= high <= 1


def test_a_mixture_gets_its_languages_and_shares(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    langs, log_p = langid.trained_on_rest(docs)
    best = {r.lang: r.text for r in docs.where("lang in ('de', 'es') and n_chars between 1500 and 4000").groupBy("lang").agg(F.max("text").alias("text")).collect()}
    text = (best["de"][:1500] + " " + best["es"][:1500]).encode()
    shares = {langs[k]: v for k, v in langid.infer(log_p, *langid._cells(text)).items()}
    assert set(shares) == {"de", "es"} and min(shares.values()) > 0.3 and sum(shares.values()) == pytest.approx(1)


def test_language_of_hard_cases(spark):
    docs = fx.docs(spark, clash=True)
    found = langid.identify(docs, langid.trained_on_rest(docs)).collect()
    assert len(found) == len(fx.rows())
    for r in found:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    empty = fx.empty(spark)
    assert langid.identify(empty, langid.trained_on_rest(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, ([], np.zeros((0, 1 << langid.BITS)))).collect()} == {"und"}


def brute_mixture(log_p, cells, n, penalty):
    """Of all sets of languages the one of the largest converged likelihood less the penalty for each language, and its shares."""
    from itertools import combinations

    p, best = np.exp(log_p[:, cells]), None
    for size in range(1, len(p) + 1):
        for chosen in combinations(range(len(p)), size):
            share = np.full(size, 1.0 / size)
            for _ in range(2000):
                both = share[:, None] * p[list(chosen)]
                share = (both / both.sum(axis=0)) @ n
                share /= share.sum()
            value = float(n @ np.log(share @ p[list(chosen)])) - penalty * n.sum() * size
            if best is None or value > best[0]:
                best = (value, dict(zip(chosen, share, strict=True)))
    return best[1]


@pytest.mark.parametrize("seed", range(6))
def test_mixtures_against_all_sets_of_languages(seed):
    """Texts of one to three of four languages: the set and the shares are those of enumeration with converged steps."""
    rng = np.random.default_rng(seed)
    table = rng.dirichlet(np.full(60, 0.15), 4) + 1e-4
    log_p = np.log(table / table.sum(axis=1, keepdims=True))
    for parts in ([1.0], [0.6, 0.4], [0.4, 0.35, 0.25], [0.97, 0.03]):
        mixed = sum(w * np.exp(log_p[k]) for k, w in enumerate(parts))
        counts = rng.multinomial(3000, mixed / mixed.sum())
        at = np.flatnonzero(counts)
        want = brute_mixture(log_p, at, counts[at].astype(float), langid.PENALTY)
        got = langid.infer(log_p, at, counts[at].astype(float))
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 0.02 for k in want)


def test_more_languages_than_the_model_has_cells_for(spark, monkeypatch):
    """The cells get coarser; every language is still learned."""
    monkeypatch.setattr(langid, "MODEL_CELLS", 40 << 10)
    rows = [(100 * k + j, " ".join(fx.words(1000 * k + j, 40, 9)).replace("w", f"q{k}x{chr(97 + k % 26) * 3}"), f"l{k:02d}") for k in range(60) for j in range(6)]
    rows = [(i, "".join(chr(97 + int(c)) if c.isdigit() else c for c in t), lang) for i, t, lang in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, log_p = langid.trained_on_rest(docs)
    assert len(langs) == 60 and log_p.shape[1] < 1 << langid.BITS and log_p.size <= 40 << 10
    n, right = langid.identify(docs, (langs, log_p)).agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert right >= 0.9 * n


def plain_link(sets, earlier, y):
    """A logistic regression over all chosen words by plain gradient descent to convergence, weights for (words, earlier, bias)."""
    words = sorted({int(w) for s in sets for w in s})
    x = np.array([[float(w in set(map(int, s))) for w in words] + list(e) + [1.0] for s, e in zip(sets, earlier, strict=True)])
    ridge = np.array([1.0] * (x.shape[1] - 1) + [0.0]) * toxicity.RIDGE / len(y)
    weights = np.zeros(x.shape[1])
    for _ in range(40):  # Newton's steps
        p = 1 / (1 + np.exp(-x @ weights))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge + 1e-9)
        weights -= np.linalg.solve(hessian, x.T @ (p - y) / len(y) + ridge * weights)
    return 1 / (1 + np.exp(-x @ weights))


def test_a_link_of_the_chain_against_plain_regression(monkeypatch):
    """Enough steps of the fit reach the probabilities of a converged regression on the same words and earlier categories."""
    monkeypatch.setattr(toxicity, "STEPS", 20_000)
    monkeypatch.setattr(toxicity, "LEAST_FAR", 0.0)
    rng = np.random.default_rng(4)
    words = np.sort(rng.integers(1, 1 << 60, 6).astype(np.uint64))
    sets = [words[rng.random(6) < 0.4] for _ in range(400)]
    earlier = rng.random((400, 1))
    signal = np.array([2.0 * (words[0] in s) - 1.5 * (words[3] in s) for s in sets]) + 2 * earlier[:, 0] - 1
    y = (rng.random(400) < 1 / (1 + np.exp(-signal))).astype(float)
    link = toxicity._fit("c", sets, earlier, y)
    text = np.repeat(np.arange(400), [len(s) for s in sets])
    got = toxicity._apply(link, np.concatenate(sets), text, 400, earlier)
    assert np.abs(got - plain_link(sets, earlier, y)).max() < 0.02


def test_copies_are_in_one_fold_and_training_is_bounded_in_bytes(spark, monkeypatch):
    sets = toxicity._word_sets([b"one two", b"two one  one", b"three", b""])
    assert toxicity._fold(sets[0]) == toxicity._fold(sets[1])
    rows = [(i, f"text {i} " + ("scum" if i % 2 else "fine") + " filler" * 50) for i in range(300)] + [(300, "x " * (1 << 20)), (1, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(301)], "doc_id long, toxic int")
    once = toxicity.train(docs, labels, ["toxic"])
    again = toxicity.train(docs.orderBy(F.desc("text")), labels, ["toxic"])
    assert (once[0].words == again[0].words).all() and np.allclose(once[0].weights, again[0].weights)
    seen, fit = [], toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda c, sets, e, y: seen.append(len(sets)) or fit(c, sets, e, y))
    toxicity.train(docs, labels, ["toxic"])
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 30_000)
    toxicity.train(docs, labels, ["toxic"])
    assert seen[0] == 301 and 30 <= seen[1] <= 150


def test_toxicity_on_texts_it_has_not_seen(spark):
    rng, rows, labels = random.Random(1), [], []
    for i in range(900):
        w = fx.words(i, rng.randrange(20, 200), 2000)
        rude, bad = rng.random() < 0.3, rng.random() < 0.2
        if rude:
            w[rng.randrange(len(w))] = rng.choice(["scum", "idiot"])
        if rude and rng.random() < 0.5:
            w[rng.randrange(len(w))] = "threat"
        rows.append((i, " ".join(w), "junk" if bad else None))
        labels.append((i, int(rude), int("threat" in w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, is_toxic string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int, severe int")
    links = toxicity.train(docs, table.where("doc_id < 700"), ["toxic", "severe"])
    assert links[1].earlier.shape == (1,) and abs(links[1].earlier[0]) > 0
    got = toxicity.predict(docs, links).where("doc_id >= 700").join(table, "doc_id").collect()
    assert sum(r.is_toxic == bool(r.toxic) for r in got) >= 0.97 * len(got)
    assert sum(r.is_severe == bool(r.severe) for r in got) >= 0.95 * len(got)


def test_toxicity_on_hard_cases(spark):
    docs = fx.docs(spark, clash=True)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (15, 0)], "doc_id long, toxic int")
    found = toxicity.predict(docs, toxicity.train(docs, labels, ["toxic"])).collect()
    assert len(found) == len(fx.rows()) and all(0 <= r.p_toxic <= 1 for r in found)
    none = toxicity.train(docs, labels.where("false"), ["toxic"])
    assert len({r.p_toxic for r in toxicity.predict(docs, none).collect()}) == 1
    assert toxicity.predict(fx.empty(spark), none).count() == 0


def brute_scores(rows, role, min_count, prior):
    """The losses with plain counters; role: 1 target, 2 background."""
    texts = {i: [w for w in fx.plain(fx.lower(t))] for i, t in rows}
    totals = [Counter(), Counter()]
    for i, w in texts.items():
        if role.get(i):
            totals[role[i] - 1].update(w)
    vocabulary = {w for w in {*totals[0], *totals[1]} if totals[0][w] + totals[1][w] >= min_count}
    seq = {i: ["<s>", *[w if w in vocabulary else "<unk>" for w in ws], "</s>"] for i, ws in texts.items()}
    pairs, lefts, rights = ([Counter(), Counter()] for _ in range(3))
    for i, s in seq.items():
        if role.get(i):
            k = role[i] - 1
            pairs[k].update(zip(s, s[1:], strict=False))
            lefts[k].update(s[:-1])
            rights[k].update(s[1:])
    out = {}
    for i, s in seq.items():
        n, losses = len(s) - 1, []
        for k in (0, 1):
            own = role.get(i) == k + 1
            p, a, b = Counter(zip(s, s[1:], strict=False)), Counter(s[:-1]), Counter(s[1:])
            total = sum(rights[k].values()) - n * own + len(vocabulary) + 2
            loss = 0.0
            for v, w in zip(s, s[1:], strict=False):
                unigram = (rights[k][w] - b[w] * own + 1) / total
                loss -= math.log((pairs[k][v, w] - p[v, w] * own + prior * unigram) / (lefts[k][v] - a[v] * own + prior))
            losses.append(loss / n)
        out[i] = (n - 1, *losses, losses[0] - losses[1]) if n > 1 else (0, None, None, None)
    return out


def test_scores_against_plain_counters(spark):
    rows = [(i, " ".join(fx.words(i % 7, 30 + i, 60))) for i in range(40)] + [(50, None), (51, "  "), (52, "new words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    targets = spark.createDataFrame([(i,) for i in range(0, 40, 3)] + [(None,), (999,)], "doc_id long")
    share = 14 / (len(rows) - 14)
    draw = F.pmod(F.xxhash64(F.lit("background"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = {r.doc_id for r in docs.where(draw < F.lit(share)).collect()}
    role = {i: 1 if i < 40 and i % 3 == 0 else 2 if i in drawn else 0 for i, _ in rows}
    want = brute_scores(rows, role, lmscore.MIN_COUNT, lmscore.PRIOR)
    got = {r.doc_id: tuple(r)[1:] for r in lmscore.score(docs, targets).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i])


def test_scores_of_hard_cases(spark):
    targets = spark.createDataFrame([(1,), (2,), (15,)], "doc_id long")
    got = lmscore.score(fx.docs(spark, clash=True), targets).collect()
    assert len(got) == len(fx.rows()) and all((r.score is None) == (r.n_tokens == 0) for r in got)
    assert lmscore.score(fx.docs(spark), targets.where("false")).count() == len(fx.rows())
    assert lmscore.score(fx.empty(spark), targets).count() == 0


def plain_grams(text: str) -> Counter:
    """The hashed n-grams of a text, byte by byte."""
    low = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
    data, found = b" " + b" ".join(low.split()) + b" ", Counter()
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            code = 0
            for c in data[i : i + n]:
                code = (code * 257 + c) % 2**32
            found[(code * 2654435761) % 2**32 >> 18] += 1
    return found


def test_language_identification_end_to_end(spark):
    """Learned and inferred in plain Python from the same rows: held-out rows teach nothing, languages and shares agree."""
    pools = {"aa": "abc", "bb": "def", "cc": "ghi"}
    rng = random.Random(3)
    word = lambda lang: "".join(rng.choice(pools[lang]) for _ in range(rng.randrange(2, 7)))
    rows = []
    for i in range(90):
        lang = rng.choice(list(pools))
        own = [word(lang) for _ in range(30)] + ([word(rng.choice(list(pools))) for _ in range(20)] if i % 3 == 0 else [])
        rows.append((i, " ".join(own), lang if i % 11 else None))
    rows += [(200, None, "aa"), (201, "12 34", "bb"), (202, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, langid.trained_on_rest(docs)).collect()}
    counts = {lang: Counter() for lang in pools}
    for i, text, lang in rows:
        if lang and text and any(c.isalpha() for c in text) and zlib.crc32(str(i).encode()) % 3 != 1:
            counts[lang].update(plain_grams(text))
    langs = sorted(pools)
    table = np.array([[counts[lang][c] + langid.SMOOTHING for c in range(1 << 14)] for lang in langs])
    log_p = np.log(table / table.sum(axis=1, keepdims=True))
    mixed = 0
    for i, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score, got[i].languages) == ("und", 0.0, {})
            continue
        grams = plain_grams(text)
        at = np.array(sorted(grams))
        want = brute_mixture(log_p, at, np.array([float(grams[c]) for c in at]), langid.PENALTY)
        want = {langs[k]: v for k, v in want.items()}
        assert set(got[i].languages) == set(want)
        assert all(abs(got[i].languages[k] - v) < 0.03 for k, v in want.items())
        best = max(want, key=lambda k: want[k])
        assert got[i].lang_pred == best or abs(want[got[i].lang_pred] - want[best]) < 0.05
        mixed += len(want) > 1
    assert mixed > 5


def test_the_chain_end_to_end_against_plain_python(spark):
    """Both categories from rows: out-of-fold probabilities of the first feed the second; every probability agrees."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(260):
        bad, rude = rng.random() < 0.4, rng.random() < 0.3
        own = [f"w{rng.randrange(30)}" for _ in range(12)] + ["awful"] * (bad and rng.random() < 0.9) + ["Scum!"] * (rude and rng.random() < 0.8)
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad), int(bad and rude or rng.random() < 0.05)))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, unfit int, toxic int")
    got = {r.doc_id: (r.p_unfit, r.p_toxic) for r in toxicity.predict(docs, toxicity.train(docs, table, ["unfit", "toxic"])).collect()}

    words = [{w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()} for _, t in rows]
    hashed = toxicity._word_sets([t.encode() for _, t in rows])
    folds = [toxicity._fold(s) for s in hashed]

    def fit(sets, earlier, y):
        n, base = len(y), (sum(y) + 0.5) / (len(y) + 1)
        seen, positive = Counter(w for s in sets for w in s), Counter(w for s, v in zip(sets, y, strict=True) if v for w in s)
        chosen = [w for w in seen if seen[w] >= toxicity.MIN_TEXTS and abs(positive[w] - seen[w] * base) / math.sqrt(seen[w] * base * (1 - base) + 1) >= toxicity.LEAST_FAR]
        x = np.array([[float(w in s) for w in chosen] + list(e) + [1.0] for s, e in zip(sets, earlier, strict=True)])
        weights = np.zeros(x.shape[1])
        weights[-1] = math.log(base / (1 - base))
        ridge, size = np.array([1.0] * (x.shape[1] - 1) + [0.0]) * toxicity.RIDGE / n, np.full(x.shape[1], 1e-6)
        for _ in range(toxicity.STEPS):
            grad = x.T @ (1 / (1 + np.exp(-x @ weights)) - np.array(y)) / n + ridge * weights
            size += grad**2
            weights -= toxicity.RATE * grad / np.sqrt(size)
        return lambda s, e: 1 / (1 + math.exp(-(sum(w * (c in s) for w, c in zip(weights, chosen, strict=False)) + float(np.dot(weights[len(chosen) : -1], e)) + weights[-1])))

    unfit, toxic = [r[1] for r in labels], [r[2] for r in labels]
    none = [[]] * len(rows)
    first, out = fit(words, none, unfit), [0.0] * len(rows)
    for f in range(toxicity.FOLDS):
        rest = [i for i in range(len(rows)) if folds[i] != f]
        held = fit([words[i] for i in rest], [[]] * len(rest), [unfit[i] for i in rest])
        for i in range(len(rows)):
            if folds[i] == f:
                out[i] = held(words[i], [])
    second = fit(words, [[p] for p in out], toxic)
    assert any(abs(out[i] - first(words[i], [])) > 1e-3 for i in range(len(rows)))
    for i in range(len(rows)):
        p = first(words[i], [])
        assert got[i] == pytest.approx((p, second(words[i], [p])), abs=1e-6)
