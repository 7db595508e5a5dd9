"""The trained operators, step by step, against slow plain versions."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import langid, mixing, quality

M = 1 << 64


def slow_grams(text):
    """Hashed n-grams of one to three code points, one after the other."""
    out = Counter()
    points = [ord(c) for c in text.lower()]
    for width in (1, 2, 3):
        for at in range(len(points) - width + 1):
            h = points[at]
            for p in points[at + 1 : at + width]:
                h = (h * 0x9E3779B97F4A7C15 + p) % M
            out[(h + width) * 0xD6E8FEB86659FD93 % M >> 49] += 1
    return out


def test_grams_and_features(monkeypatch):
    texts = ["The cat sat.", "ÀÉ ß", "aaaa", "x", "Der Hund läuft weit weg " * 9]
    idf = np.linspace(1, 3, langid.DIMENSIONS)
    for stretch in (1 << 18, 7):  # long texts are counted in stretches
        monkeypatch.setattr(langid, "STRETCH", stretch)
        for t in texts:
            want = slow_grams(t)
            got = langid.counts(t)
            assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == dict(want)
            at, x = langid.features(t, idf)
            plain = {k: (1 + math.log(n)) * idf[k] for k, n in want.items()}
            norm = math.sqrt(sum(v * v for v in plain.values()))
            assert all(abs(v - plain[int(k)] / norm) < 1e-12 for k, v in zip(at, x, strict=True))


def test_document_frequencies_count_labelled_rows_only(spark):
    rows = [(1, "ab", "en"), (2, "b", "en"), (3, "abab", "de"), (4, "zz", None), (5, None, "en")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = Counter(g for t in ("ab", "b", "abab") for g in set(slow_grams(t)))
    idf = [math.log(4 / (1 + want.get(k, 0))) + 1 for k in range(langid.DIMENSIONS)]
    assert np.allclose(model.idf, idf)


def test_weights_follow_the_regularised_leader():
    draw = random.Random(3)
    rows = []
    for _ in range(25):
        at = sorted(draw.sample(range(40), 6))
        rows.append((np.array(at), np.array([draw.random() for _ in at]), draw.randrange(3)))
    got, bias = langid.learn_weights(rows, 3)
    z = [[0.0] * 3 for _ in range(41)]
    n = [[0.0] * 3 for _ in range(41)]

    def weight(i, k):
        if abs(z[i][k]) <= langid.L1:
            return 0.0
        return -(z[i][k] - math.copysign(langid.L1, z[i][k])) / ((langid.BETA + math.sqrt(n[i][k])) / langid.ALPHA + langid.L2)

    for _ in range(langid.EPOCHS):
        for at, x, label in rows:
            cells = [*zip(at.tolist(), x.tolist()), (40, 1.0)]  # the bias stands last
            w = {(i, k): weight(i, k) for i, _ in cells for k in range(3)}
            logits = [sum(v * w[i, k] for i, v in cells) for k in range(3)]
            e = [math.exp(v - max(logits)) for v in logits]
            for i, v in cells:
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == label))
                    z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / langid.ALPHA * w[i, k]
                    n[i][k] += g * g
    assert np.allclose(got[:40], [[weight(i, k) for k in range(3)] for i in range(40)]) and not got[40:].any()
    assert np.allclose(bias, [weight(40, k) for k in range(3)])


def test_temperatures_are_the_best_of_a_fine_grid():
    rng = np.random.default_rng(2)
    logits, labels = rng.normal(size=(300, 4)) * 6, rng.integers(0, 4, 300)
    labels[:200] = logits[:200].argmax(1)
    loss = lambda t: -np.log(langid.softmax(logits / t)[np.arange(300), labels] + 1e-12).mean()
    best = min(loss(t) for t in np.exp(np.linspace(math.log(0.02), math.log(20), 4000)))
    assert loss(langid.fit_temperature(logits, labels)) <= best + 1e-6


def slow_vectors(texts):
    """Sums of the index vectors around every occurrence, pair by pair."""
    places, signs = quality.index_vectors()
    out = np.zeros((quality.ENTRIES, quality.SIZE))
    for t in texts:
        words, shapes = quality.entries(t)
        for i in range(len(words)):
            for j in range(max(0, i - quality.REACH), min(len(words), i + quality.REACH + 1)):
                if i != j:
                    for own, near in ((words[i], words[j]), (shapes[i], shapes[j])):
                        for k in range(quality.SIGNS):
                            out[own, places[near, k]] += signs[near, k]
    return out


TEXTS = ["The cat sat on the mat, the cat!", "buy buy buy now NOW 123", "one", "", None, "wörd " * 40 + "tail 7", "The end of it all."]


def test_word_vectors_and_partitions(spark):
    sums = slow_vectors(TEXTS)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    want = (sums / np.where(norm > 0, norm, 1)).astype(np.float32)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    for parts in (1, 7):
        assert (quality.word_vectors(df.repartition(parts)) == want).all()


def test_contexts_do_not_end_where_stretches_do():
    places, signs = quality.index_vectors()
    words, shapes = quality.entries(" ".join(f"w{k % 13}" for k in range(400)))
    doc = np.repeat([0, 1], 200)
    totals = []
    for stretch in (400, 1, 3, 37):
        total = np.zeros(quality.ENTRIES * quality.SIZE)
        for at in range(0, 400, stretch):
            part = slice(at, at + stretch + quality.REACH)
            quality.contexts(words[part], shapes[part], doc[part], places, signs, total, stretch)
        totals.append(total)
    assert all((t == totals[0]).all() for t in totals) and totals[0].any()


def test_whole_words_have_shapes():
    a, b = b"ab-" * 40 + b"7", b"ab-" * 40 + b"x"
    assert quality.shape_of(a) != quality.shape_of(b)


def test_pooled_and_scored():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(quality.ENTRIES, quality.SIZE)).astype(np.float32)
    net = quality.Network(2 * quality.SIZE)
    net.mean, net.scale, net.temperature = rng.normal(size=128), rng.random(128) + 0.5, 1.7
    for t in TEXTS:
        words, shapes = quality.entries(t)
        want = [sum((float(vectors[w, k]) for w in at), 0.0) / max(1, len(words)) for at in (words, shapes) for k in range(quality.SIZE)]
        x = quality.pooled(t, vectors)
        assert np.allclose(x, want, atol=1e-5)
        hidden = [max(0.0, sum((x[i] - net.mean[i]) / net.scale[i] * net.w[0][i, h] for i in range(128)) + net.w[1][h]) for h in range(quality.HIDDEN)]
        logit = sum(v * w for v, w in zip(hidden, net.w[2], strict=True)) + net.w[3][0]
        assert abs(net.score(x[None])[0] - 1 / (1 + math.exp(-logit / net.temperature))) < 1e-9


def test_scores_under_one_and_many_partitions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    found = []
    for parts in (1, 13):
        df = docs.repartition(parts)
        found.append({r.doc_id: r.score for r in quality.score(df, quality.fit(df, labels, F.lit(True))).collect()})
    assert found[0].keys() == found[1].keys() and all(abs(found[0][k] - found[1][k]) < 1e-9 for k in found[0])


def test_rates_against_a_plain_projected_gradient(spark):
    """Small steps over documents, one by one, end at the rates that the operator finds over distinct posteriors."""
    draw = random.Random(6)
    p = []
    for _ in range(60):
        x = [draw.random() ** 3 for _ in range(3)]
        p.append([round(1000 * v / sum(x)) for v in x])
    n = [draw.randrange(1, 200) for _ in p]
    found = spark.createDataFrame([(a, b) for a, b in zip(p, n, strict=True)] * 2, "posterior array<int>, n_tokens long")
    domains, aim = [(c, 1 / 3) for c in "abc"], {"a": 0.5, "b": 0.3, "c": 0.2}
    for lowest in (0.0, 0.6):
        steps, _ = mixing.fit_rates(found, domains, aim, lowest)
        rates = [r[0] for r in spark.createDataFrame([(x,) for x in p], "posterior array<int>").select(mixing.rate_of("posterior", steps, lowest)).collect()]
        q, w = np.array(p) / 1000, np.array(n) / sum(n)
        target, g = np.array([0.5, 0.3, 0.2]), np.zeros(3)
        for _ in range(60_000):
            r = np.maximum(lowest, 1 - q @ g)
            g -= 0.5 * (target - (w * r) @ q)
        assert np.abs((w * r) @ q - target).max() < 2e-3
        assert np.abs(r - np.array(rates)).max() < 0.02


def test_posteriors_against_plain_bayes(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat the dog", "en"), ("der hund und der bär", "de"), ("le chat", "fr"), ("the end", "en")] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    domains, table = mixing.classifier(df, "text", "lang", "doc_id", rows=10**6)
    counts = {d: Counter(w for _, t, x in rows if x == d for w in t.split()) for d, _ in domains}
    known = set().union(*counts.values())
    texts = ["the hund", "le le le chat", "", "new words", "der " * 500]
    got = {r.doc_id: r for r in mixing.posteriors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), domains, table, "text", "doc_id").collect()}
    for k, t in enumerate(texts):
        seen = [w for w in t.split() if w in known]
        weight = min(1.0, mixing.EVIDENCE / max(1, len(seen)))
        s = [math.log(share) + weight * sum(math.log((counts[d][w] + 0.5) / (counts[d].total() + 0.5 * 1500)) for w in seen) for d, share in domains]
        e = [math.exp(v - max(s)) for v in s]
        assert all(abs(a - 1000 * b / sum(e)) <= 1 for a, b in zip(got[k].posterior, e, strict=True)) and got[k].n_tokens == len(t.split())
