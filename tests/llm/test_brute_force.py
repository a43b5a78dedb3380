"""The scores of toxicity, quality and language recomputed in plain Python; odd rows of the scoring operators."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from opinionmill.llm import langid, quality, toxicity
from opinionmill.llm.ngrams import _AGAIN
from opinionmill.llm.textbatch import _BASE, _BYTE_CODES

M32, M64 = (1 << 32) - 1, (1 << 64) - 1
WORDS = "the river ran under an old stone bridge while seven quiet people watched it go by in the rain über naïve 中文".split()
RUDE = "rotten scoundrel vermin".split()


def sentence(r, rude):
    found = list(r.choice(WORDS, int(r.integers(3, 9)))) + (list(r.choice(RUDE, 2)) if rude else [])
    return " ".join(found) + str(r.choice([".", "!!", " 12", ""]))


def make(spark, n=60):
    r = np.random.default_rng(12)
    rows = [(i, sentence(r, i % 3 == 0), int((i % 3 == 0) ^ (i % 17 == 0))) for i in range(n)]
    rows += [(500, "", 0), (501, None, 1), (502, "A  b\t\nÉ", 0), (503, rows[0][1], rows[0][2])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, label int")


def byte_buckets(text, orders, bits):
    data, out = bytes(32 if b in b"\t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()), []
    for order in orders:
        for k in range(len(data) - order + 1):
            h = order * 0x9E3779B1 & M32
            for b in data[k : k + order]:
                h = (h ^ b) * 0x01000193 & M32
                h ^= h >> 15
            out.append((h * 0x9E3779B1 & M32) >> (32 - bits))
    return out


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def word_buckets(text, bits=quality.BITS):
    data = (text or "").encode()
    tokens = [m[0] for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", data)]
    h = [mix((sum(int(_BYTE_CODES[b]) * pow(_BASE, k, 1 << 64) for k, b in enumerate(t)) + len(t)) & M64) for t in tokens]
    found = h + [mix((a * 0xD6E8FEB86659FD93 + b) & M64) for a, b in zip(h, h[1:])]
    for gap in (1, 2):
        found += [mix(int(_AGAIN[gap - 1])) for a, b in zip(h, h[gap:]) if a == b]
    return [x >> (64 - bits) for x in found]


def logistic(x):
    return 1 / (1 + math.exp(-max(-40, min(40, x))))


def scores_of(df):
    return sorted((r["doc_id"], r["score"]) for r in df.collect())


def test_toxicity_scores(spark):
    """Counts, ratios and the optimum of the regression, found by Newton steps here."""
    rows, df = make(spark)
    model = toxicity.fit(df, df.select("doc_id", "label"), l2=1.0)
    texts = [(byte_buckets(t, toxicity.ORDERS, toxicity.BITS), y) for _, t, y in rows]
    toxic, other = (sum(y == k for _, y in texts) for k in (1, 0))
    seen = {k: Counter(b for found, y in texts if y == k for b in set(found)) for k in (0, 1)}
    used = sorted(set(seen[0]) | set(seen[1]))
    ratio = {b: math.log((seen[1][b] + 1) / (toxic + 2) / ((seen[0][b] + 1) / (other + 2))) for b in used}
    place = {b: k for k, b in enumerate(used)}
    x = np.zeros((len(texts), len(used) + 1))
    x[:, -1] = 1
    for row, (found, _) in zip(x, texts):
        for b, n in Counter(found).items():
            row[place[b]] = 100 * ratio[b] * n / len(found)
    y = np.array([k for _, k in texts], dtype=float)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    penalty = np.append(np.full(len(used), 1.0 / len(y)), 0)
    theta = np.zeros(len(used) + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ theta))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * theta)
        theta -= step
    want = {i: logistic(z) for (i, _, _), z in zip(rows, x @ theta)}
    for i, score in scores_of(toxicity.score(df, model)):
        assert score == pytest.approx(want[i], abs=5e-3)
    # The score is the mean weight of the n-grams.
    for (i, _, _), (found, _), (_, score) in zip(rows, texts, scores_of(toxicity.score(df, model))):
        mean = sum(float(model.weights[b]) for b in found) / max(1, len(found))
        assert score == pytest.approx(logistic(model.intercept + mean), abs=1e-5)


def test_quality_scores(spark):
    """Every step of follow-the-regularised-leader, coordinate by coordinate."""
    rows, df = make(spark)
    model = quality.fit(df, df.select("doc_id", "label"))
    alpha, beta, l1, l2, size = 0.5, 1.0, 0.02, 0.1, 1 << quality.BITS
    train = []
    for _, t, y in rows:
        found = word_buckets(t)
        at = sorted(Counter(found).items())
        key = np.array([b for b, _ in at], dtype="<u4").tobytes()
        train.append(((zlib.crc32(key), key, y), [(b, float(np.float32(quality.RATE * n / max(1, len(found))))) for b, n in at] + [(size, 1.0)], y))
    train.sort(key=lambda row: row[0])
    share = sum(y for _, _, y in train) / len(train)
    z, n = Counter(), Counter()

    def weight(b):
        return 0.0 if abs(z[b]) <= l1 else -(z[b] - math.copysign(l1, z[b])) / ((beta + math.sqrt(n[b])) / alpha + l2)

    for _ in range(3):
        for _, features, y in train:
            w = {b: weight(b) for b, _ in features}
            slope = (0.5 / share if y else 0.5 / (1 - share)) * (logistic(sum(w[b] * v for b, v in features)) - y)
            for b, v in features:
                g = slope * v
                z[b] += g - (math.sqrt(n[b] + g * g) - math.sqrt(n[b])) / alpha * w[b]
                n[b] += g * g
    got = dict(scores_of(quality.score(df, model)))
    for i, t, _ in rows:
        found = word_buckets(t)
        want = logistic(weight(size) + quality.RATE * sum(weight(b) for b in found) / max(1, len(found)))
        assert got[i] == pytest.approx(want, abs=1e-5)


def test_language_scores(spark):
    """Kernel values from sets of n-grams, ridge regression in its dual form."""
    r = np.random.default_rng(3)
    tongues = {"en": "the cat and dog went over hill with this thing".split(), "de": "der hund und katze ging über hügel mit einem ding".split(), "fr": "le chat et chien allait où colline avec une chose".split()}
    rows = [(i, " ".join(r.choice(tongues[t], 9)), t) for i, t in enumerate(list(tongues) * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    model = langid.fit(df, df.select("doc_id", "label"), landmarks=100)
    # Texts of one's own beside those learnt; every learnt text is a landmark.
    new = [(100 + i, " ".join(r.choice(tongues[t], 5)), t) for i, t in enumerate(list(tongues) * 5)]
    found = {x["doc_id"]: x for x in langid.predict(spark.createDataFrame(rows + new, df.schema), model).collect()}
    sets = {i: set(byte_buckets(t, langid.ORDERS, langid.BITS)) for i, t, _ in rows + new}
    ids = [i for i, _, _ in rows]
    k = lambda a, b: np.array([[len(sets[i] & sets[j]) / math.sqrt(len(sets[i]) * len(sets[j])) for j in b] for i in a])
    inverse = np.linalg.pinv(k(ids, ids), rcond=1e-6, hermitian=True)
    names = sorted(tongues)
    y = np.array([[1.0 if t == name else -1.0 for name in names] for _, _, t in rows])
    inner = lambda a: k(a, ids) @ inverse @ k(ids, ids) + 1
    dual = np.linalg.solve(inner(ids) + 1e-3 * len(ids) * np.eye(len(ids)), y)
    for i, _, t in rows + new:
        p = np.clip((inner([i])[0] @ dual + 1) / 2, 1e-6, 1)
        assert found[i]["lang_pred"] == names[int(p.argmax())]
        assert found[i]["score"] == pytest.approx(p.max() / p.sum(), abs=5e-3)


def test_scoring_of_odd_rows(spark):
    """Repeated rows, null ids, clashing columns, texts beyond a window, labels of one class."""
    long = "quiet river words " * 260_000
    rows = [(1, "a text", "x", 1.0), (1, "a text", "x", 1.0), (None, "a text", "x", 1.0), (2, long, None, None), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double").selectExpr("*", "label as `__id`", "label as lang", "label as `__text`")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, label int")
    for kind in (toxicity, quality):
        model = kind.fit(docs, labels)
        found = Counter((x["doc_id"], x["score"]) for x in kind.score(docs, model).collect())
        assert sum(found.values()) == 5 and {n for (i, _), n in found.items() if i == 1} == {2}
        kept = toxicity.drop_toxic(docs, model, 2.0) if kind is toxicity else quality.keep_good(docs, model, 0.0)
        assert kept.columns == docs.columns and kept.count() == 5
        alone = kind.fit(docs, labels.where("label = 1"))
        assert not alone.weights.any() and all(s > 0.99 for _, s in scores_of(kind.score(docs.where("doc_id is not null"), alone)))
    found = byte_buckets(long[:2000], toxicity.ORDERS, toxicity.BITS)
    assert set(np.unique(toxicity._buckets(np.frombuffer(long.encode(), dtype=np.uint8))).tolist()) == set(found)
    assert len(toxicity._buckets(np.frombuffer(long.encode(), dtype=np.uint8))) == sum(len(long) - n + 1 for n in toxicity.ORDERS)
    known = spark.createDataFrame([(1, "en"), (2, "en")], "doc_id long, label string")
    got = langid.predict(docs, langid.fit(docs, known)).collect()
    assert Counter(x["lang_pred"] for x in got) == {"en": 4, "und": 1}
