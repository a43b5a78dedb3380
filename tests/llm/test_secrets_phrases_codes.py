"""Secret scan, collocations and vector codes against brute force; nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from opinionmill.llm import collocations, secrets, vector_codes

# -- secrets --------------------------------------------------------------------
R = random.Random(5)
HEXES = ["".join(R.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
KEYS = ["AKIA" + "".join(R.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(60)]
SECRET_TEXTS = [
    (0, None), (1, ""), (2, "token = \"" + HEXES[0] + "\""), (3, "API_KEY: abcdef, PassWord='x'; apikey=123456"), (4, "AKIA" + "B" * 15 + " " + KEYS[0]), (5, "é👍 secret=" + KEYS[1] + " " + "f" * 24),
    (6, "tokenToken=abcdefgh password = token=longenough1"), (7, "word " * 60_000 + "passwd:" + "q" * 3000), (None, "secret: zzzzzzz"), (8, "dead" * 5 + " ſecret=abcdefgh " + "0" * 23),
    *[(100 + k, f"internationalisation text token={h} and internationally-agreed words") for k, h in enumerate(HEXES)], *[(200 + k, f"key {v} in otherwise-ordinary words") for k, v in enumerate(KEYS)],
    (300, "some plain words " + HEXES[3][:20] + " and AKI" + KEYS[3][3:15] + " then counterrevolutionaries"),
]


def brute_base(text):
    found = []
    for order, kind, pattern, least in (
        (0, "assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
        (1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24),
    ):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m.group(2) if order == 0 else m.group()) >= least]
    return [x[2] for x in sorted(found)]


def test_secret_scan(spark):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in SECRET_TEXTS], "doc_id long, text string, __id string, spans int")
    model = secrets.fit(docs)
    rows = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs, model)).collect()}
    assert len(rows) == len(SECRET_TEXTS)
    for i, t in SECRET_TEXTS:
        want, r = brute_base(t or ""), rows[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("format")] == want
    # A shorter token of a known format is found beside the base spans, words are left alone.
    text = dict(SECRET_TEXTS)[300]
    at = text.index(HEXES[3][:20])
    assert f"format:{at}:{at + 20}" in rows[300]["spans"]
    assert sum(r["n_format"] for i, r in rows.items() if i is not None and 100 <= i < 300) == 0
    # Access keys have states of their own for what they begin with.
    assert len(model.kinds["access"].step) > 3


def test_secret_scan_without_labels(spark):
    docs = spark.createDataFrame([(1, "plain words only"), (2, None)], "doc_id long, text string")
    model = secrets.fit(docs)
    assert model.kinds == {} and {r["spans"] for r in secrets.digest(secrets.scan(docs, model)).collect()} == {""}
    empty = docs.limit(0)
    assert secrets.digest(secrets.scan(empty, secrets.fit(empty))).count() == 0


def test_automata_give_probabilities():
    model = secrets.infer(["ab"] * 30 + ["abab"] * 20 + ["b"] * 10)
    total = np.exp(np.array(model.gain)).sum(axis=1)
    assert np.allclose(total, 1)
    assert model.score("ab") > model.score("ba") and model.score("abab") > model.score("aabb")


# -- collocations ----------------------------------------------------------------
WORDS = ["new", "York", "city", "a", "b", "über", "c d", "x1"]
PHRASE_TEXTS = [(k, " ".join(R.choice(WORDS) + R.choice(["", "", "", ",", "\n", "! ", "\t"]) for _ in range(R.randint(0, 40))), R.choice(["en", "de", None])) for k in range(120)]
PHRASE_TEXTS += [(0, PHRASE_TEXTS[0][1], "en"), (None, "new york city. " * 5, "en"), (500, None, "en"), (501, "", None), (502, "one two. three\n" * 200_000, "long")]


def brute_phrases(rows, least=10, contained=50, top=2000):
    f = Counter()
    for _, text, lang in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for m in (1, 2, 3):
                f.update((lang or "und", tuple(ws[i : i + m])) for i in range(len(ws) - m + 1))
    n = Counter()
    for (lang, p), c in f.items():
        n[lang] += c * (len(p) == 1)
    found = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    gone = {(lang, p[i : i + 2]) for (lang, p), c in found.items() if len(p) == 3 for i in (0, 1) if 100 * c >= contained * found.get((lang, p[i : i + 2]), 1 << 60)}
    out = []
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(lang, rank, *o[1:]) for rank, o in enumerate(own, 1)]
    return sorted(ranked)


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    """Small parts make many ranges and flushes."""
    if small:
        for name, value in (("RANGE_CHARS", 1 << 12), ("FLUSH", 500), ("TEXT_BYTES", 3000), ("EXACT_ROWS", 200)):
            monkeypatch.setattr(collocations, name, value)
    docs = spark.createDataFrame([(*r, 1, "k") for r in PHRASE_TEXTS], "doc_id long, text string, lang string, n long, phrase string")
    found = sorted(map(tuple, collocations.collocations(docs).collect()))
    assert found == brute_phrases(PHRASE_TEXTS) and {r[0] for r in found} == {"en", "de", "und", "long"}
    few = collocations.collocations(docs, top=2, least=3)
    assert sorted(map(tuple, few.collect())) == brute_phrases(PHRASE_TEXTS, least=3, top=2)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_summaries_keep_what_is_frequent():
    """Summaries that lose counters keep every hash that occurs often enough, whatever the order."""
    r = np.random.default_rng(2)
    rows = np.concatenate([np.repeat(np.arange(30), 10), np.repeat(np.arange(30, 60), 9), np.arange(1000, 6000)]).astype(np.uint64)
    r.shuffle(rows)
    capacity = len(rows) // 10 + 1
    summary = collocations.Summary(capacity)
    for part in np.array_split(rows, 40):
        values, counts = np.unique(part, return_counts=True)
        blob = collocations.pack(values, counts)
        summary.add(collocations.unpack(blob, len(values)))
        summary.merge()
        assert len(summary.values) <= capacity
    assert summary.taken > 0
    kept = set(summary.survivors(10).tolist())
    assert set(range(30)) <= kept and len(kept) < 200


# -- vector codes ------------------------------------------------------------------
def brute_codes(rows, entries=256, rounds=4, scale=1024, parts=4):
    """rows: (id, vector, label), all usable."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [[int(np.floor(float(x) * scale)) for x in v] for _, v, _ in rows]
    size = len(vectors[0]) // parts
    pieces = [[v[p * size : (p + 1) * size] for v in vectors] for p in range(parts)]
    starts = [k for k in range(len(rows)) if k == 0 or rows[k][0] != rows[k - 1][0]][:entries]
    books = [[list(pieces[p][k]) for k in starts] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for x in pieces[p]:
                members.setdefault(nearest(p, x)[1], []).append(x)
            for k, own in members.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for k, (i, _, label) in enumerate(rows):
        best = [nearest(p, pieces[p][k]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    sums = Counter()
    for _, _, error, label in out:
        sums[label] += error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], sha) for i, c, e, label in out), key=str)


def cloud(n, d, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d))
    return [(int(i), [float(np.float32(x)) for x in centres[i % 12] + 0.1 * r.normal(size=d)], None if i % 7 == 0 else int(i % 3)) for i in r.permutation(n)]


@pytest.mark.parametrize("entries, memo", [(256, 1 << 15), (16, 8)])
def test_vector_codes(spark, monkeypatch, entries, memo):
    monkeypatch.setattr(vector_codes, "MEMO_CELLS", memo)
    good = cloud(300, 8, 1)
    good += good[:20] + [(7, good[50][1], 1), (None, good[60][1], 2), (1000, [0.0] * 8, 5), (1001, [-0.0] * 8, 5)]
    bad = [(2000, None, 1), (2001, [0.0, None] * 4, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, 1)]
    odd = [(3000, [1.0] * 4, 1), (3001, [], None)]
    df = spark.createDataFrame([(*r, "k", 1) for r in good + bad + odd], "vec_id long, embedding array<float>, label int, code string, __id int")
    rows = [tuple(r) for r in vector_codes.quantise(df, entries=entries)[0].collect()]
    want = brute_codes(good, entries)
    assert sorted((r for r in rows if r[1] is not None), key=str) == want
    assert sorted(r[0] for r in rows if r[1] is None) == [3000, 3001]


def test_vector_codes_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.quantise(spark.createDataFrame([], schema))[0].count() == 0
    few = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], schema)
    assert [r["code"] for r in vector_codes.quantise(few)[0].collect()] == [None]
    with pytest.raises(Exception, match="too large"):
        vector_codes.quantise(spark.createDataFrame([(1, [1e30] * 4, 1)], schema))[0].count()


def test_memo_leaves_nothing_out():
    """Dominated entries are never the nearest, at every width."""
    r = np.random.default_rng(4)
    entries = r.integers(-500, 500, (40, 3))
    rows = r.integers(-600, 600, (500, 3))
    d = ((rows[:, None] - entries) ** 2).sum(axis=2)
    for width in (1, 7, 60, 5000):
        entry, least = vector_codes.Memo(vector_codes.Codebook(entries, width)).nearest(rows)
        assert (entry == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
