"""Operators on small tables, against brute force, the library or SQL; nulls, empty texts, copies, empty tables, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from opinionmill.llm import components, embed_dedup, exact_dedup, langid, line_templates, ngram_join, packing, quality, sharding, sp_codec, toxicity
from opinionmill.llm.common import labelled_sample

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
BASE = " ".join(f"word{k % 37}x{k}" for k in range(120))
TEXTS = [
    (0, None), (1, ""), (2, "  "), (3, "a  b\tc\n\nd "), (4, BASE), (5, BASE), (6, BASE.replace("word5x5", "other")), (7, BASE + " tail"),
    (8, "été naïve 👍🏽 ﷽ 中文 ²½ <|x|> don't"), (9, "one two"), (10, "One TWO"), (11, "x" * 3000), (12, "Zeile eins\nZeile zwei"), (13, BASE[: len(BASE) // 2]), (14, "big " * 40000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", i, i) for i, t in TEXTS], "doc_id long, text string, __id string, n long, key int")


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_sharding(spark, docs, empty):
    shards = [f"s{k}" for k in range(7)]
    owners = sharding.fill_table(shards, 709)
    assert max(Counter(owners).values()) - min(Counter(owners).values()) <= 1
    fewer = sharding.fill_table(shards[1:], 709)
    moved = sum(a != b + 1 for a, b in zip(owners, fewer) if a)
    assert moved < 0.2 * 709
    found = by_id(sharding.assign(docs, "doc_id", shards, 709))
    for i, _ in TEXTS:
        slot = int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 709
        assert (found[i]["slot"], found[i]["shard"]) == (slot, owners[slot])
    assert sharding.assign(empty, "doc_id", shards, 709).count() == 0
    hot = spark.createDataFrame([("hot", i) for i in range(500)], "source string, i int")
    assert sharding.assign(hot, "source", shards, 709, spread=16, spread_by="i").select("shard").distinct().count() > 3
    with pytest.raises(ValueError):
        sharding.fill_table(shards, 700)


def test_sentencepiece_equals_the_library(docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = by_id(sp_codec.encode(docs, PIECES))
    for i, t in TEXTS:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert found[i]["ids"] == ids and found[i]["decoded"] == lib.decode(ids) and found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    assert sp_codec.encode(empty, PIECES).count() == 0


def test_agendas_agree():
    codec, r = sp_codec.codec(PIECES), np.random.default_rng(3)
    units = ["▁" + "".join(r.choice(list("thean ingor"), r.integers(1, 20))).replace(" ", "") for _ in range(300)]
    counts = np.array([len(u) for u in units])
    syms = np.full((len(units), counts.max()), -1, dtype=np.int32)
    for row, u in zip(syms, units):
        row[: len(u)] = codec._symbols(u)
    flat, left = codec.agendas(syms, counts)
    ends = np.cumsum(left)
    assert [flat[e - n : e].tolist() for n, e in zip(left, ends)] == [codec.agenda(u) for u in units]


@pytest.mark.parametrize("lanes", [exact_dedup.LANES, ((7, 3), (5, 2))])
def test_exact_dedup(docs, empty, lanes):
    """The small moduli make unequal texts collide; the result is the same."""
    found = by_id(exact_dedup.exact_duplicates(docs, lanes=lanes))
    texts = {i: t or "" for i, t in TEXTS}
    for i, t in texts.items():
        group = [j for j, u in texts.items() if u == t]
        assert (found[i]["keep_id"], found[i]["group_size"], found[i]["kept"]) == (max(group), len(group), i == max(group))
        assert found[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup.exact_duplicates(empty).count() == 0
    twice = exact_dedup.exact_duplicates(docs.unionByName(docs)).collect()
    assert len(twice) == 2 * len(TEXTS) and {r["group_size"] for r in twice if r["doc_id"] == 14} == {2}


def test_exact_dedup_keeps_null_ids_apart(spark):
    """Fingerprints of these texts collide, and one row has no id."""
    df = spark.createDataFrame([(None, "abcd"), (None, "dcba"), (1, "abcd")], "doc_id long, text string")
    found = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(df, lanes=((2, 1), (2, 1))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == {(None, sha("abcd")): (1, 2, False), (None, sha("dcba")): (None, 1, True), (1, sha("abcd")): (1, 2, True)}


def test_sharding_refuses_clashing_columns(spark):
    for name in ("slot", "Shard"):
        with pytest.raises(ValueError):
            sharding.assign(spark.range(3).withColumn(name, F.lit(1)), "id", ["a", "b"], 7)


def test_quality_reads_long_texts_whole():
    from opinionmill.llm.ngrams import word_ngrams

    one = np.frombuffer(b"x" * 1_300_000, dtype=np.uint8)
    assert len(word_ngrams(one, np.array([0, len(one)]), 18)[0]) == 1
    many = np.frombuffer(b"ab cd " * 300_000, dtype=np.uint8)
    rows, _ = word_ngrams(many, np.array([0, len(many)]), 18)
    # Tokens, neighbours, and pairs that repeat a word two further on.
    assert len(rows) == 600_000 + 599_999 + 599_998


def test_fingerprints_compose(docs, monkeypatch):
    whole = {r["__id"]: (r["lane_0"], r["lane_1"]) for r in exact_dedup.fingerprints(docs).collect()}
    for i, t in TEXTS:
        for k, (p, b) in enumerate(exact_dedup.LANES):
            value = 0
            for byte in (t or "").encode():
                value = (value * b + byte + 1) % p
            assert whole[i][k] == value


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    packed = packing.pack(docs, BYTES, window=64, with_ids=True)
    rows = packed.collect()
    for i, t in TEXTS:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert sum(m[1] for m in mine) == len(ids)
        assert all(zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes()) == c for s, n, c in mine)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert all(len(r["input_ids"]) == 64 for r in packing.sequences(packed, 64).collect())
    assert packing.pack(empty, BYTES).count() == 0


def test_packing_knows_added_tokens(spark):
    from tokenizers import Tokenizer

    lib, end = Tokenizer.from_file(BYTES), "<|endoftext|>"
    texts = [f"end{end} next", f"{end}start", f"stop{end}", end, f"a{end}{end} {end}\n\n{end}b", f"two  {end}  spaces {end} one ", f"<|endof{end}text|>", "<|endoftext |>", f" {end}" * 300]
    texts.append(("long words " * 60_000) + end + "after it")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(df, BYTES, with_ids=True).collect()
    for i, t in enumerate(texts):
        ids = [x for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]) for x in r["ids"]]
        assert ids == lib.encode(t, add_special_tokens=False).ids + [0]


def test_subset_sum_is_closest():
    r = np.random.default_rng(1)
    for _ in range(50):
        counts = {int(k): int(n) for k, n in zip(r.integers(1, 40, 5), r.integers(1, 4, 5))}
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1)}
        chosen = packing.fill(counts, 50)
        assert sum(k * m for k, m in chosen.items()) == max(s for s in sums if s <= 50)
        assert all(m <= counts[k] for k, m in chosen.items())


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(sets, num, den):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and common * den >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [128, 4])
def test_ngram_join(spark, docs, empty, block, monkeypatch):
    """A family of near copies with texts around it, in one block and in many."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r, rows = np.random.default_rng(5), [(i, t) for i, t in TEXTS]
    words = BASE.split()
    for k in range(60):
        copy = list(words)
        for at in r.integers(0, len(copy), r.integers(0, 5)):
            copy[at] = f"new{r.integers(0, 1000)}"
        rows.append((100 + k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, threshold in ((3, (90, 100)), (5, (80, 100))):
        sets = {i: shingles(t, width) for i, t in rows}
        want = brute_components(sets, *threshold)
        found = by_id(ngram_join.near_duplicates(df, width, threshold))
        assert {i: f["n_shingles"] for i, f in found.items()} == {i: len(s) for i, s in sets.items()}
        assert {i: f["component_id"] for i, f in found.items()} == want
    assert ngram_join.near_duplicates(empty).count() == 0


def test_linked_sets_share_a_part():
    r = np.random.default_rng(2)
    for num, den in ((90, 100), (80, 100)):
        for _ in range(3000):
            a = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 150)), dtype=np.uint64) * 2)
            b = np.unique(np.concatenate([a[int(r.integers(0, max(1, len(a) // 5) + 1)) :], r.integers(0, 1 << 63, int(r.integers(0, len(a) // 8 + 2)), dtype=np.uint64) * 2]))
            common = len(np.intersect1d(a, b))
            if len(b) and common * den >= num * (len(a) + len(b) - common):
                assert len(np.intersect1d(ngram_join.part_keys(a, num, den), ngram_join.part_keys(b, num, den)))


@pytest.mark.parametrize("part", [200_000, 7])
def test_components(spark, part, monkeypatch):
    monkeypatch.setattr(components, "PART_LINKS", part)
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 90), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 90: 90, 100: 90, 101: 90}


def test_line_templates(spark, empty):
    rows = [(i, f"only in {i} and nowhere else but here {i * 7}\nUser 12{i} logged in from host {['alpha', 'beta', 'gamma'][i % 3]} today\n\nshared footer line") for i in range(12)]
    rows += [(50, None), (51, ""), (52, "shared footer line\nshared footer line"), (53, "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = by_id(line_templates.drop_recurring_lines(df, min_docs=12))
    assert found[3]["n_dropped"] >= 2 and "footer" not in found[3]["text"] and "logged" not in found[3]["text"]
    assert found[52]["text"] == "" and found[50]["text"] == "" and found[53]["text"] == "\n" and found[51]["n_lines"] == 1
    names = {r["template"]: r["docs"] for r in line_templates.templates(df, min_docs=12).collect()}
    assert names["shared footer line"] == 13 and any("logged in from host <*> today" in t for t in names)
    assert line_templates.drop_recurring_lines(empty).count() == 0


def test_line_templates_of_one_leaf(spark):
    """A leaf holds several templates, short lines of equal beginnings stay, long lines recur in two texts."""
    names = ["ada", "bob", "cyd", "dee", "eva", "fay"]
    passage = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(51))
    first = [(i, f"Read more about {names[i % 6]} in our weekly news") for i in range(24)]
    second = [(100 + i, f"Read more about how {names[i % 6]} cooks quick {names[i // 6]}") for i in range(12)]
    short = [(200 + i, f"There is a {''.join(chr(97 + int(c)) for c in str(i))}{'x' if i % 2 else ''}") for i in range(30)]
    long = [(300, f"own text\n{passage}"), (301, f"{passage}\nother text"), (302, passage[:-7] + "\nunlike"), (303, f"copy {passage}"), (304, f"copy {passage}")]
    found = by_id(line_templates.drop_recurring_lines(spark.createDataFrame(first + second + short + long, "doc_id long, text string")))
    assert all(found[i]["n_dropped"] == 1 for i, _ in first + second)
    assert all(found[i]["n_dropped"] == 0 for i, _ in short)
    assert (found[300]["text"], found[301]["text"]) == ("own text", "other text")
    # Copies of one text are one text, and fifty words are not more than fifty.
    assert [found[i]["n_dropped"] for i in (302, 303, 304)] == [0, 0, 0]


def labelled(spark, make, n=240):
    docs = spark.createDataFrame([(i, make(i)) for i in range(n)] + [(9000, None), (9001, "")], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, i % 2) for i in range(0, n, 3)], "doc_id long, label int")


def test_toxicity(spark, empty):
    docs, labels = labelled(spark, lambda i: f"some plain words number {i} and more {i * i} of them " + ("you rotten scoundrel" if i % 2 else "you kind person"))
    model = toxicity.fit(docs, labels)
    found = by_id(toxicity.score(docs, model))
    assert sum((found[i]["score"] >= 0.7) == bool(i % 2) for i in range(240)) >= 235
    assert toxicity.drop_toxic(docs, model, 0.7).columns == docs.columns
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0
    assert found[9000]["score"] == found[9001]["score"]


def test_quality(spark, empty):
    docs, labels = labelled(spark, lambda i: f"a fine sentence of words {i} with more of them" if i % 2 else f"BUY!! NOW!! {i}!! WOW!! YES!! {i}!!")
    model = quality.fit(docs, labels)
    found = by_id(quality.score(docs, model))
    assert sum((found[i]["score"] >= 0.5) == bool(i % 2) for i in range(240)) >= 235
    assert quality.keep_good(docs, model, 0.5).columns == docs.columns
    assert quality.score(empty, quality.fit(empty, labels.limit(0))).count() == 0


def test_training_bounds(spark):
    """As many rows are learnt from, and as many n-grams weighed, as there were before the bounds were halved."""
    r = np.random.default_rng(8)
    rows = [(i, "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz "), 900)), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert np.count_nonzero(toxicity.fit(df, df.select("doc_id", "label")).weights) > 1 << 14
    many = spark.range(12_500).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), (F.col("id") % 2).alias("label"))
    for rows in (toxicity.TRAIN_ROWS, quality.TRAIN_ROWS):
        assert labelled_sample(many, many.select("doc_id", "label"), rows).count() == 12_000


def test_samples_hold_rare_labels(spark):
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3000 == 5, "rare").when(F.col("doc_id") % 30 == 1, "some").otherwise("usual").alias("label"))
    found = Counter(r["label"] for r in labelled_sample(docs, labels, 60).collect())
    assert found["rare"] == 3 and {found["some"], found["usual"]} == {28, 29}
    assert labelled_sample(docs, labels, 10_000).count() == 9_000
    with pytest.raises(ValueError):
        labelled_sample(docs, labels, 2)
    many = langid.fit(docs, docs.select("doc_id", (F.col("doc_id") % 300).cast("string").alias("label")), train_rows=900)
    assert len(many.languages) == 300 and len(many.landmarks) == 900
    toxic = docs.select("doc_id", F.when(F.col("doc_id") % 3000 == 5, 3).otherwise(-(F.col("doc_id") % 40)).alias("label"))
    model = toxicity.fit(docs, toxic, train_rows=60)
    assert model.weights.any()


def test_language(spark, empty):
    words = {"en": "the cat and the dog went over the hill with this thing".split(), "de": "der hund und die katze gingen über den hügel mit einem ding".split()}
    r = np.random.default_rng(4)
    rows = [(i, " ".join(r.choice(words["de" if i % 2 else "en"], 20)), "de" if i % 2 else "en") for i in range(200)] + [(900, None, None), (901, "12 34 !!", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = docs.where("doc_id % 4 < 2 and lang is not null").select("doc_id", F.col("lang").alias("label"))
    found = by_id(langid.predict(docs, langid.fit(docs, known)))
    assert sum(found[i]["lang_pred"] == lang for i, _, lang in rows[:200]) >= 198
    assert found[900]["lang_pred"] == found[901]["lang_pred"] == "und" and found[900]["score"] == 0
    assert langid.predict(empty, langid.fit(empty, known.limit(0))).count() == 0


@pytest.mark.parametrize("box, part", [(8192, 16384), (60, 25)])
def test_embeddings(spark, box, part, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BOX_ROWS", box)
    monkeypatch.setattr(embed_dedup, "PART_ROWS", part)
    r = np.random.default_rng(6)
    base = r.normal(size=(200, 32))
    x = np.concatenate([base, base[:40] + 0.05 * r.normal(size=(40, 32)), base[:5], base[:1] + 0.1 * r.normal(size=(30, 32))])
    rows = [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [1.0, 2.0]), (904, [2.0, 4.0]), (905, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = np.float32(x).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    labels = np.arange(len(x))
    embed_dedup._merge(labels, *np.nonzero(near))
    found = by_id(embed_dedup.near_duplicates(df), "vec_id")
    assert [found[i]["n_links"] for i in range(len(x))] == near.sum(axis=1).tolist()
    assert [found[i]["component_id"] for i in range(len(x))] == labels.tolist()
    assert all(found[k]["n_links"] == 0 and found[k]["kept"] for k in (900, 901, 902, 905))
    assert found[904]["component_id"] == 903 and not found[904]["kept"]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0

def test_embeddings_of_many_lengths(spark, monkeypatch):
    """More lengths than have boxes of their own; parts get smaller with longer vectors."""
    monkeypatch.setattr(embed_dedup, "OWN_LENGTHS", 3)
    monkeypatch.setattr(embed_dedup, "PART_VALUES", 40)
    r, rows, want = np.random.default_rng(2), [], {}
    for length in range(1, 71):
        base = r.normal(size=length)
        for k in range(3):
            rows.append((length * 10 + k, [float(v) for v in base * (k + 1) + (0.01 * r.normal(size=length) if length > 1 else 0)]))
            want[length * 10 + k] = length * 10
    for length, k in ((5, 7), (64, 8)):
        rows += [(length * 10 + k, [float(v) for v in -np.array(rows[(length - 1) * 3][1])])]
        want[length * 10 + k] = length * 10 + k
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("length", F.lit("clash")).withColumn("rep", F.lit(1))
    found = by_id(embed_dedup.near_duplicates(df), "vec_id")
    assert {i: f["component_id"] for i, f in found.items()} == want
    assert {i: f["n_links"] for i, f in found.items()} == {i: 2 if i % 10 < 3 else 0 for i in want}


def test_box_tree_reaches_every_near_box():
    r = np.random.default_rng(7)
    x = r.normal(size=(600, 4))
    tree = embed_dedup._tree(x[:50], 32)
    row, box, home = embed_dedup._descend(x, tree, 0.5)
    own = dict(zip(row[home].tolist(), box[home].tolist()))
    visits = set(zip(row.tolist(), box.tolist()))
    assert len(own) == len(x) and len(tree) == 6
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= 0.5
    for a, b in zip(*np.nonzero(near)):
        low, high = sorted((int(a), int(b)), key=own.get)
        assert (high, own[low]) in visits
