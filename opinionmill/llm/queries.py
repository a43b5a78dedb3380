"""The `opN_` queries over the shared tables, and SQL for those it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, embed_dedup, exact_dedup, langid, line_templates, ngram_join, packing, quality, secrets, sharding, sp_codec, toxicity, vector_codes
from .common import held_out, table

SHARDS, SLOTS = [f"shard-{k:02d}" for k in range(24)], 2503


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document over 24 shards, and where it goes when the first shard is lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    placed = sharding.assign(docs, "doc_id", SHARDS, SLOTS)
    rest = sharding.table(spark, SHARDS[1:], SLOTS, "slot", "next_shard")
    return placed.join(F.broadcast(rest), "slot").select("doc_id", "slot", "shard", (F.col("next_shard") + 1).cast("int").alias("shard_after_loss"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=(90, 100))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def _labels(spark: SparkSession, sf_dir: str, label: str, modulus: int, remainder: int) -> DataFrame:
    return table(spark, sf_dir, "labels").where(~held_out("doc_id", modulus, remainder)).select("doc_id", F.col(label).alias("label"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _labels(spark, sf_dir, "toxic", 3, 1))
    return toxicity.score(docs, model).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.where(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull()).select("doc_id", F.col("lang").alias("label"))
    return langid.predict(docs, langid.fit(docs, known)).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, _labels(spark, sf_dir, "quality", 5, 0))
    return quality.score(docs, model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.fit(docs)))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.quantise(table(spark, sf_dir, "embeddings"))[0]


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_sentencepiece, op3_exact_dedup, op4_packing, op5_ngram_join, op6_line_dedup, op7_toxicity, op8_langid, op9_embedding_dedup, op10_quality,
        op11_secret_scan, op12_collocations, op13_vector_codes,
    )
}

#: The table is filled turn by turn: each turn's shard takes the first free slot of its order.
_FILL = """
  {name}_orders AS (
    SELECT k, ('0x' || substr(md5(printf('shard-%02d', k + {skip})), 1, 8))::BIGINT % {slots} AS o,
           ('0x' || substr(md5(printf('shard-%02d', k + {skip})), 9, 8))::BIGINT % {less} + 1 AS d
    FROM range({n}) r(k)),
  {name}_lists AS (SELECT list(o ORDER BY k) AS os, list(d ORDER BY k) AS ds FROM {name}_orders),
  {name}_filled AS (
    SELECT 0 AS turn, list_resize([]::INT[], {slots}, -1) AS owner, list_resize([]::BIGINT[], {n}, 0) AS upto, -1::BIGINT AS slot
    UNION ALL
    SELECT turn + 1,
           list_concat(list_concat(owner[1:s], [(turn % {n})::INT]), owner[s + 2:]),
           list_concat(list_concat(upto[1:turn % {n}], [j + 1]), upto[turn % {n} + 2:]), s
    FROM (
      SELECT turn, owner, upto, j, (os[turn % {n} + 1] + j * ds[turn % {n} + 1]) % {slots} AS s, os
      FROM (
        SELECT turn, owner, upto, os, ds,
               list_filter(range(upto[turn % {n} + 1], {slots}), lambda x: owner[(os[turn % {n} + 1] + x * ds[turn % {n} + 1]) % {slots} + 1] = -1)[1] AS j
        FROM {name}_filled, {name}_lists WHERE turn < {slots}))),
  {name}_table AS (SELECT slot, ((turn - 1) % {n})::INT AS shard FROM {name}_filled WHERE turn > 0)
"""

#: Whether 60 % of the tokens of two tails, and one at least, are equal at their places.
_AGREE = "len(list_filter(range(1, len({a}.tail) + 1), lambda i: {a}.tail[i] = {b}.tail[i])) * 100 >= greatest(1, len({a}.tail) * 60)"

#: Nearest entries of the codebook before round {k} (ties to the lowest), and the codebook after it.
_ASSIGN = """
near{k} AS (
  SELECT id, part, v, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT p.id, p.part, p.v, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM pieces p JOIN book{k} b USING (part))
  GROUP BY id, part, v),
"""
_MOVE = """
sums{k} AS (SELECT part, entry, pos, sum(v[pos])::BIGINT AS total, count(*) AS n FROM near{k}, (SELECT unnest(range(1, 17)) AS pos) GROUP BY ALL),
means{k} AS (SELECT part, entry, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY pos) AS v FROM sums{k} GROUP BY part, entry),
book{next} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m USING (part, entry)),
"""

ORACLES = {
    "op12_collocations": r"""
WITH pieces AS (
  SELECT doc_id, lang, unnest(range(len(ps))) AS piece, unnest(ps) AS p
  FROM (SELECT doc_id, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)),
listed AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
spread AS (
  SELECT lang, m, unnest(list_transform(range(1, greatest(len(ws) - m + 2, 1)), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM listed, (SELECT unnest([1, 2, 3]) AS m)),
f AS (SELECT lang, phrase, m, count(*) AS n FROM spread GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND n >= 10),
inside AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a AS outer_a FROM c WHERE m = 3),
kept AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * outer_a >= 50 * a)),
cuts AS (SELECT lang, phrase, a, ws, unnest(range(1, m)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.n AS l, y.n AS r, ((1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
best AS (SELECT lang, phrase, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM scored GROUP BY lang, phrase, a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""",
    "op13_vector_codes": """
WITH kept AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (SELECT id, p AS part, v[p * 16 + 1:p * 16 + 16] AS v FROM kept, (SELECT unnest(range(4)) AS p)),
firsts AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS entry FROM kept ORDER BY id LIMIT 256),
book0 AS (SELECT part, entry, v FROM pieces JOIN firsts USING (id)),
""" + "".join((_ASSIGN + _MOVE).format(k=k, next=k + 1) for k in range(4)) + _ASSIGN.format(k=4) + """
codes AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near4 GROUP BY id),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book4)
SELECT id AS vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (id), books
""",
    "op1_sharding": f"""
WITH RECURSIVE {_FILL.format(name="full_set", skip=0, n=24, slots=SLOTS, less=SLOTS - 1)},
{_FILL.format(name="less_one", skip=1, n=23, slots=SLOTS, less=SLOTS - 1)},
docs AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT doc_id, docs.slot, a.shard, (b.shard + 1)::INT AS shard_after_loss
FROM docs JOIN full_set_table a ON a.slot = docs.slot JOIN less_one_table b ON b.slot = docs.slot
""",
    "op3_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
""",
    "op6_line_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, t, unnest(range(len(ls))) AS line_no, unnest(ls) AS x FROM d),
l AS (
  SELECT doc_id, t, line_no, trim(regexp_replace(regexp_replace(x, '[^ \t\r\f\v]*[0-9][^ \t\r\f\v]*', '<*>', 'g'), '[ \t\r\f\v]+', ' ', 'g')) AS line
  FROM raw),
k AS (SELECT *, string_split(line, ' ') AS ts, concat(len(string_split(line, ' ')), ' ', array_to_string(string_split(line, ' ')[1:3], ' ')) AS leaf FROM l WHERE line <> ''),
left0 AS (SELECT leaf, line, any_value(ts) AS ts, count(DISTINCT doc_id) AS docs, count(DISTINCT t) AS texts FROM k GROUP BY leaf, line),
rounds AS (
  SELECT leaf, line, ts[4:] AS tail, docs, NULL::VARCHAR AS founder FROM left0 WHERE len(ts) > 3
  UNION ALL (
  WITH rest AS (SELECT leaf, line, tail, docs FROM rounds WHERE founder IS NULL),
  each AS (SELECT leaf, line, docs, pos, tail[pos] AS token FROM (SELECT *, unnest(range(1, len(tail) + 1)) AS pos FROM rest)),
  usual AS (SELECT leaf, pos, token, sum(docs) AS w FROM each GROUP BY ALL),
  weighed AS (SELECT leaf, line, docs, sum(w) AS mass, count(*) AS n, arg_min((pos, token), (-w, pos, token)) FILTER (WHERE w > docs) AS home, min(token) FILTER (WHERE pos = 1) AS start FROM each JOIN usual USING (leaf, pos, token) GROUP BY leaf, line, docs),
  able AS (SELECT *, row_number() OVER (PARTITION BY leaf, coalesce(home, (1::BIGINT, start)) ORDER BY mass DESC, docs DESC, line) AS place FROM weighed WHERE mass * 100 >= n * 60 * 10),
  firsts AS (SELECT leaf, line, tail, row_number() OVER (PARTITION BY leaf ORDER BY mass DESC, a.docs DESC, line) AS rank FROM able a JOIN rest USING (leaf, line) WHERE place = 1),
  few AS (SELECT * FROM firsts WHERE rank <= 8),
  founders AS (SELECT * FROM few f WHERE NOT EXISTS (SELECT 1 FROM few g WHERE g.leaf = f.leaf AND g.rank < f.rank AND {agree_fg})),
  joined AS (SELECT r.leaf, r.line, arg_min(f.line, f.rank) AS founder FROM rest r JOIN founders f ON f.leaf = r.leaf AND {agree_rf} GROUP BY r.leaf, r.line)
  SELECT rest.leaf, rest.line, rest.tail, rest.docs, joined.founder FROM rest LEFT JOIN joined USING (leaf, line) WHERE leaf IN (SELECT leaf FROM founders))),
placed AS (
  SELECT leaf, line, coalesce(founder, line) AS template
  FROM left0 LEFT JOIN (SELECT leaf, line, founder FROM rounds WHERE founder IS NOT NULL) USING (leaf, line)),
""".replace("{agree_fg}", _AGREE.format(a="f", b="g")).replace("{agree_rf}", _AGREE.format(a="r", b="f")) + r"""
found AS (
  SELECT leaf, template FROM k JOIN placed USING (leaf, line) GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= 10),
gone AS (
  SELECT doc_id, t, line_no FROM k JOIN placed USING (leaf, line) JOIN found USING (leaf, template)
  UNION
  SELECT doc_id, t, line_no FROM k JOIN left0 USING (leaf, line) WHERE len(left0.ts) > 50 AND texts >= 2),
kept AS (
  SELECT raw.doc_id, raw.t, count(gone.line_no) AS n_dropped, coalesce(string_agg(x, chr(10) ORDER BY raw.line_no) FILTER (WHERE gone.line_no IS NULL), '') AS text
  FROM raw LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.t = raw.t AND gone.line_no = raw.line_no GROUP BY raw.doc_id, raw.t)
SELECT d.doc_id, len(ls)::BIGINT AS n_lines, n_dropped, sha256(text) AS text_sha256 FROM d JOIN kept USING (doc_id, t)
""",
}
