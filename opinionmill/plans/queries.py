"""Registered queries over the shared tables and their SQL.

Reviews are derived from `orders` (nulls, negations, accents, every label
code); the labelled corpus for features and models is `documents` with the
quality of `labels`.  Computed doubles are rounded to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.labels import NEGATIVE, POSITIVE, normalise
from ..functions.stoplists import cleaning_words, vectoriser_words
from ..operators import columns, counting, features, joins, metrics, ml, naive_bayes, preprocess, profile, split, tuning, vocabulary, words
from ..session import shared_folder, stored
from ..sources import csv, files, positions, registry, split_csv
from ..streaming import jobs, progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

REVIEWS = """
SELECT o_orderkey AS review_id,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE concat(
    CASE o_orderkey % 5 WHEN 0 THEN 'I do not like this '
                        WHEN 1 THEN 'It isn''t working, the '
                        WHEN 2 THEN 'Very GOOD quality for a '
                        WHEN 3 THEN 'Don''t! I cannot return my '
                        ELSE 'Okay, nothing special about the ' END,
    lower(o_orderpriority), ' order (', o_orderstatus, '). ',
    CASE o_orderkey % 7 WHEN 0 THEN 'Absolutely terrible.'
                        WHEN 1 THEN 'Works perfectly!'
                        WHEN 2 THEN 'Would not buy again'
                        WHEN 3 THEN 'été très bon'
                        WHEN 4 THEN ''
                        WHEN 5 THEN 'Great value for money.'
                        ELSE 'Cars were driving by' END) END AS review_text,
  CASE WHEN o_orderkey % 89 = 0 THEN NULL
       ELSE cast(o_orderkey % 6 AS string) END AS sentiment
FROM {orders}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_id, review_text, sentiment."""
    return spark.sql(REVIEWS, orders=table(spark, sf_dir, "orders"))


def labelled_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews with `label` (three classes) and `tokens`."""
    rows = reviews(spark, sf_dir)
    return rows.withColumn("label", normalise(F.col("sentiment"))).withColumn("tokens", T.tokens(F.col("review_text")))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, label of the labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", "label")


def r6(c: F.Column | str) -> F.Column:
    return F.round(c, 6)


# -- SQL parts ----------------------------------------------------------------
def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


W, S = r"[\p{L}\p{N}_]", r"[\s\p{Z}]"
LABEL_SQL = f"CASE WHEN lower(sentiment) IN ({_list(POSITIVE)}) THEN 'positive' WHEN lower(sentiment) IN ({_list(NEGATIVE)}) THEN 'negative' ELSE 'neutral' END"
REVIEWS_SQL = f"reviews AS ({REVIEWS.format(orders='orders')})"
CLEAN_SQL = rf"""
{REVIEWS_SQL},
c1 AS (SELECT *, {LABEL_SQL} AS label, lower(CASE WHEN review_text IS NULL OR regexp_matches(review_text, '^{S}*$') THEN '' ELSE review_text END) AS c FROM reviews),
c2 AS (SELECT * REPLACE (replace(regexp_replace(regexp_replace(c, 'not{S}+({W}+)', 'not_\1', 'g'), 'n''t{S}+({W}+)', 'not_\1', 'g'), 'n''t', ' not') AS c) FROM c1),
c3 AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(c, '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^`{{|}}~]', ' ', 'g'), '([«»“”‘’„])', ' \1 ', 'g'), '\bcannot\b', 'can not', 'g') AS c) FROM c2),
c4 AS (SELECT *, list_filter(string_split_regex(c, '{S}+'), lambda t: t <> '') AS words FROM c3),
clean AS (SELECT *, list_filter(words, lambda t: t NOT IN ({_list(cleaning_words())})) AS tokens FROM c4)"""
DOCS_SQL = "docs AS (SELECT doc_id AS id, text, CASE quality WHEN 1 THEN 'positive' ELSE 'negative' END AS label FROM documents JOIN labels USING (doc_id))"


def _key(seed: int, column: str) -> str:
    return f"md5('{seed}:' || {column}::VARCHAR)"


def register(name: str, sql: str | None = None):
    """Adds a query, and its SQL if there is one."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# -- labels, profiles, filters ------------------------------------------------
@register("label_normalize", f"WITH {REVIEWS_SQL} SELECT review_id, {LABEL_SQL} AS label FROM reviews")
def label_normalize(spark, sf_dir):
    return reviews(spark, sf_dir).select("review_id", normalise(F.col("sentiment")).alias("label"))


@register(
    "label_stars",
    f"WITH {REVIEWS_SQL} SELECT review_id, CASE WHEN sentiment IN ('4', '5') THEN 'positive' WHEN sentiment IN ('0', '1', '2') THEN 'negative' ELSE 'neutral' END AS label FROM reviews",
)
def label_stars(spark, sf_dir):
    return reviews(spark, sf_dir).select("review_id", normalise(F.col("sentiment"), "stars").alias("label"))


@register(
    "sentiment_distribution",
    f"WITH {REVIEWS_SQL}, l AS (SELECT {LABEL_SQL} AS sentiment FROM reviews) SELECT sentiment, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS percent FROM l GROUP BY sentiment",
)
def sentiment_distribution(spark, sf_dir):
    return profile.sentiment_distribution(label_normalize(spark, sf_dir), "label")


@register(
    "missing_profile",
    f"""WITH {REVIEWS_SQL} SELECT 'review_text' AS "column", count(*) FILTER (WHERE review_text IS NULL) AS missing, round(count(*) FILTER (WHERE review_text IS NULL) / count(*)::DOUBLE, 6) AS ratio FROM reviews
UNION ALL SELECT 'sentiment', count(*) FILTER (WHERE sentiment IS NULL), round(count(*) FILTER (WHERE sentiment IS NULL) / count(*)::DOUBLE, 6) FROM reviews""",
)
def missing_profile(spark, sf_dir):
    return profile.missing_profile(reviews(spark, sf_dir), "review_text", "sentiment").withColumn("ratio", r6("ratio"))


@register(
    "text_length_stats",
    f"""WITH {REVIEWS_SQL}, l AS (SELECT length(review_text) AS k FROM reviews)
SELECT count(k) AS n, round(avg(k), 6) AS mean, round(stddev_samp(k), 6) AS std, min(k)::INT AS "min", quantile_cont(k, 0.25)::DOUBLE AS p25, quantile_cont(k, 0.5)::DOUBLE AS p50, quantile_cont(k, 0.75)::DOUBLE AS p75, max(k)::INT AS "max" FROM l""",
)
def text_length_stats(spark, sf_dir):
    return profile.text_length_stats(reviews(spark, sf_dir), "review_text").withColumns({"mean": r6("mean"), "std": r6("std")})


@register("text_length", f"WITH {REVIEWS_SQL} SELECT review_id, length(review_text)::DOUBLE AS text_length FROM reviews")
def text_length(spark, sf_dir):
    return profile.with_text_length(reviews(spark, sf_dir), "review_text").select("review_id", F.col("text_length").cast("double"))


@register("short_texts", f"WITH {REVIEWS_SQL} SELECT review_text, sentiment, length(review_text)::INT AS text_length FROM reviews WHERE length(review_text) < 45")
def short_texts(spark, sf_dir):
    return profile.short_texts(reviews(spark, sf_dir), "review_text", "sentiment", 45)


@register("class_list", f"WITH {REVIEWS_SQL} SELECT DISTINCT {LABEL_SQL} AS label FROM reviews")
def class_list(spark, sf_dir):
    return profile.class_list(reviews(spark, sf_dir), "sentiment")


@register("smallest_class", f"WITH {REVIEWS_SQL} SELECT {LABEL_SQL} AS label, count(*) AS n FROM reviews GROUP BY 1 ORDER BY n, label LIMIT 1")
def smallest_class(spark, sf_dir):
    return profile.smallest_class(label_normalize(spark, sf_dir), "label")


@register(
    "class_weights",
    f"WITH {REVIEWS_SQL}, c AS (SELECT {LABEL_SQL} AS label, count(*) AS n FROM reviews GROUP BY 1) SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE, 6) AS weight FROM c",
)
def class_weights(spark, sf_dir):
    return profile.class_weights(label_normalize(spark, sf_dir), "label").withColumn("weight", r6("weight"))


@register(
    "column_profile",
    f"""WITH {REVIEWS_SQL} SELECT 'review_id' AS "column", 'bigint' AS "type", count(review_id) AS n, count(DISTINCT review_id) AS "distinct", round(avg(length(review_id::VARCHAR)), 6) AS mean_length FROM reviews
UNION ALL SELECT 'review_text', 'string', count(review_text), count(DISTINCT review_text), round(avg(length(review_text)), 6) FROM reviews
UNION ALL SELECT 'sentiment', 'string', count(sentiment), count(DISTINCT sentiment), round(avg(length(sentiment)), 6) FROM reviews""",
)
def column_profile(spark, sf_dir):
    return columns.column_stats(reviews(spark, sf_dir)).withColumn("mean_length", r6("mean_length"))


@register(
    "detected_roles",
    """WITH s AS (SELECT avg(length(text)) AS l, count(*) AS n, count(DISTINCT quality) AS q, count(DISTINCT doc_id) AS d, count(DISTINCT n_chars) AS c FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'documents' AS source, v AS variant, CASE WHEN l > 20 THEN 'c1' WHEN v = 'chunk' THEN 'c0' ELSE 'c1' END AS text_column,
  CASE WHEN d <= 5 THEN 'c0' WHEN c <= 5 THEN 'c2' WHEN c < greatest(10, 0.1 * n) AND (c < d OR d >= greatest(10, 0.1 * n)) THEN 'c2' ELSE 'c0' END AS sentiment_column FROM s, (SELECT unnest(['full', 'chunk']) AS v)
UNION ALL SELECT 'labelled', v, CASE WHEN l > 20 OR v = 'full' THEN 'c1' ELSE 'c0' END, CASE WHEN d <= 5 THEN 'c0' WHEN q <= 5 THEN 'c2' ELSE 'c0' END FROM s, (SELECT unnest(['full', 'chunk']) AS v)
UNION ALL SELECT 'reviews', v, 'review_id', 'sentiment' FROM (SELECT unnest(['full', 'chunk']) AS v)""",
)
def detected_roles(spark, sf_dir):
    """Text and sentiment columns told from names, and from content where names tell nothing."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    sources = {"documents": docs.select("doc_id", "text", "n_chars").toDF("c0", "c1", "c2"), "labelled": docs.select("doc_id", "text", "quality").toDF("c0", "c1", "c2"), "reviews": reviews(spark, sf_dir)}
    found = [(name, variant, *columns.detect_columns(df, variant)) for name, df in sources.items() for variant in ("full", "chunk")]
    return spark.createDataFrame(found, "source string, variant string, text_column string, sentiment_column string")


@register("complete_rows", f"WITH {REVIEWS_SQL} SELECT * FROM reviews WHERE review_text IS NOT NULL AND sentiment IS NOT NULL")
def complete_rows(spark, sf_dir):
    return profile.complete(reviews(spark, sf_dir), "review_text", "sentiment")


@register("binary_filter", f"WITH {REVIEWS_SQL} SELECT review_id, {LABEL_SQL} AS label FROM reviews WHERE {LABEL_SQL} <> 'neutral'")
def binary_filter(spark, sf_dir):
    return profile.binary_only(label_normalize(spark, sf_dir), "label")


@register("known_classes", f"WITH {REVIEWS_SQL} SELECT review_id, {LABEL_SQL} AS label FROM reviews WHERE {LABEL_SQL} IN (SELECT CASE quality WHEN 1 THEN 'positive' ELSE 'negative' END FROM labels)")
def known_classes(spark, sf_dir):
    classes = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"))
    return profile.keep_classes(label_normalize(spark, sf_dir), "label", classes).select("review_id", "label")


@register("row_count", "SELECT count(*) AS n FROM orders")
def row_count(spark, sf_dir):
    return reviews(spark, sf_dir).agg(F.count("*").alias("n"))


@register("row_slice", f"WITH {REVIEWS_SQL} SELECT * FROM reviews ORDER BY review_id LIMIT 500 OFFSET 1000")
def row_slice(spark, sf_dir):
    """The feature itself: n rows after the first k."""
    return files.rows_between(reviews(spark, sf_dir), "review_id", 1000, 500)


@register("pasted_lines", r"SELECT conv_id, turn, unnest(range(len(l)))::INT AS line, unnest(l) AS text FROM (SELECT conv_id, turn, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS l FROM conversations WHERE text IS NOT NULL)")
def pasted_lines(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.split_lines(F.col("text"))).alias("line", "text"))


@register(
    "human_sizes",
    """WITH s AS (SELECT o_orderkey, (o_totalprice * (o_orderkey % 11) * (o_orderkey % 7) * 1000)::BIGINT AS n FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders))
SELECT o_orderkey, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.2f KB', round(n / 1024.0::DOUBLE, 2)) WHEN n < 1073741824 THEN printf('%.2f MB', round(n / 1048576.0::DOUBLE, 2)) ELSE printf('%.2f GB', round(n / 1073741824.0::DOUBLE, 2)) END AS size FROM s""",
)
def human_sizes(spark, sf_dir):
    n = F.floor("o_totalprice") * (F.col("o_orderkey") % 11) * (F.col("o_orderkey") % 7) * 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", T.human_size(n).alias("size"))


# -- text ---------------------------------------------------------------------
@register("preprocess_text", f"WITH {CLEAN_SQL} SELECT review_id, array_to_string(tokens, ' ') AS processed_text FROM clean")
def preprocess_text(spark, sf_dir):
    return preprocess.preprocess(reviews(spark, sf_dir), "review_text").select("review_id", "processed_text")


@register("tokenize", f"WITH {CLEAN_SQL} SELECT review_id, array_to_string(words, '|') AS words FROM clean")
def tokenize(spark, sf_dir):
    return reviews(spark, sf_dir).select("review_id", F.array_join(T.tokens(F.col("review_text"), remove_stopwords=False), "|").alias("words"))


@register("negation_tokens", f"WITH {CLEAN_SQL}, u AS (SELECT unnest(words) AS word FROM clean) SELECT word, count(*) AS n FROM u WHERE contains(word, 'not') GROUP BY word")
def negation_tokens(spark, sf_dir):
    found = reviews(spark, sf_dir).select(F.explode(T.tokens(F.col("review_text"), remove_stopwords=False)).alias("word"))
    return found.where(F.col("word").contains("not")).groupBy("word").agg(F.count("*").alias("n"))


@register(
    "ngrams",
    f"WITH {CLEAN_SQL}, u AS (SELECT unnest(list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))) AS term FROM clean) SELECT term, count(*) AS n FROM u GROUP BY term",
)
def ngrams(spark, sf_dir):
    rows = labelled_reviews(spark, sf_dir)
    return rows.select(F.explode(T.ngrams(F.col("tokens"), 1, 2)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


TOP_SQL = f"{CLEAN_SQL}, u AS (SELECT label, unnest(tokens) AS word FROM clean), n AS (SELECT label, word, count(*) AS n FROM u GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, word)::INT AS rank FROM n)"


@register("top_words_by_sentiment", f"WITH {TOP_SQL} SELECT label, word, n, rank FROM top WHERE rank <= 15")
def top_words_by_sentiment(spark, sf_dir):
    return words.top_words(labelled_reviews(spark, sf_dir), "tokens", "label", 15)


@register("wordcloud_weights", f"WITH {TOP_SQL} SELECT label, word, n, rank, round(n / max(n) OVER (PARTITION BY label)::DOUBLE, 6) AS weight FROM top WHERE rank <= 100")
def wordcloud_weights(spark, sf_dir):
    return words.cloud_weights(labelled_reviews(spark, sf_dir), "tokens", "label", n=100).withColumn("weight", r6("weight"))


_PART = "(ln(greatest({p}, 1e-10)) * {k} + ln(greatest(1 - {p}, 1e-10)) * ({n} - {k}))"
PAIRS_SQL = f"""{CLEAN_SQL}, u AS (SELECT label, unnest(tokens) AS word FROM clean), n AS (SELECT label, word, count(*) AS n FROM u GROUP BY ALL),
pairs AS (SELECT label, first, second, count(*)::DOUBLE AS k FROM (SELECT label, unnest(list_transform(range(1, len(tokens)), lambda i: {{'first': tokens[i], 'second': tokens[i + 1]}}), recursive := true) FROM clean) GROUP BY ALL),
facts AS (SELECT p.*, a.n::DOUBLE AS one, b.n::DOUBLE AS two, t.n::DOUBLE AS whole FROM pairs p JOIN n a ON a.label = p.label AND a.word = p.first JOIN n b ON b.label = p.label AND b.word = p.second JOIN (SELECT label, sum(n) AS n FROM n GROUP BY label) t ON t.label = p.label),
scores AS (SELECT label, first, second, k::BIGINT AS n, -2 * ({_PART.format(p='two / whole', k='k', n='one')} + {_PART.format(p='two / whole', k='(two - k)', n='(whole - one)')}
  - {_PART.format(p='k / one', k='k', n='one')} - {_PART.format(p='(CASE WHEN whole > one THEN (two - k) / (whole - one) ELSE 0 END)', k='(two - k)', n='(whole - one)')}) AS score FROM facts),
held AS (SELECT * FROM scores WHERE score > 30),
spent AS (SELECT label, word, sum(n) AS n FROM (SELECT label, word, n FROM n UNION ALL SELECT label, first, -n FROM held UNION ALL SELECT label, second, -n FROM held) GROUP BY ALL HAVING sum(n) > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, word)::INT AS rank FROM (SELECT label, word, n::BIGINT AS n FROM spent UNION ALL SELECT label, first || ' ' || second, n FROM held))"""


@register("pair_scores", f"WITH {PAIRS_SQL} SELECT label, first, second, n, round(score, 4) AS score FROM scores")
def pair_scores(spark, sf_dir):
    return words.pair_scores(labelled_reviews(spark, sf_dir), "tokens", "label").withColumn("score", F.round("score", 4))


@register("wordcloud_phrases", f"WITH {PAIRS_SQL} SELECT label, word, n, rank, round(n / max(n) OVER (PARTITION BY label)::DOUBLE, 6) AS weight FROM top WHERE rank <= 100")
def wordcloud_phrases(spark, sf_dir):
    return words.cloud_phrases(labelled_reviews(spark, sf_dir), "tokens", "label").withColumn("weight", r6("weight"))


# A lexicon for the words of the derived reviews.
LEXICON = [("running", "v", "run"), ("jumping", "v", "jump"), ("driving", "v", "drive"), ("works", "v", "work"), ("working", "v", "work"), ("cars", "n", "car"), ("works", "n", "work")]
LEXICON_SQL = "lexicon(form, pos, lemma) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in LEXICON) + ")"


@register(
    "lemmas",
    f"""WITH {CLEAN_SQL}, {LEXICON_SQL},
u AS (SELECT review_id, unnest(range(len(tokens))) AS k, unnest(tokens) AS form FROM clean),
m AS (SELECT form, coalesce(max(lemma) FILTER (WHERE pos = 'v' AND lemma <> form), max(lemma) FILTER (WHERE pos = 'n')) AS lemma FROM lexicon GROUP BY form),
j AS (SELECT review_id, string_agg(coalesce(lemma, form), ' ' ORDER BY k) AS t FROM u LEFT JOIN m USING (form) GROUP BY review_id)
SELECT review_id, coalesce(t, '') AS processed_text FROM clean LEFT JOIN j USING (review_id)""",
)
def lemmas(spark, sf_dir):
    lexicon = spark.createDataFrame(LEXICON, "form string, pos string, lemma string")
    return preprocess.preprocess(reviews(spark, sf_dir), "review_text", id_col="review_id", lexicon=lexicon).select("review_id", "processed_text")


@register(
    "noun_lemmas",
    f"""WITH {CLEAN_SQL}, {LEXICON_SQL},
u AS (SELECT review_id, unnest(range(len(tokens))) AS k, unnest(tokens) AS form FROM clean),
m AS (SELECT form, max(lemma) AS lemma FROM lexicon WHERE pos = 'n' GROUP BY form),
j AS (SELECT review_id, string_agg(coalesce(lemma, form), ' ' ORDER BY k) AS t FROM u LEFT JOIN m USING (form) GROUP BY review_id)
SELECT review_id, coalesce(t, '') AS processed_text FROM clean LEFT JOIN j USING (review_id)""",
)
def noun_lemmas(spark, sf_dir):
    lexicon = spark.createDataFrame(LEXICON, "form string, pos string, lemma string")
    return preprocess.preprocess(reviews(spark, sf_dir), "review_text", id_col="review_id", lexicon=lexicon, mode="noun").select("review_id", "processed_text")


@register("stem_tokens")
def stem_tokens(spark, sf_dir):
    rows = preprocess.preprocess(reviews(spark, sf_dir), "review_text", perform_stemming=True, perform_lemmatization=False, id_col="review_id")
    return rows.select("review_id", "processed_text")


# -- splits and samples -------------------------------------------------------
SPLIT_SQL = f"""{REVIEWS_SQL}, l AS (SELECT review_id, {LABEL_SQL} AS label FROM reviews),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_key(42, 'review_id')}, review_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM l)"""
SHARE_SQL = f"('0x' || substr({_key(42, 'review_id')}, 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@register("stratified_split", f"WITH {SPLIT_SQL} SELECT review_id, label, r <= ceil(n * 0.2::DOUBLE) AS is_test FROM k")
def stratified_split(spark, sf_dir):
    return split.stratified_split(label_normalize(spark, sf_dir), "review_id", "label")


@register("fold_assign", f"WITH {SPLIT_SQL} SELECT review_id, label, ((r - 1) % 3)::INT AS fold FROM k")
def fold_assign(spark, sf_dir):
    return split.folds(label_normalize(spark, sf_dir), "review_id", "label", 3)


@register(
    "tuning_subset",
    f"""WITH {SPLIT_SQL}, c AS (SELECT label, count(*) AS m, count(*) * 1000 / (SELECT count(*) FROM l)::DOUBLE AS x FROM l GROUP BY label),
q AS (SELECT label, floor(x) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, label) <= 1000 - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota FROM c)
SELECT review_id, label FROM k JOIN q USING (label) WHERE r <= quota OR (SELECT count(*) FROM l) <= 2000""",
)
def tuning_subset(spark, sf_dir):
    """The feature itself: exactly n rows, each class in proportion."""
    return split.tuning_subset(label_normalize(spark, sf_dir), "review_id", "label", n=1000, beyond=2000)


@register("hash_sample", f"WITH {REVIEWS_SQL} SELECT review_id FROM reviews WHERE {SHARE_SQL} < 0.1")
def hash_sample(spark, sf_dir):
    return split.bernoulli_sample(reviews(spark, sf_dir), "review_id", 10).select("review_id")


@register("exact_sample", f"WITH {REVIEWS_SQL} SELECT review_id FROM reviews ORDER BY {_key(42, 'review_id')}, review_id LIMIT (SELECT least(1000, count(*) // 100) FROM orders)")
def exact_sample(spark, sf_dir):
    """The feature itself: a sample of exactly min(1000, 1 %) rows."""
    return split.exact_sample(reviews(spark, sf_dir), "review_id").select("review_id")


@register("hash_split", f"WITH {REVIEWS_SQL} SELECT review_id, {SHARE_SQL} < 0.2 AS is_test FROM reviews")
def hash_split(spark, sf_dir):
    return split.hash_split(reviews(spark, sf_dir), "review_id").select("review_id", "is_test")


@register("thinned_rows", f"WITH {REVIEWS_SQL} SELECT review_id, {LABEL_SQL} AS label FROM reviews WHERE {SHARE_SQL} < 0.5")
def thinned_rows(spark, sf_dir):
    return split.thinned(label_normalize(spark, sf_dir), "review_id", "label")


@register(
    "thinned_by_position",
    """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, count(*) OVER () AS n FROM orders),
c AS (SELECT o_orderkey, position, position // 100 AS chunk, greatest(1, n // 100) AS total, greatest(10, greatest(1, n // 100) // 4) AS kept FROM p),
e AS (SELECT *, kept // 3 AS edge, (total - 2 * (kept // 3)) // (kept - 2 * (kept // 3)) AS middle FROM c)
SELECT o_orderkey, position FROM e WHERE middle <= 1 OR chunk <= edge OR chunk >= total - edge OR (chunk - edge) % middle = 0""",
)
def thinned_by_position(spark, sf_dir):
    """The feature itself: chunks of 100 rows, the first and last ones whole, in between every so many."""
    rows = positions.with_positions(table(spark, sf_dir, "orders")).select("o_orderkey", "position")
    return split.thinned_by_position(rows, "position", 100)


# -- features and naive Bayes -------------------------------------------------
def _marked(spark, sf_dir) -> tuple[DataFrame, int, DataFrame | None]:
    """id, label, is_test of the documents; the number of training rows; id, label, is_test and tokens (`features.cut_texts`), None where ids repeat."""
    marks = stored(split.stratified_split(corpus(spark, sf_dir).select("id", "label"), "id", "label"), "marks")
    n_train = marks.where(~F.col("is_test")).count()
    if counting.ids_repeat(marks, "id"):
        return marks, n_train, None
    # Each document meets its mark before it is cut into tokens; vocabulary, sums and scores read the tokens that are left.
    rows = joins.text_join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), marks, "id")
    return marks, n_train, stored(features.cut_texts(rows, "id", "text", keep=["label", "is_test"]), "tokens")


def _repeated(spark, sf_dir, marks: DataFrame, n_train: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training and test weights and the vocabulary where ids repeat: the counts of an id's rows are added up."""
    counts = stored(features.term_rows(corpus(spark, sf_dir), "id", "text", repeats=True).join(marks, "id"), "counts")
    train, test = counts.where(~F.col("is_test")).drop("is_test"), counts.where("is_test").select("id", "term", "tf")
    model = stored(features.fit_tfidf(train, n_train), "vocabulary")
    return features.tfidf(train, model), features.tfidf(test, model), model


def _tfidf_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """id, label, is_test of the documents; TF-IDF weights of training (with label) and test documents under the training vocabulary; the vocabulary."""
    marks, n_train, rows = _marked(spark, sf_dir)
    if rows is None:
        return marks, *_repeated(spark, sf_dir, marks, n_train)
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    model = stored(features.fit_texts(train, "id", "tokens", n_train, cut=True), "vocabulary")
    return marks, features.tfidf_rows(train, "id", "tokens", model, keep=["label"], cut=True), features.tfidf_rows(test, "id", "tokens", model, cut=True), model


def _nb(spark, sf_dir) -> tuple[naive_bayes.NaiveBayes, DataFrame, Callable[[], DataFrame]]:
    """The model of the training documents; id and label of the test documents; what predicts them."""
    marks, n_train, rows = _marked(spark, sf_dir)
    counts, asked = naive_bayes.class_counts(marks.where(~F.col("is_test"))), marks.where("is_test")
    # Sums and model are small, and several jobs read them.
    if rows is None:
        train, test, _ = _repeated(spark, sf_dir, marks, n_train)
        model = naive_bayes.from_counts(counts, stored(naive_bayes.term_sums(train), "sums"))
        return model, asked, lambda: naive_bayes.predict(model, asked, test)
    train = rows.where(~F.col("is_test"))
    vocabulary = stored(features.fit_texts(train, "id", "tokens", n_train, cut=True), "vocabulary")
    model = naive_bayes.from_counts(counts, stored(naive_bayes.text_sums(train, vocabulary), "sums"))
    return model, asked, lambda: naive_bayes.predictions(naive_bayes.text_scores(model, rows.where("is_test"), vocabulary))


def _counts_sql(stop_words: list[str]) -> str:
    kept = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '{W}{{2,}}'), lambda t: t NOT IN ({_list(stop_words)}))"
    return f"""{DOCS_SQL},
marked AS (SELECT id, label, text, row_number() OVER (PARTITION BY label ORDER BY {_key(42, 'id')}, id) <= ceil(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) AS is_test FROM docs),
toks AS (SELECT id, {kept} AS ts FROM docs),
spread AS (SELECT id, unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]))) AS term FROM toks),
counts AS (SELECT id, term, count(*) AS tf FROM spread GROUP BY ALL)"""


def _vocabulary_sql(source: str, n: str) -> str:
    return f"""vocab AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM {source} GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.8::DOUBLE * ({n}) ORDER BY ctf DESC, term LIMIT 5000)"""


def _weights_sql(n: str) -> str:
    return f"""raw AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + ({n})) / (1 + df)::DOUBLE) + 1) AS w FROM counts JOIN vocab USING (term)),
weights AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""


def _sql_parts(stop_words: list[str]) -> dict[str, str]:
    """SQL of the feature and naive Bayes queries."""
    base = _counts_sql(stop_words)
    n_all, n_train = "SELECT count(*) FROM docs", "SELECT count(*) FROM marked WHERE NOT is_test"
    model = f"""{base}, train_counts AS (SELECT counts.* FROM counts JOIN marked USING (id) WHERE NOT is_test), {_vocabulary_sql('train_counts', n_train)}, {_weights_sql(n_train)},
sums AS (SELECT label, term, sum(w) AS s FROM weights JOIN marked USING (id) WHERE NOT is_test GROUP BY ALL),
classes AS (SELECT label, ln(count(*) / ({n_train})::DOUBLE) AS prior FROM marked WHERE NOT is_test GROUP BY label),
dense AS (SELECT c.label, v.term, ln(coalesce(s, 0) + 1) - ln(sum(coalesce(s, 0)) OVER (PARTITION BY c.label) + (SELECT count(*) FROM vocab)) AS lp
          FROM classes c CROSS JOIN vocab v LEFT JOIN sums USING (label, term))"""
    scored = f"""{model},
gained AS (SELECT id, d.label, sum(w * lp) AS g FROM weights JOIN dense d USING (term) GROUP BY ALL),
scored AS (SELECT m.id, m.label AS truth, c.label, prior + coalesce(g, 0) AS score FROM marked m CROSS JOIN classes c LEFT JOIN gained ON gained.id = m.id AND gained.label = c.label WHERE is_test),
probs AS (SELECT id, truth, label, score, exp(score - max(score) OVER w) / sum(exp(score - (SELECT max(s2.score) FROM scored s2 WHERE s2.id = scored.id))) OVER w AS p FROM scored WINDOW w AS (PARTITION BY id)),
predicted AS (SELECT id, any_value(truth) AS label, arg_min(label, (-score, label)) AS prediction, max(p) AS confidence FROM probs GROUP BY id)"""
    matrix = f"""{scored}, names AS (SELECT label FROM predicted UNION SELECT prediction FROM predicted),
matrix AS (SELECT a.label, b.label AS prediction, count(p.id) AS n FROM names a CROSS JOIN names b LEFT JOIN predicted p ON p.label = a.label AND p.prediction = b.label GROUP BY ALL),
each AS (SELECT x.label, (SELECT n FROM matrix WHERE label = x.label AND prediction = x.label) AS tp, (SELECT sum(n) FROM matrix WHERE label = x.label)::BIGINT AS t, (SELECT sum(n) FROM matrix WHERE prediction = x.label)::BIGINT AS p FROM names x),
ratios AS (SELECT label AS class, coalesce(tp / nullif(p, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(t, 0)::DOUBLE, 0) AS recall, t AS support, tp FROM each),
report AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM ratios)"""
    total = """(SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1, sum(support)::BIGINT AS n FROM report)"""
    hashed_rows = f"{_counts_sql(['']).split('spread AS')[0]} spread AS (SELECT id, unnest(ts) AS term FROM toks), counts AS (SELECT id, term, count(*) AS tf FROM spread GROUP BY ALL), weights AS (SELECT id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id))::DOUBLE AS w FROM counts)"
    grid = f"""{_counts_sql([''])},
learnt AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_key(42, 'id')}, id) AS r FROM marked WHERE NOT is_test),
shares AS (SELECT label, count(*) * 10000 / (SELECT count(*) FROM learnt)::DOUBLE AS x FROM learnt GROUP BY label),
quotas AS (SELECT label, floor(x) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, label) <= 10000 - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
folded AS (SELECT id, label, ((row_number() OVER (PARTITION BY label ORDER BY r) - 1) % 3)::INT AS fold FROM learnt JOIN quotas USING (label) WHERE r <= quota OR (SELECT count(*) FROM learnt) <= 20000),
c AS (SELECT counts.*, label, fold FROM counts JOIN folded USING (id)),
settings AS (SELECT ngrams, mf, lo, hi, row_number() OVER () AS v FROM (SELECT unnest({tuning.GRID_NGRAMS}) AS ngrams), (SELECT unnest({tuning.GRID_FEATURES}) AS mf), (SELECT unnest({tuning.GRID_MIN_DF}::DOUBLE[]) AS lo), (SELECT unnest({tuning.GRID_MAX_DF}::DOUBLE[]) AS hi)),
alphas AS (SELECT unnest({tuning.GRID_ALPHA}::DOUBLE[]) AS a),
ks AS (SELECT unnest([0, 1, 2]) AS k),
sizes AS (SELECT k, count(*) AS n FROM folded JOIN ks ON fold <> k GROUP BY k),
stats AS (SELECT k, term, count(*) AS df, sum(tf) AS ctf FROM c JOIN ks ON fold <> k GROUP BY k, term),
held AS (SELECT * FROM (SELECT v, mf, k, n, term, df, row_number() OVER (PARTITION BY v, k ORDER BY ctf DESC, term) AS place FROM stats JOIN sizes USING (k) JOIN settings ON df >= lo AND df <= hi * n AND (ngrams = 2 OR NOT contains(term, ' '))) WHERE place <= mf),
ws AS (SELECT v, k, id, label, fold, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN held USING (term)),
us AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY v, k, id)) AS u FROM ws),
sums AS (SELECT v, k, term, label, sum(u) AS s FROM us WHERE fold <> k GROUP BY ALL),
totals AS (SELECT v, k, label, sum(s) AS total FROM sums GROUP BY ALL),
rooms AS (SELECT v, k, count(*) AS size FROM held GROUP BY ALL),
classes AS (SELECT k, label AS class, ln(count(*) / any_value(n)::DOUBLE) AS prior FROM folded JOIN ks ON fold <> k JOIN sizes USING (k) GROUP BY k, label),
gained AS (
  SELECT us.v, us.k, us.id, class, a, sum(u * (ln(coalesce(s, 0) + a) - ln(coalesce(total, 0) + a * size))) AS g
  FROM us JOIN classes ON classes.k = us.k JOIN rooms ON rooms.v = us.v AND rooms.k = us.k CROSS JOIN alphas
  LEFT JOIN totals ON totals.v = us.v AND totals.k = us.k AND totals.label = class LEFT JOIN sums ON sums.v = us.v AND sums.k = us.k AND sums.term = us.term AND sums.label = class
  WHERE us.fold = us.k GROUP BY ALL),
scored AS (
  SELECT f.id, f.label, f.fold, c.class, s.v, alphas.a, prior + coalesce(g, 0) AS score
  FROM folded f JOIN classes c ON c.k = f.fold CROSS JOIN settings s CROSS JOIN alphas LEFT JOIN gained g ON g.v = s.v AND g.k = f.fold AND g.id = f.id AND g.class = c.class AND g.a = alphas.a),
predicted AS (SELECT id, label, fold, v, a, arg_min(class, (-round(score, 9), class)) AS prediction FROM scored GROUP BY id, label, fold, v, a),
names AS (SELECT label AS class FROM predicted UNION SELECT prediction FROM predicted),
f AS (SELECT fold, v, a, class, 2 * count(*) FILTER (WHERE label = class AND prediction = class) / nullif(count(*) FILTER (WHERE label = class) + count(*) FILTER (WHERE prediction = class), 0)::DOUBLE AS f1, count(*) FILTER (WHERE label = class) AS t FROM predicted CROSS JOIN names GROUP BY ALL),
by_fold AS (SELECT fold, v, a, sum(coalesce(f1, 0) * t) / sum(t) AS f1 FROM f GROUP BY ALL)
SELECT ngrams, mf AS max_features, lo AS min_df, hi AS max_df, a AS alpha, round(avg(f1), 6) AS f1 FROM by_fold JOIN settings USING (v) GROUP BY ALL"""
    pairs = hashed_rows.replace("unnest(ts) AS term", "unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]))) AS term")
    return {
        "nb_grid_scores": f"WITH {grid}",
        "tfidf_vectors": f"WITH {base}, {_vocabulary_sql('counts', n_all)}, {_weights_sql(n_all)} SELECT id, term, round(w, 6) AS weight FROM weights",
        "hashed_pairs": f"WITH {pairs} SELECT id, term, round(w, 6) AS weight FROM weights",
        "vocabulary_pruned": f"WITH {base}, {_vocabulary_sql('counts', n_all)} SELECT term, df, ctf FROM vocab",
        "tfidf_weights": f"WITH {base}, {_vocabulary_sql('counts', n_all)}, {_weights_sql(n_all)} SELECT id, term, round(w, 6) AS weight FROM weights",
        "feature_names": f"WITH {base}, {_vocabulary_sql('counts', n_all)} SELECT (row_number() OVER (ORDER BY term) - 1)::INT AS idx, term FROM vocab",
        "hashed_weights": f"WITH {hashed_rows} SELECT id, term, round(w, 6) AS weight FROM weights",
        "nb_model": f"WITH {model} SELECT label, term, round(lp, 6) AS lp FROM dense",
        "nb_large_model": f"WITH {hashed_rows}, sums AS (SELECT label, term, sum(w) AS s FROM weights JOIN docs USING (id) GROUP BY ALL) SELECT label, term, round(ln(s + 1.5) - ln(sum(s) OVER (PARTITION BY label) + 1.5 * 262144), 6) AS lp FROM sums",
        "nb_predict": f"WITH {scored} SELECT id, label, prediction, round(confidence, 6) AS confidence FROM predicted",
        "nb_predict_proba": f"WITH {scored} SELECT id, label, round(p, 6) AS probability FROM (SELECT id, label, p FROM probs)",
        "overall_importance": f"""WITH {model}, o AS (SELECT a.label AS class, a.term, a.lp - max(b.lp) AS weight FROM dense a JOIN dense b ON a.term = b.term AND a.label <> b.label GROUP BY a.label, a.term, a.lp),
m AS (SELECT term, avg(abs(round(weight, 9))) AS weight FROM o GROUP BY term)
SELECT row_number() OVER (ORDER BY weight DESC, term)::INT AS rank, term, round(weight, 6) AS weight FROM m ORDER BY rank LIMIT 15""",
        "confidence_columns": f"WITH {scored} SELECT id, any_value(prediction) AS prediction, round(max(p) FILTER (WHERE label = 'negative'), 6) AS confidence_negative, round(max(p) FILTER (WHERE label = 'positive'), 6) AS confidence_positive FROM probs JOIN (SELECT id, prediction FROM predicted) USING (id) GROUP BY id",
        "nb_log_odds": f"""WITH {model}, o AS (SELECT a.label AS class, a.term, a.lp - max(b.lp) AS weight FROM dense a JOIN dense b ON a.term = b.term AND a.label <> b.label GROUP BY a.label, a.term, a.lp),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY round(weight, 9) DESC, term)::INT AS rank FROM o) SELECT class, rank, term, round(weight, 6) AS weight FROM r WHERE rank <= 20""",
        "confusion_matrix": f"WITH {matrix} SELECT label, prediction, n FROM matrix",
        "weighted_metrics": f"WITH {matrix} SELECT *, accuracy >= 0.92 AS meets_target FROM {total}",
        "class_report": f"""WITH {matrix} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM report
UNION ALL SELECT 'weighted avg', precision, recall, f1, n FROM {total}""",
        "model_comparison_long": f"""WITH {matrix}, m AS {total}, same AS (SELECT 'Naive Bayes' AS "Model", * FROM m UNION ALL SELECT 'Majority', round(max(c) / sum(c)::DOUBLE, 6), round((max(c) / sum(c)::DOUBLE) ^ 2, 6), round(max(c) / sum(c)::DOUBLE, 6), round(2 * (max(c) / sum(c)::DOUBLE) ^ 2 / (1 + max(c) / sum(c)::DOUBLE), 6), sum(c)::BIGINT FROM (SELECT label, count(*) AS c FROM predicted GROUP BY label))
SELECT "Model", 'Accuracy' AS "Metric", accuracy AS "Score" FROM same UNION ALL SELECT "Model", 'Precision', precision FROM same UNION ALL SELECT "Model", 'Recall', recall FROM same UNION ALL SELECT "Model", 'F1', f1 FROM same""",
    }


@register("vocabulary_pruned")
def vocabulary_pruned(spark, sf_dir):
    rows = stored(features.tokens(corpus(spark, sf_dir), "id", "text"), "tokens")
    return features.fit_texts(rows, "id", "tokens", rows.count()).drop("idf")


@register("tfidf_weights")
def tfidf_weights(spark, sf_dir):
    return features.fit_transform_tfidf(corpus(spark, sf_dir), "id", "text")[0].withColumn("weight", r6("weight"))


@register("tfidf_vectors")
def tfidf_vectors(spark, sf_dir):
    """The weights of tfidf_weights, made by the Spark ML stages that the classifiers use."""
    rows = corpus(spark, sf_dir).select("id", F.coalesce("text", F.lit("")).alias("processed_text"))
    model = Pipeline(stages=ml.feature_stages(stop_words=vectoriser_words())).fit(rows)
    vector = F.unwrap_udt("features")
    found = model.transform(rows).select("id", F.explode(F.arrays_zip(vector["indices"].alias("at"), vector["values"].alias("weight"))).alias("x"))
    names = spark.createDataFrame(list(enumerate(model.stages[-1].vocabulary)), "at int, term string")
    return found.select("id", "x.*").join(F.broadcast(names), "at").select("id", "term", r6("weight").alias("weight"))


@register("hashed_pairs")
def hashed_pairs(spark, sf_dir):
    """Words and pairs with the weights that they have before they are hashed to buckets."""
    return features.hashed(corpus(spark, sf_dir), "id", "text", 1 << 18, (1, 2), by_term=True).withColumn("weight", r6("weight"))


@register("feature_names")
def feature_names(spark, sf_dir):
    return features.feature_names(vocabulary_pruned(spark, sf_dir))


@register("hashed_weights")
def hashed_weights(spark, sf_dir):
    return features.hashed(corpus(spark, sf_dir), "id", "text", by_term=True).withColumn("weight", r6("weight"))


@register("nb_model")
def nb_model(spark, sf_dir):
    return naive_bayes.dense_terms(_nb(spark, sf_dir)[0]).withColumn("lp", r6("lp"))


@register("nb_large_model")
def nb_large_model(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    model = naive_bayes.fit(features.hashed(rows, "id", "text", by_term=True, keep=["label"]), rows.select("id", "label"), 1.5, 1 << 18)
    return model.terms.select("label", "term", r6("lp").alias("lp"))


def _predicted(spark, sf_dir) -> DataFrame:
    _, rows, predict = _nb(spark, sf_dir)
    return predict().join(rows.select("id", "label"), "id")


@register("nb_predict")
def nb_predict(spark, sf_dir):
    return _predicted(spark, sf_dir).select("id", "label", "prediction", r6("confidence").alias("confidence"))


@register("nb_predict_proba")
def nb_predict_proba(spark, sf_dir):
    return _predicted(spark, sf_dir).select("id", F.explode("probabilities").alias("label", "p")).select("id", "label", r6("p").alias("probability"))


@register("nb_grid_scores")
def nb_grid_scores(spark, sf_dir):
    """Cross-validated F1 of all 64 settings of naive Bayes, on the rows that cross_validate tunes on."""
    docs = corpus(spark, sf_dir)
    training = split.stratified_split(docs.select("id", "label"), "id", "label").where(~F.col("is_test")).drop("is_test")
    folded = stored(split.folds(split.tuning_subset(training, "id", "label"), "id", "label", 3), "folds")
    return tuning.naive_bayes_grid(docs.drop("label").join(folded, "id")).withColumn("f1", r6("f1"))


@register("nb_log_odds")
def nb_log_odds(spark, sf_dir):
    return naive_bayes.log_odds(_nb(spark, sf_dir)[0]).withColumn("weight", r6("weight"))


@register("overall_importance")
def overall_importance(spark, sf_dir):
    """Terms by their mean absolute log-odds over the classes, in the order in which they are shown."""
    odds = naive_bayes.log_odds(_nb(spark, sf_dir)[0], n=1 << 30).select("class", "term", F.round("weight", 9).alias("coefficient"))
    shown = ml.display_order(ml.importance(odds, 20).where("class = 'all'"))
    return shown.select("rank", "term", r6("weight").alias("weight"))


@register("confidence_columns")
def confidence_columns(spark, sf_dir):
    """Predictions with one column a class, picked by their prefix."""
    wide = naive_bayes.confidence_columns(_predicted(spark, sf_dir), ["negative", "positive"])
    return columns.with_prefix(wide.withColumns({c: r6(c) for c in wide.columns if c.startswith("confidence_")}), ["id", "prediction"])


@register("confusion_matrix")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_predicted(spark, sf_dir))


@register("weighted_metrics")
def weighted_metrics(spark, sf_dir):
    found = metrics.weighted_metrics(_predicted(spark, sf_dir))
    return found.withColumns({c: r6(c) for c in ("accuracy", "precision", "recall", "f1")})


@register("class_report")
def class_report(spark, sf_dir):
    return metrics.class_report(_predicted(spark, sf_dir)).withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@register("model_comparison_long")
def model_comparison_long(spark, sf_dir):
    """Naive Bayes against always predicting the test rows' most frequent class."""
    rows = stored(_predicted(spark, sf_dir).select("label", "prediction"), "predicted")
    first = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").first()
    parts = {"Naive Bayes": metrics.weighted_metrics(rows).first(), "Majority": metrics.weighted_metrics(rows.withColumn("prediction", F.lit(first["label"]))).first()}
    wide = metrics.comparison(spark, {k: v.asDict() for k, v in parts.items()})
    return metrics.comparison_long(wide).withColumn("Score", r6("Score"))


# -- sources ------------------------------------------------------------------
@register("dedupe_columns", "SELECT o_orderkey AS id, o_custkey AS id_1, o_orderstatus AS value, o_totalprice AS id_2 FROM orders")
def dedupe_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").toDF("id", "id", "value", "id")
    return columns.deduplicate_columns(rows)[0]


@register(
    "tolerant_csv",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE lower(o_orderpriority) END AS text, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE (o_orderkey % 6)::DOUBLE END AS rating
FROM orders WHERE o_orderkey % 10 <> 7""",
)
def tolerant_csv(spark, sf_dir):
    """A CSV made from `orders`, some rows with a field too many (left out) and some short (filled with nulls), read tolerantly."""
    key = F.col("o_orderkey")
    line = F.concat_ws(",", key.cast("string"), F.lower("o_orderpriority"), (key % 6).cast("string"))
    line = F.when(key % 10 == 7, F.concat(line, F.lit(",one too many"))).when(key % 10 == 3, key.cast("string")).otherwise(line)
    path = shared_folder(spark, "csv")
    # The one column's name is the header, with which every file begins.
    table(spark, sf_dir, "orders").select(line.alias("id,text,rating")).write.option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\u0001").csv(path)
    return csv.read_tolerant(spark, path).withColumn("rating", F.col("rating").cast("double"))


@register(
    "tolerant_csv_blanks",
    "SELECT o_orderkey AS id, lower(o_orderstatus) AS status, (o_orderkey % 6)::DOUBLE AS rating FROM orders WHERE o_orderkey % 10 <> 7",
)
def tolerant_csv_blanks(spark, sf_dir):
    """As tolerant_csv, with fields that a blank separates."""
    key = F.col("o_orderkey")
    line = F.concat_ws(" ", key.cast("string"), F.lower("o_orderstatus"), (key % 6).cast("string"))
    path = shared_folder(spark, "csv")
    rows = table(spark, sf_dir, "orders").select(F.when(key % 10 == 7, F.concat(line, F.lit(" more"))).otherwise(line).alias("id status rating"))
    rows.write.option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\u0001").csv(path)
    return csv.read_tolerant(spark, path).withColumn("rating", F.col("rating").cast("double"))


BROKEN = "concat(review_text, chr(10), '\"quoted, text\"', chr(10), chr(10), review_id)"


@register("csv_split", f"WITH {REVIEWS_SQL} SELECT review_id, {BROKEN} AS review_text, sentiment::DOUBLE AS sentiment FROM (SELECT review_id, coalesce(review_text, '') AS review_text, sentiment FROM reviews)")
def csv_split(spark, sf_dir):
    """CSV with quoted quotes and line breaks, read by ranges."""
    path = shared_folder(spark, "csv")
    csv.write_csv(reviews(spark, sf_dir).withColumn("review_text", F.expr(BROKEN.replace("chr(10)", "char(10)").replace("review_text,", "coalesce(review_text, ''),", 1))), path)
    return split_csv.read_strict_split(spark, path).select(F.col("review_id").cast("long"), "review_text", F.col("sentiment").cast("double"))


@register("csv_sample", f"WITH {REVIEWS_SQL} SELECT review_id, review_text, sentiment::DOUBLE AS sentiment FROM reviews WHERE {SHARE_SQL} < 1000 / (SELECT count(*) FROM reviews)::DOUBLE")
def csv_sample(spark, sf_dir):
    """The feature itself: about 1000 rows, written as CSV."""
    path = shared_folder(spark, "csv")
    files.write_sample(reviews(spark, sf_dir), path, "review_id", 1000)
    return csv.read_strict(spark, path, "review_id bigint, review_text string, sentiment double")


@register("inventory_totals", "SELECT count(*) AS n_rows, 3 AS n_columns, '.csv' AS extension FROM orders")
def inventory_totals(spark, sf_dir):
    """Rows and columns that the inventory of a folder of CSV files tells of."""
    return file_inventory(spark, sf_dir).groupBy("extension").agg(F.sum("n_rows").alias("n_rows"), F.max("n_columns").alias("n_columns"))


@register("csv_roundtrip", f"WITH {REVIEWS_SQL} SELECT review_id, review_text, sentiment::DOUBLE AS sentiment FROM reviews")
def csv_roundtrip(spark, sf_dir):
    path = shared_folder(spark, "csv")
    csv.write_csv(reviews(spark, sf_dir), path)
    return csv.read_strict(spark, path).select(F.col("review_id").cast("long"), "review_text", F.col("sentiment").cast("double"))


@register("file_inventory")
def file_inventory(spark, sf_dir):
    path = shared_folder(spark, "csv")
    csv.write_csv(reviews(spark, sf_dir), path)
    return files.inventory(spark, path)


@register("model_registry", "SELECT 'large' AS name, 'tables' AS kind, printf('{\"rows\": %d}', count(*)) AS metrics, '{\"alpha\": 1.5, \"tables\": [\"classes\", \"terms\"]}' AS info FROM documents JOIN labels USING (doc_id)")
def model_registry(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    model = naive_bayes.fit(features.hashed(rows, "id", "text", by_term=True, keep=["label"]), rows.select("id", "label"), 1.5, 1 << 18)
    models = registry.Registry(spark, shared_folder(spark, "registry"))
    for name in ("large", "spare"):
        models.save_tables(name, {"classes": model.classes, "terms": model.terms}, {"rows": rows.count()}, {"alpha": 1.5})
    models.delete("spare")
    return models.models().select("name", "kind", "metrics", "info")


# -- Spark ML -----------------------------------------------------------------
def _trained(spark, sf_dir, name: str, **options) -> ml.Trained:
    return ml.train(corpus(spark, sf_dir), "text", "label", "id", name, **options)


@register("train_logreg")
def train_logreg(spark, sf_dir):
    return ml.evaluate(_trained(spark, sf_dir, ml.LOGISTIC))


@register("train_svm")
def train_svm(spark, sf_dir):
    return ml.evaluate(_trained(spark, sf_dir, ml.SVM))


@register("train_forest")
def train_forest(spark, sf_dir):
    return ml.evaluate(_trained(spark, sf_dir, ml.FOREST))


@register("cross_validate")
def cross_validate(spark, sf_dir):
    return ml.evaluate(_trained(spark, sf_dir, ml.BAYES, tune=True))


@register("batch_predict")
def batch_predict(spark, sf_dir):
    trained = _trained(spark, sf_dir, ml.LOGISTIC)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ml.batch_predict(trained, docs, "text").select("doc_id", "predicted_sentiment", r6("confidence").alias("confidence"))


@register("feature_importance")
def feature_importance(spark, sf_dir):
    return ml.feature_importance(_trained(spark, sf_dir, ml.LOGISTIC)).withColumn("weight", r6("weight"))


@register("forest_importance")
def forest_importance(spark, sf_dir):
    return ml.feature_importance(_trained(spark, sf_dir, ml.FOREST)).withColumn("weight", r6("weight"))


@register("compare_models")
def compare_models(spark, sf_dir):
    """All four models trained on one frame."""
    wide, _ = ml.compare_models(corpus(spark, sf_dir), "text", "label", "id")
    return metrics.comparison_long(wide).withColumn("Score", r6("Score"))


# -- streams ------------------------------------------------------------------
#: Rows of a stream's file, about: a file is a task's work in each of four micro-batches.
STREAM_ROWS = 250_000


def _review_stream(spark, sf_dir) -> DataFrame:
    """The derived reviews as a stream of Parquet files."""
    path = shared_folder(spark, "stream")
    rows = reviews(spark, sf_dir)
    n_files = max(8, rows.count() // STREAM_ROWS)
    rows.repartition(n_files, "review_id").write.parquet(path)
    return jobs.file_stream(spark, path, rows.schema, files_per_batch=-(-n_files // 4))


def _review_model(spark, sf_dir) -> naive_bayes.NaiveBayes:
    rows = label_normalize(spark, sf_dir).select(F.col("review_id").alias("id"), "label")
    labelled = reviews(spark, sf_dir).withColumn("label", normalise(F.col("sentiment")))
    model = naive_bayes.fit(features.hashed(labelled, "review_id", "review_text", by_term=True, keep=["label"]), rows, 1.5, 1 << 18)
    # Every micro-batch reads the model.
    return naive_bayes.NaiveBayes(stored(model.classes, "classes"), stored(model.terms, "terms"), model.closed, model.features)


REVIEW_NB_SQL = f"""{REVIEWS_SQL}, rows AS (SELECT review_id AS id, {LABEL_SQL} AS label, regexp_extract_all(lower(coalesce(review_text, '')), '{W}{{2,}}') AS ts FROM reviews),
counts AS (SELECT id, label, term, count(*) AS tf FROM (SELECT id, label, unnest(ts) AS term FROM rows) GROUP BY ALL),
weights AS (SELECT id, label, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id))::DOUBLE AS w FROM counts),
sums AS (SELECT label, term, sum(w) AS s FROM weights GROUP BY ALL)"""


@register(
    "stream_score",
    f"""WITH {REVIEW_NB_SQL}, classes AS (SELECT label, ln(count(*) / (SELECT count(*) FROM rows)::DOUBLE) AS prior FROM rows GROUP BY label),
rooms AS (SELECT label, ln(sum(s) + 1.5 * 262144) AS room FROM sums GROUP BY label),
dense AS (SELECT c.label, t.term, ln(coalesce(s, 0) + 1.5) - room AS lp FROM classes c JOIN rooms USING (label) CROSS JOIN (SELECT DISTINCT term FROM sums) t LEFT JOIN sums ON sums.label = c.label AND sums.term = t.term),
gained AS (SELECT id, d.label, sum(w * lp) AS g FROM weights JOIN dense d USING (term) GROUP BY ALL),
scored AS (SELECT rows.id, c.label, prior + coalesce(g, 0) AS score FROM rows CROSS JOIN classes c LEFT JOIN gained ON gained.id = rows.id AND gained.label = c.label),
top AS (SELECT id, max(score) AS m FROM scored GROUP BY id)
SELECT id, arg_min(label, (-round(score, 9), label)) AS prediction, round(1 / sum(exp(score - m)), 6) AS confidence FROM scored JOIN top USING (id) GROUP BY id""",
)
def stream_score(spark, sf_dir):
    out = shared_folder(spark, "scored")
    jobs.score_stream(_review_stream(spark, sf_dir), _review_model(spark, sf_dir), "review_id", "review_text", f"{out}/rows", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").select("id", "prediction", r6("confidence").alias("confidence"))


@register("stream_nb_counts", f"WITH {REVIEW_NB_SQL} SELECT label, term, round(ln(s + 1.5) - ln(sum(s) OVER (PARTITION BY label) + 1.5 * 262144), 6) AS lp FROM sums")
def stream_nb_counts(spark, sf_dir):
    out = shared_folder(spark, "deltas")
    jobs.count_stream(_review_stream(spark, sf_dir), "review_id", "review_text", "sentiment", f"{out}/rows", f"{out}/checkpoint")
    return jobs.model_of_deltas(spark, f"{out}/rows").terms.select("label", "term", r6("lp").alias("lp"))


LINES_SQL = r"lines AS (SELECT conv_id, turn, unnest(range(len(l)))::INT AS line, unnest(l) AS text FROM (SELECT conv_id, turn, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS l FROM conversations WHERE text IS NOT NULL))"
SCORE_SQL = """rooms AS (SELECT label, ln(sum(s) + 1.5 * 262144) AS room FROM sums GROUP BY label),
dense AS (SELECT c.label, t.term, ln(coalesce(s, 0) + 1.5) - room AS lp FROM classes c JOIN rooms USING (label) CROSS JOIN (SELECT DISTINCT term FROM sums) t LEFT JOIN sums ON sums.label = c.label AND sums.term = t.term),
unseen AS (SELECT c.label, ln(1.5) - room AS lp FROM classes c JOIN rooms USING (label)),
gained AS (SELECT id, u.label, sum(w * coalesce(d.lp, u.lp)) AS g FROM asked CROSS JOIN unseen u LEFT JOIN dense d ON d.term = asked.term AND d.label = u.label GROUP BY ALL),
scored AS (SELECT ids.id, c.label, prior + coalesce(g, 0) AS score FROM ids CROSS JOIN classes c LEFT JOIN gained ON gained.id = ids.id AND gained.label = c.label),
top AS (SELECT id, max(score) AS m FROM scored GROUP BY id)"""


@register(
    "score_lines",
    f"""WITH {REVIEW_NB_SQL}, classes AS (SELECT label, ln(count(*) / (SELECT count(*) FROM rows)::DOUBLE) AS prior FROM rows GROUP BY label), {LINES_SQL},
ids AS (SELECT concat_ws('/', conv_id, turn, line) AS id, text, conv_id, turn, line FROM lines),
found AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{W}{{2,}}')) AS term FROM ids) GROUP BY ALL),
asked AS (SELECT id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id))::DOUBLE AS w FROM found), {SCORE_SQL},
p AS (SELECT id, label, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY id) AS p, score FROM scored JOIN top USING (id))
SELECT any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(line) AS line, arg_min(label, (-round(score, 9), label)) AS prediction, round(max(p) FILTER (WHERE label = 'negative'), 6) AS "Confidence (negative)", round(max(p) FILTER (WHERE label = 'neutral'), 6) AS "Confidence (neutral)", round(max(p) FILTER (WHERE label = 'positive'), 6) AS "Confidence (positive)" FROM p JOIN ids USING (id) GROUP BY id""",
)
def score_lines(spark, sf_dir):
    """Every line of the conversations, scored by the model of the reviews."""
    lines = pasted_lines(spark, sf_dir).withColumn("id", F.concat_ws("/", "conv_id", "turn", "line"))
    model = _review_model(spark, sf_dir)
    found = naive_bayes.predict(model, lines, features.hashed(lines, "id", "text", by_term=True))
    wide = naive_bayes.confidence_columns(found, ["negative", "neutral", "positive"], "Confidence (")
    shown = [r6(F.col(f"`Confidence ({c}`")).alias(f"Confidence ({c})") for c in ("negative", "neutral", "positive")]
    return lines.select("id", "conv_id", "turn", "line").join(wide, "id").select("conv_id", "turn", "line", "prediction", *shown)


@register(
    "stream_evaluation",
    f"""WITH {REVIEWS_SQL}, whole AS (SELECT review_id AS id, {LABEL_SQL} AS label, {_key(42, 'review_id')} AS key, {SHARE_SQL} < 0.2 AS is_test, regexp_extract_all(lower(coalesce(review_text, '')), '{W}{{2,}}') AS ts FROM reviews),
rows AS (SELECT * FROM whole WHERE NOT is_test), ids AS (SELECT * FROM whole WHERE is_test ORDER BY key, id LIMIT 1000),
counts AS (SELECT id, is_test, label, term, count(*) AS tf FROM (SELECT id, is_test, label, unnest(ts) AS term FROM whole) GROUP BY ALL),
weights AS (SELECT id, is_test, label, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id))::DOUBLE AS w FROM counts),
sums AS (SELECT label, term, sum(w) AS s FROM weights WHERE NOT is_test GROUP BY ALL), asked AS (SELECT id, term, w FROM weights WHERE id IN (SELECT id FROM ids)),
classes AS (SELECT label, ln(count(*) / (SELECT count(*) FROM rows)::DOUBLE) AS prior FROM rows GROUP BY label), {SCORE_SQL},
predicted AS (SELECT id, arg_min(label, (-round(score, 9), label)) AS prediction FROM scored GROUP BY id),
pairs AS (SELECT ids.label, prediction FROM ids JOIN predicted USING (id)), names AS (SELECT label FROM pairs UNION SELECT prediction FROM pairs),
each AS (SELECT n.label, count(*) FILTER (WHERE p.label = n.label AND prediction = n.label) AS tp, count(*) FILTER (WHERE p.label = n.label) AS t, count(*) FILTER (WHERE prediction = n.label) AS p FROM names n, pairs p GROUP BY n.label),
ratios AS (SELECT *, coalesce(tp / nullif(p, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(t, 0)::DOUBLE, 0) AS recall FROM each)
SELECT round(sum(tp) / sum(t)::DOUBLE, 6) AS accuracy, round(sum(precision * t) / sum(t), 6) AS precision, round(sum(recall * t) / sum(t), 6) AS recall, round(sum(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) * t) / sum(t), 6) AS f1, sum(t)::BIGINT AS n, sum(tp) / sum(t)::DOUBLE >= 0.92 AS meets_target FROM ratios""",
)
def stream_evaluation(spark, sf_dir):
    """A model trained on a stream's training rows, judged on the 1000 held-out rows that come first in the hash's order."""
    out = shared_folder(spark, "evaluated")
    jobs.train_and_hold_out(_review_stream(spark, sf_dir), "review_id", "review_text", "sentiment", out, f"{out}/checkpoint", cap=1000)
    found = metrics.weighted_metrics(jobs.evaluate_held_out(spark, out))
    return found.withColumns({c: r6(c) for c in ("accuracy", "precision", "recall", "f1")})


@register(
    "stream_progress",
    f"WITH {REVIEWS_SQL} SELECT count(*) AS n_rows, count(*) FILTER (WHERE review_text IS NULL) AS missing, count(*) FILTER (WHERE {LABEL_SQL} = 'positive') AS positive, count(*) FILTER (WHERE {LABEL_SQL} = 'negative') AS negative, count(*) FILTER (WHERE {LABEL_SQL} = 'neutral') AS neutral FROM reviews",
)
def stream_progress(spark, sf_dir):
    """What the reports of a stream's micro-batches add up to."""
    out = shared_folder(spark, "watched")
    listener = progress.watch(spark)
    try:
        stream = progress.observed(_review_stream(spark, sf_dir), "review_text", "sentiment")
        query = stream.writeStream.format("noop").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        listener.wait(query.id)
    finally:
        spark.streams.removeListener(listener)
    return listener.table(spark).agg(*[F.sum(c).alias(c) for c in ("n_rows", "missing", *progress.CLASSES)])


@register("stream_class_counts", f"WITH {REVIEWS_SQL} SELECT {LABEL_SQL} AS label, count(*) AS n FROM reviews GROUP BY 1")
def stream_class_counts(spark, sf_dir):
    out = shared_folder(spark, "counts")
    return jobs.running_classes(_review_stream(spark, sf_dir), "sentiment", "class_counts_" + out[-8:], f"{out}/checkpoint")


ORACLES |= _sql_parts(vectoriser_words())
