"""Counts of the terms of each row, made where the row is: texts are never spread over a shuffle to be counted."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens that are counted at once, about.
TOKENS = 1 << 18


#: Bytes that a token takes in a string of tokens, about.
TOKEN_BYTES = 8
#: Counts that a task holds to add up before it sends them, about.
HELD = 1 << 20
#: Words whose pairs are told by one number together with their row, at most.
PAIR_WORDS = 1 << 22
#: Groups whose sums a task holds, at most.
GROUPS = 256


def _is_text(column: pa.Array) -> bool:
    return pa.types.is_string(column.type) or pa.types.is_large_string(column.type)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about TOKENS tokens."""
    if _is_text(batch.column(column)):
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)) // TOKEN_BYTES)])
    else:
        ends = np.asarray(batch.column(column).offsets)
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _coded(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different tokens of lists, or of strings that hold tokens between blanks; of each token its place among them and its row."""
    text = _is_text(lists)
    if text:
        lists = pc.split_pattern(lists, " ")
    flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
    if text:
        # An empty string is split into one empty token.
        filled = pc.not_equal(flat, "")
        flat, row = flat.filter(filled), row[filled.to_numpy(zero_copy_only=False)]
    tokens = flat.dictionary_encode()
    names, codes = tokens.dictionary, tokens.indices.to_numpy().astype(np.int64)
    return names, codes, row


def _places(names: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each name among others, -1 if it isn't there."""
    return pc.fill_null(pc.index_in(names.cast(pa.string()), value_set=among), -1).to_numpy().astype(np.int64)


def _added_up(counts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (key, df, ctf) with those of one key added up, as far as HELD of them hold it."""
    held, n = [], 0

    def told() -> Iterator[pa.RecordBatch]:
        key = held[0].schema.names[0]
        sums = pa.Table.from_batches(held).group_by(key, use_threads=False).aggregate([("df", "sum"), ("ctf", "sum")])
        yield from sums.select([key, "df_sum", "ctf_sum"]).rename_columns([key, "df", "ctf"]).to_batches(max_chunksize=1 << 16)

    for batch in counts:
        held.append(batch)
        n += len(batch)
        if n >= HELD:
            yield from told()
            held, n = [], 0
    if held:
        yield from told()


def _counts(lists: pa.Array, low: int, high: int, words: pa.Array | None = None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of n-grams: terms, and of each row and term the row, the term's place and how often it is there.

    An n-gram is told by numbers (its first tokens' and its last one's), so
    that its text is put together once and not for every place.  With `words`,
    n-grams of two and more tokens count only if all their tokens are among them.
    """
    names, codes, row = _coded(lists)
    size = len(names)
    known = np.ones(len(codes), dtype=bool) if words is None else pc.is_in(names.cast(pa.string()), value_set=words).to_numpy(zero_copy_only=False)[codes]
    terms, at, open_ = names, codes, known
    for n in range(1, high + 1):
        if n > 1:
            whole = row[: len(row) - (n - 1)] == row[n - 1 :] if len(row) >= n else np.zeros(0, dtype=bool)
            last = codes[n - 1 :][: len(whole)]
            open_ = open_[: len(whole)] & known[n - 1 :][: len(whole)]
            whole &= open_
            found, places = np.unique(at[: len(whole)][whole] * size + last[whole], return_inverse=True)
            terms = pc.binary_join_element_wise(terms.take(pa.array(found // max(1, size))), names.take(pa.array(found % max(1, size))), " ")
            # Places without an n-gram of their own keep a number that nothing reads.
            rows, at = row[: len(whole)][whole], np.zeros(len(whole), dtype=np.int64)
            at[whole] = places
        else:
            rows, places = row, at
        if n >= low:
            keys, tf = np.unique(rows * max(1, len(terms)) + places, return_counts=True)
            yield terms, keys // max(1, len(terms)), keys % max(1, len(terms)), tf


def spread(df: DataFrame, ngram_range: tuple[int, int] = (1, 1), weigh: Callable[[pa.Array, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None, words: Sequence[str] | None = None) -> DataFrame:
    """The other columns, term, and tf (long) or weight (double) for each row and n-gram of `tokens`, the last column.

    `weigh` takes terms, places and counts of some rows and returns which of
    them stay and what they weigh; weights are divided by their row's Euclidean
    length.  With `words`, longer n-grams count only if made of them.
    """
    low, high = ngram_range
    others = df.columns[:-1]
    inner = None if words is None else pa.array(words, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, len(others)):
                found = list(_counts(part.column(len(others)), low, high, inner))
                if weigh is not None:
                    kept = [weigh(terms, places, tf) for terms, _, places, tf in found]
                    squares = sum(np.bincount(rows[stay], w * w, minlength=len(part)) for (_, rows, _, _), (stay, w) in zip(found, kept))
                    found = [(terms, rows[stay], places[stay], w / np.sqrt(squares[rows[stay]])) for (terms, rows, places, _), (stay, w) in zip(found, kept)]
                for terms, rows, places, value in found:
                    where = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([*(part.column(k).take(where) for k in range(len(others))), terms.take(pa.array(places)), pa.array(value)], names=[*others, "term", "value"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]]
    kind, name = ("bigint", "tf") if weigh is None else ("double", "weight")
    return df.mapInArrow(run, ", ".join([*fields, "term string", f"value {kind}"])).withColumnRenamed("value", name)


def term_totals(lists: DataFrame, ngram_range: tuple[int, int] = (1, 1), words: Sequence[str] | None = None) -> DataFrame:
    """term, df, ctf of a column of term lists or of their n-grams; each task sends a term once for many rows.

    With `words`, longer n-grams count only if made of them.
    """
    low, high = ngram_range
    if low == high == 2 and words is not None and 0 < len(words) <= PAIR_WORDS:
        return _pair_totals(lists, words)
    inner = None if words is None else pa.array(words, pa.string())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 0):
                for terms, _, places, tf in _counts(part.column(0), low, high, inner):
                    df, ctf = np.bincount(places, minlength=len(terms)), np.bincount(places, tf, minlength=len(terms)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([terms, pa.array(df.astype(np.int64)), pa.array(ctf)], names=["term", "df", "ctf"])

    return lists.mapInArrow(lambda batches: _added_up(counted(batches)), "term string, df bigint, ctf bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))


def _pair_totals(lists: DataFrame, words: Sequence[str]) -> DataFrame:
    """term, df, ctf of the pairs of `words`: they are shuffled and added up as numbers, and get their text at the end."""
    inner, size = pa.array(words, pa.string()), len(words)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 0):
                names, codes, row = _coded(part.column(0))
                at = _places(names, inner)[codes]
                whole = (row[:-1] == row[1:]) & (at[:-1] >= 0) & (at[1:] >= 0)
                # Rows are numbered anew without gaps, so that pair and row fit one number; rows of a pair stand together.
                rows = np.cumsum(np.diff(row[1:][whole], prepend=-1) != 0)
                each = (int(rows[-1]) if len(rows) else 0) + 1
                keys = np.sort((at[:-1][whole] * size + at[1:][whole]) * each + rows)
                pairs = keys // each
                starts = np.flatnonzero(np.diff(pairs, prepend=-1))
                fresh = np.diff(keys, prepend=-1) != 0
                df = np.add.reduceat(fresh, starts, dtype=np.int64) if len(starts) else starts
                yield pa.RecordBatch.from_arrays([pa.array(pairs[starts]), pa.array(df.astype(np.int64)), pa.array(np.diff(starts, append=len(pairs)).astype(np.int64))], names=["pair", "df", "ctf"])

    found = lists.mapInArrow(lambda batches: _added_up(counted(batches)), "pair bigint, df bigint, ctf bigint").groupBy("pair").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))
    # The words are bounded by the caller.
    table = F.broadcast(lists.sparkSession.createDataFrame(pa.table({"at": pa.array(range(size), pa.int64()), "word": inner})))
    for name, place in (("first", F.expr(f"pair div {size}")), ("second", F.col("pair") % size)):
        found = found.withColumn("at", place).join(table.withColumnRenamed("word", name), "at").drop("at")
    return found.select(F.concat_ws(" ", "first", "second").alias("term"), "df", "ctf")


class _Terms:
    """Finds the terms of a vocabulary in strings of tokens, by a tree of their words."""

    def __init__(self, names: Sequence[str], idf: Sequence[float], ngram_range: tuple[int, int]) -> None:
        self.idf, self.size = np.asarray(idf, dtype=np.float64), len(names)
        split = [(k, words) for k, name in enumerate(names) if ngram_range[0] <= len(words := name.split(" ")) <= ngram_range[1]]
        self.words = pa.array(sorted({w for _, words in split for w in words}), pa.string())
        place = {w: k for k, w in enumerate(self.words.to_pylist())}
        self.width, self.depth = max(1, len(place)), max((len(words) for _, words in split), default=0)
        nodes, ends = {}, [-1]
        for k, words in split:
            node = 0
            for w in words:
                key = node * self.width + place[w]
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                node = nodes[key]
            ends[node] = k
        order = sorted(nodes)
        self.keys, self.nodes, self.ends = np.array(order, dtype=np.int64), np.array([nodes[k] for k in order], dtype=np.int64), np.array(ends)

    def weights(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term's place and weight: (1 + ln tf) * idf, rows of unit length."""
        names, codes, row = _coded(texts)
        at = _places(names, self.words)[codes]
        spots, node, found = np.arange(len(at)), np.zeros(len(at), dtype=np.int64), []
        for n in range(self.depth):
            # Runs that go on with a known word of the same row, and of those the ones that begin a term.
            open_ = spots + n < len(at)
            spots, node = spots[open_], node[open_]
            open_ = (row[spots + n] == row[spots]) & (at[spots + n] >= 0)
            spots, node = spots[open_], node[open_]
            key = node * self.width + at[spots + n]
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            open_ = self.keys[where] == key
            spots, node = spots[open_], self.nodes[where[open_]]
            end = self.ends[node]
            found.append(row[spots[end >= 0]] * self.size + end[end >= 0])
        keys, tf = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, dtype=np.int64), np.zeros(0))
        rows, terms = keys // max(1, self.size), keys % max(1, self.size)
        w = (1 + np.log(tf)) * self.idf[terms]
        return rows, terms, w / np.sqrt(np.bincount(rows, w * w, minlength=len(texts)))[rows]


def group_sums(df: DataFrame, names: Sequence[str], idf: Sequence[float], ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """group, term, w from a group and a string of tokens: the weights of a vocabulary's terms, summed over the group's rows.

    Each task sends a group's term once, or once for every GROUPS groups that it meets.
    """
    kind = df.schema.fields[0].dataType.simpleString()
    group = df.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, texts, held, type_ = _Terms(names, idf, ngram_range), pa.array(names, pa.string()), {}, None

        def told() -> Iterator[pa.RecordBatch]:
            for value, sums in held.items():
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([value] * len(at), type_), texts.take(pa.array(at)), pa.array(sums[at])], names=[group, "term", "w"])
            held.clear()

        for batch in batches:
            type_ = batch.column(0).type
            for part in _parts(batch, 1):
                rows, at, w = terms.weights(part.column(1))
                groups = part.column(0).dictionary_encode(null_encoding="encode")
                code = groups.indices.to_numpy()[rows]
                for k, value in enumerate(groups.dictionary.to_pylist()):
                    mine = code == k
                    if value not in held and len(held) >= GROUPS:
                        yield from told()
                    held[value] = held.get(value, 0.0) + np.bincount(at[mine], w[mine], minlength=len(texts))
        yield from told()

    found = df.mapInArrow(run, f"`{group}` {kind}, term string, w double")
    return found.groupBy(group, "term").agg(F.sum("w").alias("w"))


def row_sums(df: DataFrame, names: Sequence[str], idf: Sequence[float], factors: Sequence[Sequence[float]], ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """The other columns, and `sums` in the place of a string of tokens, the last column: for each list of factors, one for each term, the row's weights times them."""
    others = df.columns[:-1]
    lists = np.asarray(factors, dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(names, idf, ngram_range)
        for batch in batches:
            for part in _parts(batch, len(others)):
                rows, at, w = terms.weights(part.column(len(others)))
                # Sums of nothing would be whole numbers.
                sums = np.stack([np.bincount(rows, w * each[at], minlength=len(part)) for each in lists], axis=1).astype(np.float64)
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(lists))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(others))), pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))], names=[*others, "sums"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]]
    return df.mapInArrow(run, ", ".join([*fields, "sums array<double>"]))


def by_length(terms: pa.Array, places: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every term stays and weighs its count."""
    return np.ones(len(tf), dtype=bool), tf.astype(np.float64)


def by_vocabulary(names: Sequence[str], idf: Sequence[float]) -> Callable[[pa.Array, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Terms of the vocabulary stay and weigh (1 + ln tf) * idf."""
    names, idf = pa.array(names, pa.string()), np.asarray(idf, dtype=np.float64)

    def weigh(terms: pa.Array, places: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = pc.fill_null(pc.index_in(terms.cast(pa.string()), value_set=names), -1).to_numpy()[places]
        stay = known >= 0
        return stay, (1 + np.log(tf[stay])) * idf[known[stay]]

    return weigh


def ids_repeat(df: DataFrame, id_col: str) -> bool:
    """Whether several rows have one id."""
    return not df.groupBy(id_col).agg(F.count("*").alias("__n")).where("__n > 1").isEmpty()
