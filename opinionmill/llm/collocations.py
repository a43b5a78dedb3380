"""Phrase collocation mining with mergeable Misra-Gries summaries.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and
into words at blanks; phrases of two or three words within a piece that occur
`least` times or more in their language are candidates.

1. Every task counts hashes of its word runs and deals them out by ranges of the
   hash, sorted and packed.  A range's task merges these counters into a
   Misra-Gries summary whose capacity exceeds the range's mass divided by
   `least`, so every run that occurs `least` times survives, and of the others
   those that could.  The number of ranges follows the size of the texts, so a
   summary has a bounded number of counters whatever the table's size.
2. The survivors set bits of a Bloom filter of at most FILTER_BITS bits, put
   together range by range.  A second pass over the texts counts the runs that
   pass it exactly, by their words; false positives fall at the threshold.
   Beyond some FILTER_BITS / 12 survivors the filter lets more runs through,
   which costs shuffle, never rows.

Scores, cuts and containment are joins of the exact counts.

Defined cases: null text is empty; a null language is `und`; texts are read
whole; null ids and repeated rows count like any other row; columns other than
text and language are not read; equal scores are told apart by count and
phrase; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, if_small
from .textbatch import LOWER, long_span_hashes, mix, slices

#: Bits of a run's hash, and of its count within a summary (larger counts are cut to the largest).
HASH_BITS, COUNT_BITS = 44, 20
#: Characters of text to a range of hashes; counters that a mapping task gathers before it packs them.
RANGE_CHARS, FLUSH = 1 << 24, 1 << 20
#: Bits of the filter at most (64 MB), bits to a survivor, bits that each one sets.
FILTER_BITS, BITS_EACH, PROBES = 1 << 29, 16, 4
#: Bytes of text worked on at once, and rows of exact counts that a task gathers.
TEXT_BYTES, EXACT_ROWS = 1 << 20, 1 << 19
#: Parts of a language whose first phrases are picked before the whole language's.
SALTS = 64

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAP = _SEPARATOR.copy()
_GAP[[0x20, 0x09]] = True


@dataclass
class Runs:
    """Words of some texts: bytes, first and end byte of each, its row, and a number that words of one piece share."""

    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    rows: np.ndarray
    pieces: np.ndarray

    def places(self, width: int) -> np.ndarray:
        """Words with which a run of `width` words begins."""
        n = len(self.starts) - width + 1
        return np.flatnonzero(self.pieces[:n] == self.pieces[width - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)


def parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of whole rows; a longer text is cut where pieces end, which no run crosses."""
    for row, stop, data, offsets in slices(column, TEXT_BYTES):
        if len(data) <= TEXT_BYTES:
            yield row, stop, data, offsets
            continue
        ends = np.append(np.flatnonzero(_SEPARATOR[data]) + 1, len(data))
        at = 0
        while at < len(data):
            end = int(ends[max(np.searchsorted(ends, at + TEXT_BYTES, side="right") - 1, np.searchsorted(ends, at, side="right"))])
            yield row, stop, data[at:end], np.array([0, end - at])
            at = end


def runs(data: np.ndarray, offsets: np.ndarray) -> Runs:
    gap = _GAP[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = gap[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first = edge[:-1].copy()
    first[inner] = True
    last = np.append(gap[1:], True) if len(data) else np.zeros(0, dtype=bool)
    last[inner - 1] = True
    starts, stops = np.flatnonzero(~gap & first), np.flatnonzero(~gap & last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return Runs(LOWER[data], starts, stops, rows, np.cumsum(_SEPARATOR[data])[starts] + rows)


def hashes(found: Runs, seeds: np.ndarray, width: int, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HASH_BITS bits for each run of `width` words that begins at `at`, the language's seed mixed in."""
    value = seeds[found.rows[at]] + np.uint64(width)
    for k in range(width):
        value = mix(value * np.uint64(0xD6E8FEB86659FD93) + words[at + k])
    return value >> np.uint64(64 - HASH_BITS)


def pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes as differences and their counts, byte plane by byte plane, compressed."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = [gaps.view(np.uint8).reshape(-1, 8)[:, :6].T, counts.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T]
    return pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int) -> np.ndarray:
    """The counters of a packed blob, each as hash << COUNT_BITS | count."""
    planes = np.frombuffer(pa.decompress(blob, 9 * n, codec="zstd"), dtype=np.uint8).reshape(9, n)
    wide, narrow = np.zeros((n, 8), dtype=np.uint8), np.zeros((n, 4), dtype=np.uint8)
    wide[:, :6], narrow[:, :3] = planes[:6].T, planes[6:].T
    values = np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)
    return (values << np.uint64(COUNT_BITS)) | narrow.view("<u4").ravel().astype(np.uint64)


_MOST = (1 << COUNT_BITS) - 1


class Summary:
    """A Misra-Gries summary with `capacity` counters; `taken` is the most that a counter may have lost."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.taken, self.waiting, self.n = capacity, 0, [], 0
        self.values, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def add(self, packed: np.ndarray) -> None:
        self.waiting.append(packed)
        self.n += len(packed)
        if self.n >= max(self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        """Counters of equal hashes are summed; if too many are left, all lose the count of the first that has no room."""
        if not self.waiting:
            return
        own = (self.values << np.uint64(COUNT_BITS)) | np.minimum(self.counts, _MOST).astype(np.uint64)
        rows = np.sort(np.concatenate([own, *self.waiting]))
        self.waiting, self.n = [], 0
        values = rows >> np.uint64(COUNT_BITS)
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=np.int64)
        self.values = values[first]
        self.counts = np.add.reduceat((rows & np.uint64(_MOST)).astype(np.int64), first) if len(first) else np.zeros(0, dtype=np.int64)
        if len(self.counts) > self.capacity:
            place = len(self.counts) - 1 - self.capacity
            loss = int(np.partition(self.counts, place)[place])
            self.taken += loss
            kept = self.counts > loss
            self.values, self.counts = self.values[kept], self.counts[kept] - loss

    def survivors(self, least: int) -> np.ndarray:
        """Hashes that may have occurred `least` times."""
        self.merge()
        return self.values[self.counts + self.taken >= least]


def _ranges(docs: DataFrame) -> int:
    """A power of two, so that a range stands for RANGE_CHARS characters of text or fewer."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << min(24, max(0, int(size - 1) // RANGE_CHARS).bit_length())


def _counted(docs: DataFrame, longest: int, ranges: int) -> DataFrame:
    """range, n, mass, blob: packed counters of each task."""
    shift = np.uint64(HASH_BITS - (ranges.bit_length() - 1))

    def packed(gathered: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.sort(np.concatenate(gathered))
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        values, counts = rows[first], np.diff(np.append(first, len(rows)))
        home = values >> shift
        edges = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
        spans = [slice(a, b) for a, b in zip(edges, np.append(edges[1:], len(values)))]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(home[edges].astype(np.int64)),
                pa.array([s.stop - s.start for s in spans], pa.int64()),
                pa.array([int(counts[s].sum()) for s in spans], pa.int64()),
                pa.array([pack(values[s], np.minimum(counts[s], _MOST)) for s in spans], pa.binary()),
            ],
            names=["range", "n", "mass", "blob"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in batches:
            seeds = np.asarray(batch.column(1)).astype(np.int64).view(np.uint64)
            for row, stop, data, offsets in parts(batch.column(0)):
                found = runs(data, offsets)
                words = long_span_hashes(found.data, found.starts, found.stops)
                for width in range(1, longest + 1):
                    gathered.append(hashes(found, seeds[row:stop], width, words, found.places(width)))
                    size += len(gathered[-1])
                if size >= FLUSH:
                    yield packed(gathered)
                    gathered, size = [], 0
                    pa.default_memory_pool().release_unused()
        if size:
            yield packed(gathered)

    return docs.select("text", F.xxhash64("lang").alias("seed")).mapInArrow(run, "range long, n long, mass long, blob binary")


def _survivors(counted: DataFrame, least: int) -> DataFrame:
    """range, n, blob: hashes that may have occurred `least` times, one summary a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, summary = None, None

        def out() -> Iterator[pa.RecordBatch]:
            if summary is not None:
                values = summary.survivors(least)
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([len(values)]), pa.array([pack(values, np.ones(len(values)))], pa.binary())], names=["range", "n", "blob"])

        for batch in batches:
            for k in range(len(batch)):
                at, n, whole = (batch.column(c)[k].as_py() for c in (0, 1, 3))
                if at != key:
                    yield from out()
                    key, summary = at, Summary(whole // least + 1)
                summary.add(unpack(batch.column(2)[k].as_py(), n))
        yield from out()

    # The window brings a range's counters together, one after the other, with their whole mass.
    whole = counted.select("range", "n", "blob", F.sum("mass").over(Window.partitionBy("range")).alias("whole"))
    return cut(whole.mapInArrow(run, "range long, n long, blob binary"))


@dataclass
class Filter:
    """A Bloom filter in equal slices, one for each range of hashes."""

    bits: np.ndarray
    shift: int
    slice_bits: int

    @staticmethod
    def probes(values: np.ndarray, slice_bits: int) -> list[np.ndarray]:
        spread, mask = mix(values), np.uint64(slice_bits - 1)
        return [(mix(spread + np.uint64(k)) & mask) for k in range(PROBES)]

    def has(self, values: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be in."""
        left = np.arange(len(values))
        base = (values >> np.uint64(self.shift)) * np.uint64(self.slice_bits)
        spread, mask = mix(values), np.uint64(self.slice_bits - 1)
        for k in range(PROBES):
            bit = base[left] + (mix(spread[left] + np.uint64(k)) & mask)
            left = left[(self.bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0]
        return left


def _filter(survivors: DataFrame, ranges: int) -> Filter:
    """Slices are made where the survivors are; together they have FILTER_BITS bits at most."""
    n = survivors.agg(F.sum("n")).first()[0] or 0
    whole = min(FILTER_BITS, 1 << max(16, (n * BITS_EACH).bit_length()))
    slice_bits = max(64, whole // ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                bits = np.zeros(slice_bits // 8, dtype=np.uint8)
                for bit in Filter.probes(unpack(blob, n) >> np.uint64(COUNT_BITS), slice_bits):
                    np.bitwise_or.at(bits, bit >> np.uint64(3), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([pa.compress(bits.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["range", "bits"])

    out = np.zeros((ranges, slice_bits // 8), dtype=np.uint8)
    for row in survivors.mapInArrow(run, "range long, bits binary").toLocalIterator():
        out[row["range"]] = np.frombuffer(pa.decompress(bytes(row["bits"]), slice_bits // 8, codec="zstd"), dtype=np.uint8)
    return Filter(out.ravel(), HASH_BITS - (ranges.bit_length() - 1), slice_bits)


def _phrases(found: Runs, width: int, at: np.ndarray) -> pa.Array:
    """The runs as text, their words joined by a space."""
    sizes = found.stops - found.starts

    def column(k: int) -> pa.Array:
        own = sizes[at + k]
        ends = np.zeros(len(own) + 1, dtype=np.int32)
        np.cumsum(own, out=ends[1:])
        where = np.arange(ends[-1]) + np.repeat(found.starts[at + k] - ends[:-1], own)
        return pa.Array.from_buffers(pa.string(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(found.data[where])])

    parts = [column(k) for k in range(width)]
    return parts[0] if width == 1 else pc.binary_join_element_wise(*parts, " ")


@dataclass
class _Counted:
    """Phrases of one task with their language, hash and count, summed up now and then."""

    tables: list[pa.Table]
    size: int = 0

    def add(self, langs: pa.Array, phrases: pa.Array, hashed: np.ndarray) -> None:
        rows = pa.table({"lang": langs, "phrase": phrases, "hash": pa.array(hashed.astype(np.int64))}).group_by(["lang", "phrase"]).aggregate([("hash", "min"), ([], "count_all")])
        self.put(rows["lang"], rows["phrase"], rows["hash_min"], rows["count_all"].cast(pa.int64()))

    def put(self, *columns: pa.Array) -> None:
        self.tables.append(pa.table(list(columns), names=["lang", "phrase", "hash", "n"]))
        self.size += len(self.tables[-1])

    def sum(self) -> pa.Table:
        whole = pa.concat_tables(self.tables).group_by(["lang", "phrase"]).aggregate([("hash", "min"), ("n", "sum")])
        whole = pa.table([whole["lang"], whole["phrase"], whole["hash_min"], whole["n_sum"]], names=["lang", "phrase", "hash", "n"]).combine_chunks()
        self.tables, self.size = [whole], len(whole)
        return whole


def _dealt(rows: pa.Table, shift: int) -> pa.RecordBatch:
    """range, lang, n, size, phrases, counts: the phrases of each range and language as one text, a line each, and their counts."""
    home = rows["hash"].to_numpy() >> shift
    langs = rows["lang"].combine_chunks().dictionary_encode()
    langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
    code = np.asarray(langs.indices)
    order = np.lexsort((code, home))
    edges = np.flatnonzero(np.append(True, (home[order][1:] != home[order][:-1]) | (code[order][1:] != code[order][:-1])))
    ends = np.append(edges, len(order)).astype(np.int32)
    phrases = rows["phrase"].combine_chunks().take(pa.array(order))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), phrases), "\n").to_pylist()
    counts, texts = rows["n"].to_numpy()[order], [t.encode() for t in texts]
    pressed = lambda data: pa.compress(data, codec="zstd", asbytes=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(home[order][edges]), langs.dictionary.take(pa.array(code[order][edges])), pa.array(np.diff(ends).astype(np.int64)), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([pressed(t) for t in texts], pa.binary()), pa.array([pressed(counts[i:j].astype("<i8").tobytes()) for i, j in zip(ends, ends[1:])], pa.binary()),
        ],
        names=["range", "lang", "n", "size", "phrases", "counts"],
    )


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """lang, phrase, n of a range's and language's phrases that occur `least` times, and of the empty phrase."""
    key, tables, size = None, [], 0

    def sums() -> pa.Table:
        whole = pa.concat_tables(tables).group_by("phrase").aggregate([("n", "sum")])
        return pa.table([whole["phrase"], whole["n_sum"]], names=["phrase", "n"])

    def out() -> Iterator[pa.RecordBatch]:
        if tables:
            rows = sums()
            rows = rows.filter(pc.or_(pc.greater_equal(rows["n"], least), pc.equal(rows["phrase"], ""))).combine_chunks()
            for part in rows.to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array([key[1]] * len(part), pa.string()), *part.columns], names=["lang", "phrase", "n"])

    for batch in batches:
        for row in range(len(batch)):
            at, lang, n, length, phrases, counts = (c[row].as_py() for c in batch.columns)
            if (at, lang) != key:
                yield from out()
                key, tables, size = (at, lang), [], 0
            text = pa.array([pa.decompress(phrases, length, codec="zstd", asbytes=True).decode()])
            found = np.frombuffer(pa.decompress(counts, 8 * n, codec="zstd", asbytes=True), dtype="<i8")
            tables.append(pa.table([pc.split_pattern(text, "\n").flatten(), pa.array(found)], names=["phrase", "n"]))
            size += n
            if size >= EXACT_ROWS:
                tables = [sums()]
                size = len(tables[0]) // 2
    yield from out()


def _exact(docs: DataFrame, longest: int, passing: Filter, least: int) -> DataFrame:
    """lang, phrase, n of the runs that pass and occur `least` times; the empty phrase has all word occurrences of a language.

    Tasks deal their counts out by the same ranges of the hash, packed; a
    range's task sums up a bounded number of phrases.
    """
    shared = docs.sparkSession.sparkContext.broadcast(passing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Counted([])
        for batch in batches:
            seeds = np.asarray(batch.column(1)).astype(np.int64).view(np.uint64)
            for row, stop, data, offsets in parts(batch.column(0)):
                found = runs(data, offsets)
                langs = batch.column(2).slice(row, stop - row)
                words = long_span_hashes(found.data, found.starts, found.stops)
                each = pa.table({"lang": langs, "n": pa.array(np.bincount(found.rows, minlength=stop - row))}).group_by("lang").aggregate([("n", "sum")])
                gathered.put(each["lang"], pa.array([""] * len(each)), pa.array(np.zeros(len(each), dtype=np.int64)), each["n_sum"])
                for width in range(1, longest + 1):
                    places = found.places(width)
                    hashed = hashes(found, seeds[row:stop], width, words, places)
                    at = shared.value.has(hashed)
                    gathered.add(langs.take(pa.array(found.rows[places[at]])), _phrases(found, width, places[at]), hashed[at])
                if gathered.size >= EXACT_ROWS and 2 * len(gathered.sum()) >= EXACT_ROWS:
                    yield _dealt(gathered.tables[0], passing.shift)
                    gathered = _Counted([])
                    pa.default_memory_pool().release_unused()
        if gathered.tables:
            yield _dealt(gathered.sum(), passing.shift)

    rows = docs.select("text", F.xxhash64("lang").alias("seed"), "lang").mapInArrow(run, "range long, lang string, n long, size long, phrases binary, counts binary")
    rows = rows.repartition("range").sortWithinPartitions("range", "lang")
    return rows.mapInArrow(lambda batches: _summed(batches, least), "lang string, phrase string, n long")


def frequent_runs(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10) -> DataFrame:
    """lang, phrase, n of all runs of 1 to `longest` words that occur `least` times; the empty phrase has a language's words."""
    docs = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    ranges = _ranges(docs)
    passing = _filter(_survivors(_counted(docs, longest, ranges), least), ranges)
    return cut(_exact(docs, longest, passing, least))


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, contained: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score; the first `top` rows of each language.

    A phrase inside a longer candidate with `contained` percent of its count or
    more is dropped.
    """
    found = frequent_runs(df, text_col, lang_col, longest, least)
    counts = found.where("phrase <> ''")
    words = F.split("phrase", " ")
    phrases = counts.select("lang", "phrase", F.size(words).alias("width"), F.col("n").alias("a")).where("width > 1")
    # What lies inside a longer candidate, with the most frequent of those.
    inner = F.expr("flatten(transform(sequence(2, width - 1), m -> transform(sequence(1, width - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    longer = phrases.where("width > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < contained * F.col("a"))).drop("outer")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("width") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(words, 1, F.col("k")), " ").alias("left"), F.array_join(F.slice(words, F.col("k") + 1, F.size(words)), " ").alias("right"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    # Decimals: the products may need more than 64 bits.
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(38,0)) * a * 1000000BD) div (cast(l as decimal(38,0)) * r)").cast("long"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # Two steps, so that a language is not one task's group of all its phrases.
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase", F.lit(5)), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(if_small(found.where("phrase = ''").select("lang", "n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
