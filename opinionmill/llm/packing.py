"""Sequence packing by minimum bin slack.

Every document's token ids are cut at multiples of the window; whole windows
stand alone and the rest are pieces shorter than a window.  What decides the
packing is only how many pieces there are of each length, a histogram of at
most `window` rows however large the corpus.  For each next window the longest
remaining length is set and a bitset subset-sum over the remaining multiset
picks the lengths that fill the window closest to its capacity; the chosen
counts are read back through the layers of the bitset.  The pattern is used as
often as the counts allow, then the next one is sought.  Pieces are numbered
within their length in salted groups, so a length shared by a third of all
pieces is still numbered by many tasks, and find their window by that number.

Defined cases: null text is empty and consists of its closing id; an added
token of the vocabulary inside a text is its one id, and what lies around it is
encoded as texts of their own; long texts give many pieces; repeated rows are
packed each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .textbatch import slices

#: Fixed value: the byte-level vocabulary's word pattern.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a task's memo keeps before it starts afresh, and the longest word kept.
MEMO_WORDS, MEMO_CHARS = 200_000, 64
#: Characters of one stretch of a long text.
STRETCH = 1 << 19
_ODD_SPACE = re.compile(r"\s\s|^ | $")
_PLAIN_SPACE = re.compile(r"(?<=\S) (?=\S)")


def _byte_of_char() -> dict[str, int]:
    """The vocabulary writes printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordTokenizer:
    """Token ids of a byte-level vocabulary file, with a memo of space-delimited words.

    No token spans a single space between two other characters except as its
    first character, so words are encoded apart.  Added tokens are cut out first.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        chars, vocab = _byte_of_char(), model["vocab"]
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if any(vocab[a] >= vocab[b] for a, b in zip(merges, merges[1:])):
            raise ValueError("merge order and ids differ in this vocabulary")
        formed = set(merges)
        ranks = {bytes([chars[c] for c in token]): i for token, i in vocab.items() if len(token) == 1 or token in formed}
        self.encode = tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memo: dict[str, bytes] = {}
        added = file.get("added_tokens") or []
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at their surroundings are not built")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        # The leftmost token is cut out, of those that begin there the longest.
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None

    def _stretches(self, text: str) -> Iterator[str]:
        """The text cut before single spaces between other characters."""
        at = 0
        while len(text) - at > STRETCH:
            found = _PLAIN_SPACE.search(text, at + STRETCH)
            if found is None:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.cuts is None or not self.cuts.search(text):
            return self._between(text)
        # Added tokens stand at the odd places.
        return b"".join(self.added[part] if k % 2 else self._between(part) for k, part in enumerate(self.cuts.split(text)) if part)

    def _between(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        memo, parts = self.memo, []
        for stretch in self._stretches(text):
            lead = stretch[:1] == " " and stretch[1:2].strip() != ""
            body = stretch[1:] if lead else stretch
            split = _PLAIN_SPACE.split(body) if _ODD_SPACE.search(body) else body.split(" ")
            units = [" " + w for w in split]
            if not lead:
                units[0] = split[0]
            try:
                parts.append(b"".join([memo[u] for u in units]))
                continue
            except KeyError:
                pass
            if len(memo) > MEMO_WORDS:
                memo.clear()
            found = []
            for u in units:
                got = memo.get(u)
                if got is None:
                    got = array("I", self.encode(u)).tobytes()
                    if len(u) <= MEMO_CHARS:
                        memo[u] = got
                found.append(got)
            parts.append(b"".join(found))
        return b"".join(parts)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(df: DataFrame, vocabulary: str, window: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: __id, start, length, ids_crc32, doc_tokens, and ids if asked for."""
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    end = array("I", [end_id]).tobytes()
    step = 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).ids
        for batch in batches:
            for first, stop, _, _ in slices(batch.column(1)):
                of, start, length, crc, total, ids = [], [], [], [], [], []
                for k, text in enumerate(batch.column(1).slice(first, stop - first).to_pylist(), first):
                    raw = (encode(text) if text else b"") + end
                    for at in range(0, len(raw), step):
                        part = raw[at : at + step]
                        of.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(len(raw) // 4)
                        if with_ids:
                            ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                arrays = [batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["__id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else ""))


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of lengths, from those at hand, whose sum comes closest to capacity from below."""
    mask = (1 << capacity + 1) - 1
    reach, layers = 1, []
    for length in sorted(counts, reverse=True):
        left, times = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(times, left)
            layers.append((reach, length, take))
            reach |= reach << length * take & mask
            left -= take
            times *= 2
        if reach >> capacity & 1:
            break
    best, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(layers):
        if not before >> best & 1:
            best -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Windows that use up the histogram: (counts of lengths in the window, number of such windows)."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        chosen = fill(rest, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // m for k, m in chosen.items())
        for k, m in chosen.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
        out.append((chosen, times))
    return out


def place(parts: DataFrame, window: int) -> DataFrame:
    """Adds sequence_id and offset to pieces with columns __id, start, length."""
    spark = parts.sparkSession
    # At most `window` rows, one for each length.
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, used, base = [], dict.fromkeys(histogram, 0), 0
    for chosen, times in patterns(histogram, window):
        at = 0
        for length in sorted(chosen, reverse=True):
            m = chosen[length]
            plan.append((length, used[length], used[length] + m * times, m, base, at))
            used[length] += m * times
            at += m * length
        base += times
    schema = "length long, from_rank long, to_rank long, per_window long, base long, at long"
    plan_rows = spark.createDataFrame(plan, schema) if plan else spark.createDataFrame([], schema)
    salts = max(64, -(-max(histogram.values(), default=1) // 200_000))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("__id", "start", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    order = Window.partitionBy("length", "salt").orderBy("__id", "start", "ids_crc32")
    ranked = (
        salted.withColumn("rank", F.row_number().over(order) - 1)
        .join(groups, ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("ahead"))
    )
    hit = (ranked["length"] == plan_rows["length"]) & (ranked["rank"] >= plan_rows["from_rank"]) & (ranked["rank"] < plan_rows["to_rank"])
    # The plan has at most window lengths in at most as many patterns, whatever the corpus.
    found = ranked.join(F.broadcast(plan_rows), hit).drop(plan_rows["length"])
    nth = F.col("rank") - F.col("from_rank")
    return found.select(
        *[F.col(c) for c in parts.columns],
        (F.col("base") + F.floor(nth / F.col("per_window"))).alias("sequence_id"),
        (F.col("at") + nth % F.col("per_window") * ranked["length"]).alias("offset"),
    )


def pack(df: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    return place(cut(pieces(df, vocabulary, window, end_id, id_col, text_col, with_ids)), window).withColumnRenamed("__id", id_col)


def sequences(packed: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """Token sequences from pieces packed with ids: sequence_id, input_ids padded to the window, n_tokens."""
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    return packed.groupBy("sequence_id").agg(ids.alias("ids")).select(
        "sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - F.size("ids"))).alias("input_ids"), F.size("ids").cast("long").alias("n_tokens")
    )
