"""N-gram Jaccard join with signature trees.

Every text is the set of its word shingles' 64-bit hashes; documents with the
same set form one class and are represented once.  Trees need the sets that
could link in one task, so sets are first dealt out: the hash range of shingles
is cut into parts, more than the largest symmetric difference that the
threshold allows for sets of that size.  Linked sets then hold the same
shingles in several parts, whose contents' hashes are the keys under which they
meet; unrelated texts that share a shingle, a line or a passage rarely do.
Sizes are classed by powers of two, and a set near a class's end also joins the
next one.  Keys travel packed, six bytes each, and all that follows goes by
fingerprints until sets are compared.

Sets that share with the first owner of their keys as many keys as linked sets
must, are searched first, as groups around that centre.  Then a key is open only
if its owners are of different components.  A set that links with another
component has as many open keys as linked sets must share; sets with fewer
leave.  Those left whose open keys have a set in common are searched as one.

A group is searched by a signature tree: a leaf entry is a set's bitmap of
hashed shingles with its size, a node the bitwise OR of its entries' bitmaps
with the range of their sizes.  Two trees (or a tree with itself) are traversed
together; a pair of nodes is left out when even the largest overlap that the
bitmaps allow is too small for the sizes.  What reaches the leaves is decided
by intersecting the sets, unless both are connected already: only links that
join components are wanted, so thousands of near copies give one spanning tree,
not its square.

Large groups are dealt out in blocks, so no task holds more than two blocks.
Around a centre each block has the centre; in an open group, blocks of sets
outside its main component meet each other, and those of the main component,
within reach of their sizes, each pair of blocks once.  As sets are sent to each
meeting of their block, these blocks are as large as a task's memory allows.

Defined cases: null and empty texts and texts without a word have no shingles
and no links; fewer words than a shingle's width make one shingle; texts are
read whole; repeated rows link with each other; rows that share an id are one
document with several texts, linked if any of them is; ids that are no integers
and thresholds of one half or less are errors, and a null id stands alone; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import cut, if_small
from .components import Forest, components
from .textbatch import mix, shingle_hashes, slices, word_hashes

#: Sets in a block, entries of a tree node.
BLOCK, FAN = 128, 8
#: Sets in a block of an open group and their bytes, at most; BLOCK sets are a block whatever their bytes.
OPEN_BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Rows of an intermediate table that make a task of their own worth while.
PART_ROWS = 50_000
#: Bytes of text to a bucket of posting lists, at most; they make some two million keys.
BUCKET_TEXT = 1 << 26
#: Keys that a task posts at once, copies it remembers, keys that a bucket sifts at once, owners that make a key crowded.
FLUSH, SEEN, BUCKET_KEYS, CROWD = 1 << 20, 1 << 18, 1 << 23, 4096


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each text."""
    for first, stop, data, offsets in slices(column):
        rows, hashes = word_hashes(data, offsets)
        at, values = shingle_hashes(rows, hashes, stop - first, width)
        ends = np.searchsorted(at, np.arange(stop - first + 1))
        for k in range(stop - first):
            yield first + k, np.unique(values[ends[k] : ends[k + 1]])


def _classes(n: int, num: int, den: int) -> tuple[int, ...]:
    """Size classes of a set of n: that of its own power of two and, near its end, the next."""
    level = n.bit_length()
    # Sets of the next class have 2**level shingles or more.
    return (level, level + 1) if n * den >= num << level else (level,)


def _difference(n: int, m: int, num: int, den: int) -> int:
    """Largest symmetric difference of two linked sets of n and m shingles."""
    return (n + m) * (den - num) // (den + num)


def _keys(s: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Size class, need and bucket keys of a sorted set for each of its size classes.

    A key is a hash of one part's content.  A class has more parts than linked
    sets can differ in; `need` is the least number of its keys that a set
    shares with any set it links with.  Empty parts give no key, unless so many
    are empty that all parts with shingles could differ; then partners of the
    same kind meet in empty ones.
    """
    n = len(s)
    if not n:
        return
    reach = n * den // num
    mixed = mix(s ^ np.uint64(0xA0761D6478BD642F))
    for level in _classes(n, num, den):
        top = (1 << level) - 1
        most = _difference(top, top, num, den)
        parts = most + 3 + most // 8
        part = (s >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        content = np.add.reduceat(mixed, starts)
        name = part[starts] * np.uint64(64) + np.uint64(level)
        need = len(starts) - _difference(n, min(reach, top), num, den)
        if need < 1:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[starts], assume_unique=True)
            content = np.concatenate([content, np.zeros(len(empty), dtype=np.uint64)])
            name = np.concatenate([name, empty * np.uint64(64) + np.uint64(level)])
        yield level, max(1, need), mix(content + mix(name + np.uint64(0x5851F42D4C957F2D)))


def part_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """All bucket keys of a sorted set."""
    found = [keys for _, _, keys in _keys(s, num, den)]
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64)


# -- postings -----------------------------------------------------------------
#: A posting list's head: the set's fingerprint, its need and size class, and how many keys follow.
_HEAD = np.dtype([("owner", "<i8"), ("need", "<u4"), ("count", "<u4"), ("level", "u1")])
_POSTS = "bucket int, __id long, n long, fp1 long, fp2 long, heads binary, keys binary"
_MEETINGS = "__id long, n long, fp1 long, fp2 long, gid long, level int, weight long, low long, low_need int, owners array<long>, needs array<int>"


def _batch(schema: pa.Schema, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _packed_posts(pending: list[tuple[int, int, int, np.ndarray]], buckets: int) -> dict[str, pa.Array]:
    """One row for each bucket: heads, and six bytes of each key; the bucket stands for the rest."""
    keys = np.concatenate([p[3] for p in pending])
    table = np.zeros(len(pending), dtype=_HEAD)
    table["owner"], table["need"], table["level"] = ([p[k] for p in pending] for k in (0, 1, 2))
    head = np.repeat(np.arange(len(pending)), [len(p[3]) for p in pending])
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    head, raw = head[order], (keys // np.uint64(buckets))[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    some, heads, packed_keys = np.flatnonzero(np.diff(edges)), [], []
    for b in some:
        own = head[edges[b] : edges[b + 1]]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        part = table[own[first]]
        part["count"] = np.diff(np.append(first, len(own)))
        heads.append(part.tobytes())
        packed_keys.append(raw[edges[b] : edges[b + 1]].tobytes())
    return {"bucket": pa.array(some), "heads": pa.array(heads, pa.binary()), "keys": pa.array(packed_keys, pa.binary())}


def _hashed(rows: DataFrame, width: int, num: int, den: int, buckets: int) -> DataFrame:
    """Every text read once: a row with __id, n and fingerprint, and rows of posting lists dealt to buckets."""
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.int64()) for c in ("__id", "n", "fp1", "fp2")), ("heads", pa.binary()), ("keys", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Copies within a task post once.
        seen, pending, size = set(), [], 0
        for batch in batches:
            known = np.asarray(batch.column(0).is_valid())
            n, one, two = (np.zeros(len(batch), dtype=np.int64) for _ in range(3))
            for row, s in _sets(batch.column(1), width):
                n[row] = len(s)
                one[row] = s.sum(dtype=np.uint64).astype(np.int64)
                two[row] = mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).astype(np.int64)
                if known[row] and (owner := int(one[row])) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(owner)
                    # A set too small to differ from any that it links with has no use for keys.
                    for level, need, keys in _keys(s, num, den) if _difference(len(s), len(s) * den // num, num, den) else ():
                        pending.append((owner, need, level, keys))
                        size += len(keys)
                if size >= FLUSH:
                    found = _packed_posts(pending, buckets)
                    yield _batch(schema, len(found["bucket"]), **found)
                    pending, size = [], 0
            deal = mix(np.asarray(batch.column(0).fill_null(0)).astype(np.uint64) + np.where(known, 0, np.arange(len(batch))).astype(np.uint64)) % np.uint64(buckets)
            yield _batch(schema, len(batch), bucket=pa.array(deal.astype(np.int32)), __id=batch.column(0), n=pa.array(n), fp1=pa.array(one), fp2=pa.array(two))
        if pending:
            found = _packed_posts(pending, buckets)
            yield _batch(schema, len(found["bucket"]), **found)

    return rows.mapInArrow(run, _POSTS)


class Bucket:
    """Posting lists of one bucket, and which sets meet in its keys.

    Sets that meet in several keys alike are told once, with the number of
    keys.  A key that very many share is told in portions, so that a bucket
    never holds more than its share of the keys and a portion.
    """

    def __init__(self) -> None:
        self.heads, self.keys, self.size, self.limit, self.crowded = [], [], 0, BUCKET_KEYS, np.zeros(0, dtype=np.uint64)

    def add(self, heads: bytes, keys: bytes) -> list[tuple]:
        raw = np.zeros((len(keys) // 6, 8), dtype=np.uint8)
        raw[:, :6] = np.frombuffer(keys, dtype=np.uint8).reshape(-1, 6)
        self.heads.append(np.frombuffer(heads, dtype=_HEAD))
        self.keys.append(raw.reshape(-1).view("<u8"))
        self.size += len(raw)
        return self.told(False) if self.size > self.limit else []

    def told(self, last: bool) -> list[tuple]:
        """gid, level, weight, low, low_need, owners, needs of each set of sets that meet; before the last only of crowded keys."""
        if not self.heads:
            return []
        heads, keys = np.concatenate(self.heads), np.concatenate(self.keys)
        at = np.repeat(np.arange(len(heads)), heads["count"])
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(first, len(keys)))
        # Only keys of two postings or more are looked at.
        shared = np.repeat(size > 1, size)
        key, own = keys[shared], at[shared]
        owner = heads["owner"][own]
        order = np.lexsort((owner, key))
        key, own, owner = key[order], own[order], owner[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, own, owner = key[fresh], own[fresh], owner[fresh]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(first, len(key)))
        self.crowded = np.union1d(self.crowded, key[first[size >= CROWD]])
        crowd = np.isin(key[first], self.crowded)
        out = [self._row(key[a], 1, own[a : a + n], heads) for a, n in zip(first[crowd], size[crowd]) if n > 1]
        if not last:
            # A crowded key keeps one owner, so that later ones meet it.
            gone = np.isin(keys, self.crowded)
            kept = np.concatenate([at[~gone], own[first[crowd]]])
            self.heads, self.keys = [heads[kept]], [np.concatenate([keys[~gone], key[first[crowd]]])]
            self.heads[0]["count"] = 1
            self.size = len(kept)
            self.limit = max(BUCKET_KEYS, 2 * self.size)
            return out
        plain = ~crowd & (size > 1)
        if plain.any():
            names = mix(np.add.reduceat(mix(owner.view(np.uint64)), first) + size.astype(np.uint64) * np.uint64(64) + heads["level"][own[first]])[plain]
            _, pick, times = np.unique(names, return_index=True, return_counts=True)
            starts, sizes = first[plain], size[plain]
            out += [self._row(names[k], t, own[starts[k] : starts[k] + sizes[k]], heads) for k, t in zip(pick, times)]
        return out

    @staticmethod
    def _row(name: np.uint64, weight: int, own: np.ndarray, heads: np.ndarray) -> tuple:
        h = heads[own]
        return int(mix(np.array([name])).view(np.int64)[0]), int(h["level"][0]), int(weight), int(h["owner"][0]), int(h["need"][0]), h["owner"], h["need"].astype(np.int32)


def _meetings(hashed: DataFrame, buckets: int) -> DataFrame:
    """The rows with __id as they are, and of each bucket the sets of sets that meet in it."""
    schema = pa.schema([
        *((c, pa.int64()) for c in ("__id", "n", "fp1", "fp2", "gid")), ("level", pa.int32()), ("weight", pa.int64()), ("low", pa.int64()), ("low_need", pa.int32()),
        ("owners", pa.list_(pa.int64())), ("needs", pa.list_(pa.int32())),
    ])

    def told(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        # A long list of owners goes out in several rows.
        cut_up = [(*r[:5], r[5][a : a + CROWD], r[6][a : a + CROWD]) for r in rows for a in range(0, len(r[5]), CROWD)]
        for a in range(0, len(cut_up), 4096):
            names = ("gid", "level", "weight", "low", "low_need", "owners", "needs")
            columns = {c: pa.array([r[k] for r in cut_up[a : a + 4096]], schema.field(c).type) for k, c in enumerate(names)}
            yield _batch(schema, len(columns["gid"]), **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket()
        for batch in batches:
            is_text = batch.column(5).is_null()
            texts = batch.filter(is_text)
            yield _batch(schema, len(texts), **{c: texts.column(k) for k, c in enumerate(texts.schema.names) if c in ("__id", "n", "fp1", "fp2")})
            posts = batch.filter(pc.invert(is_text))
            for heads, keys in zip(posts.column(5), posts.column(6)):
                yield from told(bucket.add(heads.as_py(), keys.as_py()))
        yield from told(bucket.told(True))

    return hashed.repartitionById(buckets, "bucket").mapInArrow(run, _MEETINGS)


# -- signature trees ----------------------------------------------------------
class Node:
    """OR of bitmaps, size range, and the most shingles that any entry lost to shared bits."""

    __slots__ = ("bits", "low", "high", "lost", "children", "entries")

    def __init__(self, children: list[Node] | None, entries: list[tuple] | None):
        self.children, self.entries = children, entries
        parts = [(c.bits, c.low, c.high, c.lost) for c in children] if children else [(e[2], e[0], e[0], e[0] - e[2].bit_count()) for e in entries]
        self.bits = 0
        for p in parts:
            self.bits |= p[0]
        self.low, self.high, self.lost = min(p[1] for p in parts), max(p[2] for p in parts), max(p[3] for p in parts)


def bitmap_width(n: int) -> int:
    """The power of two from n up, 64 at least."""
    return max(64, 1 << (n - 1).bit_length())


def packed(s: np.ndarray, width: int) -> bytes:
    """The set's shingles hashed to `width` bits."""
    bits = np.zeros(width, dtype=np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def build(members: list[tuple[int, np.ndarray, int]], width: int) -> Node:
    """Tree over (class, set, start label) members, ordered by size."""
    return grow([(len(s), k, int.from_bytes(packed(s, width), "big"), k, s, label) for k, s, label in members])


def grow(entries: list[tuple]) -> Node:
    """Tree over entries that begin with size, class and bitmap."""
    entries = sorted(entries, key=lambda e: (e[0], e[1]))
    level = [Node(None, entries[i : i + FAN]) for i in range(0, len(entries), FAN)]
    while len(level) > 1:
        level = [Node(level[i : i + FAN], None) for i in range(0, len(level), FAN)]
    return level[0]


class Traversal:
    """Walks two trees together and keeps the links that join components."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.forest = num, den, Forest()

    def _possible(self, a, b, lost: int, low_a: int, high_a: int, low_b: int, high_b: int) -> bool:
        """Could any pair under two bitmaps overlap enough for its sizes?"""
        num, den = self.num, self.den
        if high_a * den < num * low_b or high_b * den < num * low_a:
            return False
        return ((a & b).bit_count() + lost) * (num + den) >= num * (low_a + low_b)

    def walk(self, a: Node, b: Node) -> None:
        if a is not b and not self._possible(a.bits, b.bits, min(a.lost, b.lost), a.low, a.high, b.low, b.high):
            return
        if a.entries and b.entries:
            self._leaves(a, b)
        elif a is b:
            for i, x in enumerate(a.children):
                for y in a.children[i:]:
                    self.walk(x, y)
        elif a.children:
            for x in a.children:
                self.walk(x, b)
        else:
            for y in b.children:
                self.walk(a, y)

    def _linked(self, s: np.ndarray, t: np.ndarray) -> bool:
        common = len(np.intersect1d(s, t, assume_unique=True))
        return common * self.den >= self.num * (len(s) + len(t) - common)

    def _leaves(self, a: Node, b: Node) -> None:
        find = self.forest.find
        for i, (n, _, bits, k, s, label) in enumerate(a.entries):
            for m, _, other, j, t, label_j in a.entries[i + 1 :] if a is b else b.entries:
                if k == j or (x := find(label)) == (y := find(label_j)):
                    continue
                if not self._possible(bits, other, min(n - bits.bit_count(), m - other.bit_count()), n, n, m, m):
                    continue
                if self._linked(s, t):
                    self.forest.join(x, y)


def _width(sizes: list[int]) -> int:
    return max(256, 1 << (4 * max(sizes) - 1).bit_length())


def _join_groups(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links a, b found in each group: rows of `side` 0 with each other, or with those of side 1 if there are any.

    Rows: gid, side, __id, label, elements (the set as bytes).  Groups are at
    most two blocks.  Links are between labels, each with the smallest label of
    those the group connects it with.
    """

    def links(group: list[tuple]) -> list[tuple[int, int]]:
        seen, sides = set(), ([], [])
        for side, k, label, raw in group:
            if (side, k, raw) not in seen:
                seen.add((side, k, raw))
                sides[side].append((k, np.frombuffer(raw, dtype=np.uint64), label))
        if not sides[0] or len(sides[0]) + len(sides[1]) < 2:
            return []
        width = _width([len(m[1]) for s in sides for m in s])
        walk, left = Traversal(num, den), build(sides[0], width)
        walk.walk(left, build(sides[1], width) if sides[1] else left)
        return walk.forest.stars()

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, found = None, [], []
        for batch in batches:
            for gid, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if gid != key:
                    found += links(group) if group else []
                    key, group = gid, []
                group.append(row)
            if found:
                yield batch_of(found)
                found = []
        yield batch_of(links(group) if group else [])

    ordered = rows.select("gid", "side", "__id", "label", "elements").repartition("gid").sortWithinPartitions("gid")
    return ordered.mapInArrow(run, "a long, b long")


def _kept(rows: DataFrame) -> DataFrame:
    """Cut lineage; few rows are read again by few tasks, so that later shuffles aren't many tiny files."""
    rows = cut(rows)
    return rows.coalesce(rows.count() // PART_ROWS + 1)


def _elements(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """fp1, elements (the set as bytes) of the texts whose __id is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for _, s in _sets(batch.column(0), width)]
            prints = [s.sum(dtype=np.uint64).astype(np.int64) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["fp1", "elements"])

    return rows.join(if_small(wanted), "__id", "left_semi").select("text").mapInArrow(run, "fp1 long, elements binary")


def _near_centres(meetings: DataFrame, classes: DataFrame, rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links among sets that share enough keys with one and the same set.

    In each key the first owner is the centre.  A set that shares with a centre
    as many keys as linked sets do, joins its group; large groups are dealt out
    in blocks, each with the centre.
    """
    each = meetings.select("low", "low_need", "level", "weight", F.explode(F.arrays_zip("owners", "needs")).alias("o"))
    each = each.select("low", "low_need", "level", "weight", F.col("o.owners").alias("fp1"), F.col("o.needs").alias("need")).where("fp1 != low")
    sums = each.groupBy("low", "fp1", "level").agg(F.sum("weight").alias("weight"), F.max(F.greatest("need", "low_need")).alias("need"))
    spokes = _kept(sums.where("weight >= need").select("low", "fp1").distinct())
    counts = spokes.groupBy("low").agg(F.ceil(F.count("*") / (BLOCK - 1)).alias("salts"))
    spokes = spokes.join(counts, "low").select("low", "fp1", F.xxhash64("low", F.pmod(F.xxhash64("fp1"), "salts")).alias("gid"))
    members = _kept(spokes.select("gid", "fp1").unionByName(spokes.select("gid", F.col("low").alias("fp1"))).distinct())
    wanted = _kept(classes.join(members.select("fp1").distinct(), "fp1", "left_semi").select("fp1", "class_id"))
    sets = _elements(rows, wanted.select(F.col("class_id").alias("__id")), width)
    found = members.join(wanted, "fp1").join(sets, "fp1")
    return _join_groups(found.select("gid", F.lit(0).alias("side"), F.col("class_id").alias("__id"), F.col("class_id").alias("label"), "elements"), num, den)


def _open_groups(meetings: DataFrame, labelled: DataFrame) -> DataFrame:
    """gid, fp1, class_id, n, label of the sets that may still join components, grouped by the keys they share.

    Sets of different components that link share `need` keys or more, all of
    them open; so a set with fewer open keys has no such link and leaves.
    Keys that have a set in common are one group, so that each set is moved once.
    """

    def still_open(rows: DataFrame) -> DataFrame:
        ends = rows.groupBy("gid").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one != other")
        return rows.join(ends.select("gid"), "gid", "left_semi")

    each = meetings.select("gid", "level", "weight", F.explode(F.arrays_zip("owners", "needs")).alias("o"))
    each = each.select("gid", "level", "weight", F.col("o.owners").alias("fp1"), F.col("o.needs").alias("need"))
    left = _kept(still_open(each.join(labelled, "fp1")))
    enough = left.groupBy("class_id", "level").agg(F.sum("weight").alias("all"), F.max("need").alias("least")).where("all >= least")
    left = _kept(still_open(left.join(enough.select("class_id", "level"), ["class_id", "level"], "left_semi")))
    sets = left.select("fp1", "class_id", "n", "label").distinct()
    groups = components(left.join(left.groupBy("gid").agg(F.min("class_id").alias("a")), "gid").select("a", F.col("class_id").alias("b")))
    return sets.join(groups, F.col("class_id") == F.col("node")).select(F.col("component").alias("gid"), "fp1", "class_id", "n", "label")


def _salts() -> F.Column:
    """Blocks that a group's rows are dealt to."""
    size = F.greatest(F.ceil(F.count("*") / OPEN_BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES))
    return F.least(F.ceil(F.count("*") / BLOCK), size)


def _across(left: DataFrame, rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links between components among the sets of each open group."""
    left = _kept(left)
    sets = _elements(rows, left.select(F.col("class_id").alias("__id")).distinct(), width)
    columns = ["gid", "side", F.col("class_id").alias("__id"), "label", "elements"]
    sized = left.join(left.groupBy("gid").agg(_salts().alias("salts")), "gid")
    inside = sized.where("salts = 1").withColumn("side", F.lit(0)).drop("salts")
    large = _kept(sized.where("salts > 1").drop("salts"))
    if large.isEmpty():
        return _join_groups(inside.join(sets, "fp1").select(*columns), num, den)
    step = log(den / num) if den > num else log(2)
    main = large.groupBy("gid", "label").agg(F.count("*").alias("c")).groupBy("gid").agg(F.max(F.struct("c", "label"))["label"].alias("main"))
    large = large.join(main, "gid").withColumn("outside", F.col("label") != F.col("main")).withColumn("range", F.floor(F.log("n") / step))
    counts = large.groupBy("gid", "outside", "range").agg(_salts().alias("salts"))
    block = F.struct("outside", "range", F.pmod(F.xxhash64("fp1", "gid"), "salts").alias("salt"))
    blocked = _kept(large.join(counts, ["gid", "outside", "range"]).select("gid", block.alias("block"), "fp1", "class_id", "label"))
    # Blocks outside the main component meet all blocks in reach, and each other once; a block alone is one side.
    blocks = blocked.groupBy("gid", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    near = F.explode(F.array(*[F.col("block.range") + k for k in (-1, 0, 1)])).alias("range")
    asking = blocks.where("block.outside").select("gid", F.col("block").alias("asks"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), near)
    pairs = asking.join(blocks.withColumn("range", F.col("block.range")), ["gid", "range"]).where("not block.outside or asks <= block")
    pairs = pairs.where("not (low = high and a_low = a_high and low = a_low)").drop("range", "low", "high", "a_low", "a_high")
    pairs = _kept(pairs.withColumn("pair", F.xxhash64("gid", "asks", "block")))
    asked = blocked.join(pairs.select("gid", F.col("asks").alias("block"), "pair"), ["gid", "block"]).withColumn("side", F.lit(0))
    told = blocked.join(pairs.where("asks != block").select("gid", "block", "pair"), ["gid", "block"]).withColumn("side", F.lit(1))
    both = asked.unionByName(told).select(F.col("pair").alias("gid"), "side", "fp1", "class_id", "label")
    return _join_groups(inside.select("gid", "side", "fp1", "class_id", "label").unionByName(both).join(sets, "fp1").select(*columns), num, den)


def _bucket_count(rows: DataFrame) -> int:
    """As many buckets as the texts need, so that a task's posting lists stay bounded whatever the session's partitions are."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(size / BUCKET_TEXT))


def near_duplicates(df: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id_col, n_shingles, component_id.

    Two documents link when the intersection of their shingle sets is at least
    threshold (numerator, denominator; above one half) of the union;
    component_id is the smallest id reachable by links.
    """
    num, den = threshold
    if 2 * num <= den or num > den:
        raise ValueError("the threshold must be above one half and at most one")
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets = _bucket_count(rows)
    read = _kept(_meetings(_hashed(rows, width, num, den, buckets), buckets))
    texts, meetings = read.where("gid is null").select("__id", "n", "fp1", "fp2"), read.where("gid is not null").drop("__id", "n", "fp1", "fp2")
    # Documents with the same set are one class, represented by its smallest id.
    some = texts.where("n > 0 and __id is not null")
    classes = _kept(some.groupBy("fp1", "fp2", "n").agg(F.min("__id").alias("class_id")))
    near = components(_near_centres(meetings, classes, rows, width, num, den))
    labelled = classes.join(near, F.col("class_id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "class_id"))
    labelled = _kept(labelled.select("fp1", "fp2", "n", "class_id", "label"))
    far = _across(_open_groups(meetings, labelled.select("fp1", "class_id", "n", "label")), rows, width, num, den)
    # Rows that share an id connect their classes.
    twins = some.groupBy("__id").agg(F.min(F.struct("fp1", "fp2")).alias("one"), F.max(F.struct("fp1", "fp2")).alias("other")).where("one != other").select("__id")
    twins = some.join(twins, "__id").join(labelled, ["fp1", "fp2", "n"]).select("__id", "label")
    twins = twins.join(twins.groupBy("__id").agg(F.min("label").alias("b")), "__id").select(F.col("label").alias("a"), "b")
    more = _kept(far.unionByName(twins).where("a != b"))
    if not more.isEmpty():
        merged = components(more)
        labelled = labelled.join(merged, F.col("label") == F.col("node"), "left").withColumn("label", F.coalesce("component", "label"))
    found = texts.join(labelled.select("fp1", "fp2", "n", "label"), ["fp1", "fp2", "n"], "left")
    component = F.when(F.col("__id").isNotNull(), F.coalesce("label", "__id"))
    return found.select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
