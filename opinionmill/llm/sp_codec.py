"""SentencePiece encoding and decoding by a score-ordered agenda.

A merge-type vocabulary is applied as its library applies it: every adjacent
pair of symbols that forms a piece stands on an agenda ordered by score, then
by position; the best pair is merged, its neighbours are entered anew, until
nothing is left.  Characters outside the vocabulary fall back to byte pieces.

No piece of the vocabularies served here spans the edge between a run of
letters, a run of other characters and a following space (checked when the
model is loaded), so a text's encoding is the concatenation of the encodings
of such units.  Units recur, so each task keeps a bounded memo of them; the
agenda runs for many new units at once, one column of pending pair scores per
unit, and on a heap for long ones.  Every new unit's ids are compared with the
sentencepiece library inside the same Arrow batch.

Defined cases: null text is empty; an empty text gives the begin and end ids
and decodes to an empty string; a text of any length is encoded whole, in
stretches cut before a space; repeated rows are encoded each; further columns
are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Units kept by a task's memo before it starts afresh.
MEMO_UNITS = 600_000
#: Symbols beyond which a unit goes to the heap, and characters beyond which it isn't kept.
BATCH_SYMBOLS, MEMO_CHARS = 24, 48
#: Characters of one stretch of a long text.
STRETCH = 1 << 19
_NONE = np.int64(2**62)


class PieceCodec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        lib = self.library
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        normal = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        letters = "".join(re.escape(c) for c in sorted({c for i in normal for c in self.pieces[i] if c.isalpha()}))
        self.unit = re.compile(f"{SPACE}*[{letters}]+|{SPACE}*[^{letters}{SPACE}]+|{SPACE}+")
        if any(self.unit.fullmatch(self.pieces[i]) is None for i in normal):
            raise ValueError("a piece of this vocabulary spans a unit's edge")
        self.ids = {self.pieces[i]: i for i in normal}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        # Symbols: pieces, then characters that occur only inside pieces.
        symbols = dict(self.ids)
        for char in sorted({c for piece in self.ids for c in piece} - symbols.keys()):
            symbols[char] = size + len(symbols)
        self.symbols = symbols
        # Pairs that form a piece; rank 0 is the best score, equal scores share a rank.
        scores = {i: lib.get_score(i) for i in normal}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = symbols.get(piece[:k]), symbols.get(piece[k:])
                if left is not None and right is not None:
                    self.pairs[left, right] = (rank[scores[i]], i)
        keys = np.array([left << 32 | right for left, right in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([r << 32 | i for r, i in self.pairs.values()], dtype=np.int64)[order]
        self.inner = {s: c for c, s in symbols.items() if s >= size}
        self.symbol_of = -2 - np.arange(0x110000, dtype=np.int32)
        for char, s in symbols.items():
            if len(char) == 1:
                self.symbol_of[ord(char)] = s
        texts = [b"" if lib.is_control(i) else bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].replace(SPACE, " ").encode() for i in range(size)]
        self.piece_lengths = np.array([len(t) for t in texts])
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.piece_bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        # What the library puts before a text's first character.
        self.lead = len(lib.encode("\n")) - 1
        self.memo: dict[str, bytes] = {}

    # -- agenda -----------------------------------------------------------
    def _symbols(self, unit: str) -> list[int]:
        """Symbol of each character; one outside the vocabulary is -2 - its code point."""
        get = self.symbols.get
        return [s if (s := get(c)) is not None else -2 - ord(c) for c in unit]

    def agenda(self, unit: str) -> list[int]:
        """Symbols left when the heap of pending pairs is empty."""
        syms, pairs = self._symbols(unit), self.pairs
        n = len(syms)
        nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(*p, i, syms[i], syms[i + 1]) for i in range(n - 1) if (p := pairs.get((syms[i], syms[i + 1])))]
        heap = [(rank, i, piece, left, right) for rank, piece, i, left, right in heap]
        heapq.heapify(heap)
        while heap:
            _, i, piece, left, right = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or syms[i] != left or syms[j] != right:
                continue
            syms[i], alive[j], nxt[i] = piece, False, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for a, b in ((prev[i], i), (i, nxt[i])):
                if a >= 0 and b < n and (p := pairs.get((syms[a], syms[b]))):
                    heapq.heappush(heap, (p[0], a, p[1], syms[a], syms[b]))
        return [s for s, keep in zip(syms, alive) if keep]

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged piece of each pair as one integer; _NONE where the pair forms no piece."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], _NONE)

    def agendas(self, syms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many short units, a row each: every round merges each unit's best pending pair.

        Returns the symbols left, all rows in one array, and how many each row has.
        """
        n, width = syms.shape
        syms = np.concatenate([syms, np.full((n, 1), -1, dtype=np.int32)], axis=1)
        pending = self._look_up(syms[:, :-1], syms[:, 1:])
        out, counts, rows = syms.copy(), counts.copy(), np.arange(n)
        columns = np.arange(width + 1)
        while len(rows):
            # Equal ranks must go by position, so the piece is masked off before the best is picked.
            best = (pending >> 32).argmin(axis=1)
            here = np.arange(len(rows))
            value = pending[here, best]
            go = value != _NONE
            out[rows[~go], : syms.shape[1]] = syms[~go]
            rows, best, value, syms, pending = rows[go], best[go], value[go], syms[go], pending[go]
            if not len(rows):
                break
            here = np.arange(len(rows))
            syms[here, best] = (value & 0xFFFFFFFF).astype(np.int32)
            move = columns[None, : syms.shape[1] - 1]
            move = move + (move > best[:, None])
            syms = np.take_along_axis(syms, move, axis=1)
            pending = np.take_along_axis(pending, np.minimum(move[:, :-1], pending.shape[1] - 1), axis=1)
            counts[rows] -= 1
            for at in (best - 1, best):
                ok = (at >= 0) & (at < pending.shape[1])
                pending[here[ok], at[ok]] = self._look_up(syms[here[ok], at[ok]], syms[here[ok], at[ok] + 1])
        return out[np.arange(width + 1)[None, :] < counts[:, None]], counts

    # -- units ------------------------------------------------------------
    def _ids(self, symbols: list[int]) -> list[int]:
        """Ids of symbols; one that is no piece becomes its bytes."""
        ids: list[int] = []
        top = len(self.pieces)
        for s in symbols:
            if 0 <= s < top:
                ids.append(s)
            else:
                ids.extend(self.byte_ids[b] for b in (chr(-2 - s) if s < 0 else self.inner[s]).encode())
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids: pieces side by side, byte pieces as their bytes, control ids as nothing."""
        ids = ids[ids >= 0]
        lengths = self.piece_lengths[ids]
        total = int(lengths.sum())
        if not total:
            return b""
        ends = np.cumsum(lengths)
        at = np.arange(total) + np.repeat(self.piece_starts[ids] - (ends - lengths), lengths)
        return self.piece_bytes[at].tobytes()

    def encode_units(self, units: list[str]) -> dict[str, bytes]:
        """Ids of each unit as little-endian unsigned 32-bit integers, checked against the library."""
        out: dict[str, bytes] = {}
        units = sorted(units, key=len)
        for at in range(0, len(units), 4096):
            part = units[at : at + 4096]
            lengths = np.array([len(u) for u in part])
            short = int(np.searchsorted(lengths, BATCH_SYMBOLS, side="right"))
            blobs: list[bytes] = []
            if short:
                counts = lengths[:short]
                points = np.frombuffer("".join(part[:short]).encode("utf-32-le"), dtype="<u4")
                syms = np.full((short, int(counts[-1])), -1, dtype=np.int32)
                syms[np.arange(syms.shape[1])[None, :] < counts[:, None]] = self.symbol_of[points]
                flat, counts = self.agendas(syms, counts)
                ends = np.cumsum(counts)
                if ((flat < 0) | (flat >= len(self.pieces))).any():
                    rows = [self._ids(flat[e - c : e].tolist()) for c, e in zip(counts.tolist(), ends.tolist())]
                    counts = np.array([len(r) for r in rows])
                    ends, flat = np.cumsum(counts), np.array([i for r in rows for i in r], dtype=np.int32)
                raw = flat.astype("<u4").tobytes()
                blobs = [raw[4 * (e - c) : 4 * e] for c, e in zip(counts.tolist(), ends.tolist())]
            blobs += [np.array(self._ids(self.agenda(u)), dtype="<u4").tobytes() for u in part[short:]]
            self.check(part, blobs)
            out.update(zip(part, blobs))
        return out

    def check(self, units: list[str], blobs: list[bytes]) -> None:
        """Compare with the library, which gets the units as lines: a line feed is in no piece."""
        feed = self.byte_ids[10].to_bytes(4, "little")
        for at in range(0, len(units), 256):
            own = np.frombuffer(feed + feed.join(blobs[at : at + 256]), dtype="<u4")
            text = "\n" + "\n".join(units[at : at + 256]).replace(SPACE, " ")
            if not np.array_equal(own, np.array(self.library.encode(text)[self.lead :], dtype=np.uint32)):
                raise ValueError(f"agenda and library disagree within {units[at : at + 256]!r}")

    def stretches(self, text: str) -> Iterator[str]:
        """The text with its leading space mark, cut before spaces that follow another character."""
        text = SPACE + text.replace(" ", SPACE)
        at = 0
        while len(text) - at > STRETCH:
            end = at + STRETCH
            while (end := text.find(SPACE, end)) > 0 and text[end - 1] == SPACE:
                end += 1
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:]

    def encode_all(self, texts: list[str | None]) -> Iterator[list[bytes]]:
        """Ids of each text, in parts, without begin and end."""
        split = [[self.unit.findall(s) for s in self.stretches(t)] if t else [] for t in texts]
        memo, seen = self.memo, set()
        for text in split:
            for part in text:
                seen.update(part)
        if len(memo) > MEMO_UNITS:
            memo.clear()
        fresh = self.encode_units([u for u in seen if u not in memo])
        long = {u: fresh.pop(u) for u in [u for u in fresh if len(u) > MEMO_CHARS]}
        memo.update(fresh)
        get = (lambda u: memo[u] if u in memo else long[u]) if long else memo.__getitem__
        for text in split:
            yield [b"".join(map(get, part)) for part in text]


_codecs: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """One codec and memo for each worker process."""
    if model_path not in _codecs:
        _codecs[model_path] = PieceCodec(model_path)
    return _codecs[model_path]


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode and decode every text.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256, and with `with_ids`
    also ids array<int> and decoded string.  One narrow pass, no shuffle.
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if with_ids else []
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (c.bos, c.eos))
        for batch in batches:
            for first, stop in runs(batch.column(1)):
                out = {name: [] for name, _ in fields}
                for parts in c.encode_all(batch.column(1).slice(first, stop - first).to_pylist()):
                    h, d, decoded = hashlib.sha256(begin), hashlib.sha256(), []
                    for k, p in enumerate(parts):
                        h.update(p)
                        text = c.decode(np.frombuffer(p, dtype="<u4").astype(np.int64))
                        text = text if k else text[1:]  # without the space that encoding put first
                        d.update(text)
                        if with_ids:
                            decoded.append(text)
                    h.update(end)
                    out["n_tokens"].append(2 + sum(map(len, parts)) // 4)
                    out["ids_sha256"].append(h.hexdigest())
                    out["decoded_sha256"].append(d.hexdigest())
                    if with_ids:
                        out["ids"].append(np.frombuffer(begin + b"".join(parts) + end, dtype="<u4").astype(np.int32))
                        out["decoded"].append(b"".join(decoded).decode("utf-8", errors="replace"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, stop - first), *(pa.array(out[n], t) for n, t in fields)], names=["__id", *out]
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def runs(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` bytes of text."""
    from .textbatch import slices

    for first, stop, _, _ in slices(column, limit):
        yield first, stop
