"""Secret scan: base patterns, and formats inferred from what they find.

The base patterns label credentials: values assigned to a name such as
`token`, access keys, long hexadecimal runs.  From a bounded sample of each
kind's labelled values a prefix tree is built and its statistically compatible
states are merged (red and blue states, Hoeffding's bound on every outgoing
frequency) into a probabilistic automaton; another one is inferred from
ordinary tokens.  Every candidate, that is every run of credential characters
long enough, is scored by its likelihood: the mean over its characters of the
log-odds between the best kind's automaton and the ordinary one.  Candidates
that overlap no base span and score `margin` or more, and no less than
`quantile` of that kind's labelled values do, are further spans of the kind
`format`.  Base spans always stay.

Training reads all texts for labelled values and keeps TRAIN_VALUES different
ones of each kind, the first by a hash of the value, none longer than
TRAIN_CHARS; scanning reads whole texts in one narrow pass.

Defined cases: null text is empty; empty texts have no spans; a text of any
length is read whole; null ids and repeated rows are scanned each; without
labelled values of any kind there are no formats; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

# The base patterns and the characters that their values need; letters of the names may be in either case.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex"]
LEAST = {"assign": 6, "access": 20, "hex": 24}
FORMAT, ORDINARY = "format", "ordinary"

#: Characters of credentials, and of a candidate at least.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
CANDIDATE_CHARS = 16
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{CANDIDATE_CHARS},}}")
#: Different values of each kind that automata are inferred from, and their characters, at most.
TRAIN_VALUES, TRAIN_CHARS = 1000, 256
#: Confidence of Hoeffding's bound; weight of unseen characters; log-odds to a character that a format needs; share of labelled values that may score less.
ALPHA, UNSEEN, MARGIN, QUANTILE = 0.05, 0.05, 1.0, 0.05

_CODE = {c: k for k, c in enumerate(ALPHABET)}
_END = len(ALPHABET)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind, value of the base matches, leftmost and without overlap in each kind, by start and kind."""
    found = [(m.start(), m.end(), 0, m.group(1)) for m in ASSIGN.finditer(text) if len(m.group(1)) >= LEAST["assign"]]
    found += [(m.start(), m.end(), 1, m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # Such a run is matched from its beginning, as every shorter one is dropped.
    found += [(m.start(), m.end(), 2, m.group()) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k], v) for a, b, k, v in sorted(found)]


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of credential characters that overlap nothing taken; full stops at the end aren't theirs."""
    out, k, taken = [], 0, sorted(taken)
    reach = 0
    for m in CANDIDATE.finditer(text):
        a, b = m.start(), m.end()
        while b > a and text[b - 1] == ".":
            b -= 1
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if b - a >= CANDIDATE_CHARS and reach <= a:
            out.append((a, b))
    return out


@dataclass
class Automaton:
    """States with a next state and a log-probability for each character; the last column ends a value."""

    step: list[list[int]]
    gain: list[list[float]]

    def score(self, value: str) -> float:
        """Log-likelihood of a value."""
        state, total = 0, 0.0
        for c in value:
            code = _CODE[c]
            total += self.gain[state][code]
            state = self.step[state][code]
        return total + self.gain[state][_END]


class Tree:
    """A prefix tree with counts, whose states are merged."""

    def __init__(self, values: list[str]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.taken: list[dict[int, int]] = [{}]
        self.through, self.ends = [0], [0]
        for value in values:
            state = 0
            self.through[0] += 1
            for c in value:
                code = _CODE[c]
                self.taken[state][code] = self.taken[state].get(code, 0) + 1
                if code not in self.next[state]:
                    self.next[state][code] = len(self.next)
                    self.next.append({})
                    self.taken.append({})
                    self.through.append(0)
                    self.ends.append(0)
                state = self.next[state][code]
                self.through[state] += 1
            self.ends[state] += 1

    def compatible(self, red: int, blue: int, alpha: float) -> bool:
        """Whether no frequency of the two states, or of states they reach alike, differs beyond Hoeffding's bound."""
        width = math.sqrt(0.5 * math.log(2 / alpha))
        todo = [(red, blue)]
        while todo:
            x, y = todo.pop()
            n, m = self.through[x], self.through[y]
            if not n or not m:
                continue
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound >= 1:
                continue  # too little is known of the two to tell them apart
            if abs(self.ends[x] / n - self.ends[y] / m) > bound:
                return False
            for code in self.taken[x].keys() | self.taken[y].keys():
                if abs(self.taken[x].get(code, 0) / n - self.taken[y].get(code, 0) / m) > bound:
                    return False
                if code in self.next[x] and code in self.next[y]:
                    todo.append((self.next[x][code], self.next[y][code]))
        return True

    def fold(self, red: int, blue: int) -> None:
        """Adds the tree below `blue` to what `red` reaches."""
        todo = [(red, blue)]
        while todo:
            x, y = todo.pop()
            self.through[x] += self.through[y]
            self.ends[x] += self.ends[y]
            for code, n in self.taken[y].items():
                self.taken[x][code] = self.taken[x].get(code, 0) + n
            for code, below in self.next[y].items():
                if code in self.next[x]:
                    todo.append((self.next[x][code], below))
                else:
                    self.next[x][code] = below


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    """Merges compatible states, the most frequent first; a state that fits none becomes one of the automaton's."""
    tree = Tree(values)
    red, members = [0], {0}
    blue: list[tuple[int, int, int, int]] = []
    def open_(state: int) -> None:
        for code, below in tree.next[state].items():
            if below not in members:
                heappush(blue, (-tree.through[below], below, state, code))
    open_(0)
    while blue:
        _, state, parent, code = heappop(blue)
        if tree.next[parent].get(code) != state or state in members:
            continue
        for other in red:
            if tree.compatible(other, state, alpha):
                tree.next[parent][code] = other
                tree.fold(other, state)
                # What was added below the states changed may be new at the edge.
                for r in red:
                    open_(r)
                break
        else:
            red.append(state)
            members.add(state)
            open_(state)
    place = {s: k for k, s in enumerate(red)}
    step, gain = [], []
    for s in red:
        n = tree.through[s] + UNSEEN * (_END + 1)
        # A character that a state never saw leads back to the first one.
        step.append([place[tree.next[s][c]] if c in tree.next[s] else 0 for c in range(_END)] + [0])
        gain.append([math.log((tree.taken[s].get(c, 0) + UNSEEN) / n) for c in range(_END)] + [math.log((tree.ends[s] + UNSEEN) / n)])
    return Automaton(step, gain)


@dataclass
class Model:
    """An automaton and a least score for each kind with labelled values, and the automaton of ordinary tokens."""

    kinds: dict[str, Automaton]
    least: dict[str, float]
    ordinary: Automaton | None

    def odds(self, value: str) -> dict[str, float]:
        """Log-odds to a character of each kind against ordinary tokens."""
        plain = self.ordinary.score(value)
        return {k: (a.score(value) - plain) / len(value) for k, a in self.kinds.items()}

    def is_format(self, value: str) -> tuple[bool, float]:
        odds = self.odds(value)
        return any(x >= self.least[k] for k, x in odds.items()), max(odds.values())


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big") >> 1


def labelled_values(docs: DataFrame, text_col: str = "text", rows: int = TRAIN_VALUES) -> DataFrame:
    """kind, value: at most `rows` different labelled values of each kind, and as many ordinary candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[str, int]] = {k: {} for k in [*KINDS, ORDINARY]}
        for batch in batches:
            for cell in batch.column(0):
                text = cell.as_py()
                spans = base_spans(text)
                found = [(kind, value) for _, _, kind, value in spans]
                found += [(ORDINARY, text[a:b]) for a, b in candidates(text, [s[:2] for s in spans])]
                for kind, value in found:
                    if len(value) <= TRAIN_CHARS:
                        kept[kind][value] = _hash(value)
                for kind, values in kept.items():
                    if len(values) > 4 * rows:
                        kept[kind] = dict(sorted(values.items(), key=lambda x: (x[1], x[0]))[:rows])
        out = [(k, v, h) for k, values in kept.items() for v, h in sorted(values.items(), key=lambda x: (x[1], x[0]))[:rows]]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "value", "hash"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = cut(texts.mapInArrow(run, "kind string, value string, hash long").distinct())
    parts = [found.where(F.col("kind") == k).orderBy("hash", "value").limit(rows) for k in [*KINDS, ORDINARY]]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select("kind", "value")


def fit(docs: DataFrame, text_col: str = "text", rows: int = TRAIN_VALUES, alpha: float = ALPHA, margin: float = MARGIN, quantile: float = QUANTILE) -> Model:
    """Automata of the labelled values of `docs`; at most 4 * rows values of TRAIN_CHARS characters reach the driver."""
    values: dict[str, list[str]] = {}
    for row in labelled_values(docs, text_col, rows).collect():
        values.setdefault(row["kind"], []).append(row["value"])
    ordinary = infer(sorted(values.pop(ORDINARY, [])), alpha)
    model = Model({k: infer(sorted(v), alpha) for k, v in values.items()}, {}, ordinary)
    for kind, own in values.items():
        scores = [model.odds(v)[kind] for v in own]
        model.least[kind] = max(margin, float(np.quantile(scores, quantile)))
    return model


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans (start, end, kind, score, text) of every row, by start and kind; offsets count code points.

    The score of a base span is that of its value, null without a model of any kind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = []
            for cell in batch.column(1):
                text = cell.as_py()
                base = base_spans(text)
                rows = [{"start": a, "end": b, "kind": k, "score": max(model.odds(v).values()) if model.kinds else None, "text": text[a:b]} for a, b, k, v in base]
                if model.kinds:
                    for a, b in candidates(text, [s[:2] for s in base]):
                        good, score = model.is_format(text[a:b])
                        if good:
                            rows.append({"start": a, "end": b, "kind": FORMAT, "score": score, "text": text[a:b]})
                    rows.sort(key=lambda r: (r["start"], [*KINDS, FORMAT].index(r["kind"])))
                out.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], names=["__id", "spans"])

    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, spans array<struct<start:long,end:long,kind:string,score:double,text:string>>").withColumnRenamed("__id", id_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans, n_format of scanned rows."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != FORMAT)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
        count(FORMAT).alias("n_format"),
    )
