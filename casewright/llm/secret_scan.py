"""Secrets in texts: fixed formats, and further formats by probabilistic automata.

The fixed formats (assignments, access keys, hex strings) are found in every whole text. A bounded sample
of what they find, by kind, are the labelled credentials: each kind's strings, written as character
classes, form a prefix tree, and states whose outgoing frequencies do not differ by a Hoeffding test are
merged, from the root on, into a probabilistic automaton. Other long runs of credential characters
that none of them finds usual train one more automaton, for what is no credential. Every run of 12 or more such
characters (the shortest value of an assignment) is then scored by all automata, as a whole, full stops at its end left
out; only runs that a fixed format covers altogether are not, as they are spans already. A run is added where one of the
credentials' automata makes it far likelier than the other does, and about as likely as that kind's own strings.

Two passes over the texts, no shuffle of texts; the sample is the same in every run (smallest hashes).

Defined results: a NULL or empty text has no spans; repeated or NULL keys keep a row each; an empty table
gives no rows and an empty model; only the key and the text are read. Equal starts are ordered by kind.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import blocks, runs, stored, text_bytes

KINDS = ("assign", "access", "hex", "format")
#: Distinct strings of each kind, and of other runs, from which the automata are learned, and their longest length.
SAMPLE, LONGEST = 400, 128
#: Significance of the Hoeffding test, and probability of a step that no training string took.
ALPHA, UNSEEN = 0.05, 1e-3
#: Natural logarithm of how much likelier a credential's automaton must be than the other runs'.
MARGIN = math.log(1000)
#: Characters that a run needs to be a candidate: as many as the value of an assignment.
MIN_RUN = 12

ASSIGN = re.compile(
    rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def _members(pattern: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(pattern, np.uint8)] = True
    return out


_DIGITS, _UPPER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX, ACCESS = _members(_DIGITS + b"abcdef"), _members(_DIGITS + _UPPER)
CREDENTIAL = _members(_DIGITS + _UPPER + _UPPER.lower() + b"+/_.=-")
#: Character classes that the automata read: digits, a to f, other small letters, capitals, and each sign by itself.
CLASS = bytes(
    48 if c in _DIGITS else 97 if c in b"abcdef" else 122 if 97 <= c <= 122 else 65 if 65 <= c <= 90 else c
    for c in range(256)
)

Span = tuple[int, int, int]


def base_spans(data: np.ndarray, at: np.ndarray) -> list[Span]:
    """(kind, start, end) in bytes of all texts, leftmost and non-overlapping by kind."""
    raw, found = data.tobytes(), []
    lower = raw.lower()
    hits = []
    for word in KEYWORDS:
        place = lower.find(word)
        while place >= 0:
            hits.append(place)
            place = lower.find(word, place + 1)
    hits.sort()
    ends = at[np.searchsorted(at, hits, "right")] if hits else ()
    last = 0
    for place, end in zip(hits, ends, strict=True):
        if place >= last and (match := ASSIGN.match(raw, place, int(end))):
            last = match.end()
            if len(match[1]) >= 12:
                found.append((0, place, last))
    start, stop = runs(ACCESS[data], at)
    for i in np.flatnonzero(stop - start >= 18):
        begin = raw.find(b"AKIA", start[i], stop[i])
        if begin >= 0 and stop[i] - begin >= 18:
            found.append((1, begin, int(stop[i])))
    start, stop = runs(HEX[data], at)
    long = stop - start >= 16
    found += [(2, b, e) for b, e in zip(start[long].tolist(), stop[long].tolist(), strict=True)]
    return found


def candidate_runs(data: np.ndarray, at: np.ndarray, base: Sequence[Span]) -> list[tuple[int, int]]:
    """Runs of credential characters, without full stops at the end, that no base spans cover as a whole."""
    start, stop = runs(CREDENTIAL[data], at)
    long = stop - start >= MIN_RUN
    start, stop = start[long], stop[long]
    solid = np.concatenate([[0], np.maximum.accumulate(np.where(data != ord("."), np.arange(1, len(data) + 1), 0))])
    stop = solid[stop]
    covered = np.zeros(len(data) + 1, np.int64)
    for _, b, e in base:
        covered[b] += 1
        covered[e] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    free = stop - start >= MIN_RUN
    start, stop = start[free], stop[free]
    free = covered[stop] - covered[start] < stop - start
    return list(zip(start[free].tolist(), stop[free].tolist(), strict=True))


@dataclass
class State:
    visits: int = 0
    ends: int = 0
    next: dict[int, int] = field(default_factory=dict)
    taken: dict[int, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton learned by merging the compatible states of a prefix tree."""

    def __init__(self, strings: Sequence[bytes]):
        self.states = [State()]
        for string in strings:
            at = 0
            for symbol in string:
                state = self.states[at]
                state.visits += 1
                state.taken[symbol] = state.taken.get(symbol, 0) + 1
                if symbol not in state.next:
                    state.next[symbol] = len(self.states)
                    self.states.append(State())
                at = state.next[symbol]
            self.states[at].visits += 1
            self.states[at].ends += 1
        kept = [0]
        while True:
            edge = min(
                ((r, s) for r in kept for s, to in self.states[r].next.items() if to not in kept), default=None
            )
            if edge is None:
                break
            parent, symbol = edge
            blue = self.states[parent].next[symbol]
            for red in kept:
                if self._alike(red, blue):
                    self.states[parent].next[symbol] = red
                    self._fold(red, blue)
                    break
            else:
                kept.append(blue)
        scores = sorted(self.log_likelihood(s) / (len(s) + 1) for s in strings)
        #: The mean a symbol that all but the oddest hundredth of the strings reach.
        self.usual = scores[len(scores) // 100] if scores else 0.0

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = (self.states[i] for i in todo.pop())
            if not p.visits or not q.visits:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (p.visits**-0.5 + q.visits**-0.5)
            if abs(p.ends / p.visits - q.ends / q.visits) > bound:
                return False
            for symbol in p.taken.keys() | q.taken.keys():
                if abs(p.taken.get(symbol, 0) / p.visits - q.taken.get(symbol, 0) / q.visits) > bound:
                    return False
                if symbol in p.next and symbol in q.next:
                    todo.append((p.next[symbol], q.next[symbol]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the subtree at ``tree``, which nothing else points into, to the state ``into``."""
        todo = [(into, tree)]
        while todo:
            i, t = todo.pop()
            p, q = self.states[i], self.states[t]
            p.visits += q.visits
            p.ends += q.ends
            for symbol, times in q.taken.items():
                p.taken[symbol] = p.taken.get(symbol, 0) + times
                if symbol in p.next:
                    todo.append((p.next[symbol], q.next[symbol]))
                else:
                    p.next[symbol] = q.next[symbol]

    def is_usual(self, string: bytes) -> bool:
        return self.log_likelihood(string) / (len(string) + 1) >= self.usual

    def log_likelihood(self, string: bytes) -> float:
        total, at = 0.0, 0
        for symbol in string:
            state = self.states[at]
            times = state.taken.get(symbol, 0)
            total += math.log(max(UNSEEN, (1 - UNSEEN) * times / max(1, state.visits)))
            at = state.next.get(symbol, 0)
        state = self.states[at]
        return total + math.log(max(UNSEEN, state.ends / max(1, state.visits)))


@dataclass
class FormatModel:
    credentials: list[Automaton]
    other: Automaton

    @classmethod
    def of(cls, credentials: Sequence[Sequence[bytes]], runs: Sequence[bytes]) -> FormatModel:
        """``runs`` that look like a credential do not teach what is none."""
        own = [Automaton(strings) for strings in credentials if strings]
        return cls(own, Automaton([r for r in runs if not any(a.is_usual(r) for a in own)]))

    def is_secret(self, run: bytes) -> bool:
        string = run.translate(CLASS)
        other = self.other.log_likelihood(string)
        return any(a.is_usual(string) and a.log_likelihood(string) - other >= MARGIN for a in self.credentials)


def all_spans(data: np.ndarray, at: np.ndarray, model: FormatModel) -> list[Span]:
    """The fixed formats' spans and those that the automata add, by start and then kind."""
    base, raw = base_spans(data, at), data.tobytes()
    candidates = candidate_runs(data, at, base)
    secret = {run: model.is_secret(run) for run in {raw[b:e] for b, e in candidates}}
    found = base + [(3, b, e) for b, e in candidates if secret[raw[b:e]]]
    return sorted(found, key=lambda s: (s[1], s[0]))


def learn_formats(docs: DataFrame, text: str = "text") -> FormatModel:
    """Automata from a bounded sample: the ``SAMPLE`` strings of each kind with the smallest hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            data, at = text_bytes(block.column(0))
            raw, base = data.tobytes(), base_spans(data, at)
            found = {(kind, raw[b:e]) for kind, b, e in base if e - b <= LONGEST}
            found |= {(3, raw[b:e]) for b, e in candidate_runs(data, at, base) if e - b <= LONGEST}
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int32()), pa.array([s.decode() for _, s in rows], pa.string())],
                ["kind", "run"],
            )

    strings = stored(docs.select(F.col(text).alias("text")).mapInArrow(work, "kind int, run string").distinct(), "runs")
    samples = []
    for kind in range(len(KINDS)):
        picked = strings.where(F.col("kind") == kind).orderBy(F.xxhash64("run"), "run").limit(SAMPLE).collect()
        samples.append([ASSIGN.sub(rb"\1", r.run.encode()).translate(CLASS) for r in picked])
    return FormatModel.of(samples[:3], samples[3])


def scan(docs: DataFrame, model: FormatModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and ``spans``, (kind, start, end) in code points, by start and then kind."""
    key = docs.schema[doc_id].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            data, at = text_bytes(block.column(1))
            spans = all_spans(data, at, model)
            before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            start = np.array([s[1] for s in spans], np.int64)
            owner = np.searchsorted(at, start, "right") - 1
            # an empty text begins where the next one does; the last of equal offsets owns the bytes
            first = before[at[owner]]
            rows = pa.StructArray.from_arrays(
                [
                    pa.array([KINDS[s[0]] for s in spans], pa.string()),
                    pa.array(before[start] - first),
                    pa.array(before[np.array([s[2] for s in spans], np.int64)] - first),
                ],
                fields=list(span),
            )
            offsets = pa.array(np.searchsorted(owner, np.arange(block.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.ListArray.from_arrays(offsets, rows)], [doc_id, "spans"]
            )

    schema = f"{doc_id} {key}, spans array<struct<kind:string,start:long,end:long>>"
    return docs.select(doc_id, F.col(text).alias("text")).mapInArrow(work, schema)


def redact(docs: DataFrame, model: FormatModel, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows with all their columns; spans of the text, joined where they touch or overlap, become ``mark``."""
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for block in blocks(iter([batch.select([place]).rename_columns(["text"])])):
                rows = batch.slice(start, block.num_rows)
                start += block.num_rows
                data, at = text_bytes(block.column(0))
                changed: dict[int, list[Span]] = {}
                for span in all_spans(data, at, model):
                    changed.setdefault(int(np.searchsorted(at, span[1], "right")) - 1, []).append(span)
                if changed:
                    texts, raw = rows.column(place).to_pylist(), data.tobytes()
                    for i, spans in changed.items():
                        texts[i] = _marked(raw, int(at[i]), int(at[i + 1]), spans, mark)
                    rows = rows.set_column(place, rows.schema.field(place), pa.array(texts, rows.schema.field(place).type))
                yield rows

    return docs.mapInArrow(work, docs.schema)


def _marked(raw: bytes, start: int, stop: int, spans: list[Span], mark: str) -> str:
    parts, last = [], start
    for _, low, high in spans:
        if low > last or not parts:
            parts += [raw[last:low].decode(), mark]
        last = max(last, high)
    return "".join(parts) + raw[last:stop].decode()
