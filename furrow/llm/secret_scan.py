"""Secret scanning with one deterministic automaton for all rules.

Rule regexes are read by Python's own regex parser, turned into one automaton over bytes by
subset construction, minimised, and laid out as transition arrays. One pass over the bytes runs
all rules at once: a batch of texts is one buffer, cut into lanes at bytes that send every state
back to the start (nothing can match across them), and the lanes advance together on arrays.
Only the stretches between such bytes in which a rule matched are resolved to spans, leftmost
and longest first, by each rule's own automaton; a rule's ``check`` may then drop a span.

Spans count code points, end exclusive. Null text counts as empty and has no spans; ``redact`` leaves it
null. A very long text is scanned whole, in a batch of its own. Spans that start together are in the order
of the rules; repeated rows and rows with equal or null ids are scanned each. An empty table gives an
empty one. ``report`` reads doc_id and text alone, ``redact`` keeps columns of any name, ``find`` replaces a
column named spans. Rules whose automaton leaves no byte that sends all states to the start are refused.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices


@dataclass(frozen=True)
class Rule:
    """``scan`` may be a narrower form of ``pattern`` with the same spans after the checks."""

    kind: str
    pattern: str
    least: int = 0  # characters of the group that count
    group: int = 0
    scan: str = ""


#: The three base kinds, in their order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32, scan=r"[0-9a-f]{32,}"),
)
#: Further kinds of this operator.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree, at: int, fold: bool) -> int:
        """Chain the parsed items after state ``at``; the state behind them."""
        for op, arg in tree:
            if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
                to = self.state()
                self.moves[at].append((_bytes(op, arg, fold), to))
                at = to
            elif op is C.SUBPATTERN:
                _, on, off, inner = arg
                at = self.add(inner, at, (fold or bool(on & re.I)) and not off & re.I)
            elif op is C.BRANCH:
                end = self.state()
                for inner in arg[1]:
                    begin = self.state()
                    self.free[at].append(begin)
                    self.free[self.add(inner, begin, fold)].append(end)
                at = end
            elif op is C.MAX_REPEAT:
                low, high, inner = arg
                for _ in range(low):
                    at = self.add(inner, at, fold)
                if high is C.MAXREPEAT:
                    loop = self.state()
                    self.free[at].append(loop)
                    self.free[self.add(inner, loop, fold)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    self.free[at].append(end)
                    for _ in range(high - low):
                        at = self.add(inner, at, fold)
                        self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"rules can't use {op}")
        return at

    def closed(self, states) -> frozenset:
        seen, stack = set(states), list(states)
        while stack:
            for s in self.free[stack.pop()]:
                if s not in seen:
                    seen.add(s)
                    stack.append(s)
        return frozenset(seen)


def _bytes(op, arg, fold: bool) -> frozenset:
    if op is C.ANY:
        return frozenset(range(256)) - {10}
    items = [(op, arg)] if op is not C.IN else arg
    got, negate = set(), False
    for kind, value in items:
        if kind is C.NEGATE:
            negate = True
        elif kind in (C.LITERAL, C.NOT_LITERAL):
            got.add(value)
            negate |= kind is C.NOT_LITERAL
        elif kind is C.RANGE:
            got.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"rules can't use {kind}")
    if max(got, default=0) > 127:
        raise ValueError("rules are ASCII")
    if fold:
        got |= {ord(chr(b).swapcase()) for b in got if chr(b).isalpha()}
    return frozenset(set(range(256)) - got if negate else got)


class Dfa:
    """Transition array [state, byte] and a bit mask of the rules that accept in each state."""

    def __init__(self, patterns: list[str], anchored: bool):
        nfa, begins, accept = _Nfa(), [], {}
        for bit, pattern in enumerate(patterns):
            begin = nfa.state()
            accept[nfa.add(_parser.parse(pattern), begin, False)] = 1 << bit
            begins.append(begin)
        first = nfa.closed(begins)
        table, masks = self._subsets(nfa, first, accept, anchored)
        self.step, self.mask = self._minimal(table, masks)

    @staticmethod
    def _subsets(nfa: _Nfa, first: frozenset, accept: dict, anchored: bool):
        number, table, todo = {first: 0}, [], [first]
        while todo:
            now, row = todo.pop(0), [set() if anchored else set(first) for _ in range(256)]
            for s in now:
                for some, to in nfa.moves[s]:
                    for b in some:
                        row[b].add(to)
            ids, seen = [], {}
            for targets in row:
                key = frozenset(targets)
                if key not in seen:
                    closed = nfa.closed(key)
                    if closed not in number:
                        number[closed] = len(number)
                        todo.append(closed)
                    seen[key] = number[closed]
                ids.append(seen[key])
            table.append(ids)
        masks = [sum({accept[s] for s in states if s in accept}) for states in number]
        return np.array(table), np.array(masks)

    @staticmethod
    def _minimal(table: np.ndarray, masks: np.ndarray):
        """Split classes of states until the states of a class agree; class 0 holds the start."""
        group = np.unique(masks, return_inverse=True)[1]
        while True:
            seen = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
            if seen.max() == group.max():
                break
            group = seen
        first = np.array([np.flatnonzero(group == g)[0] for g in range(group.max() + 1)])
        # the start first, accepting states last
        order = sorted(range(len(first)), key=lambda g: (masks[first[g]] > 0, g != group[0]))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return rank[group[table[first[order]]]].astype(np.uint16), masks[first[order]]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all = Dfa([r.scan or r.pattern for r in rules], anchored=False)
        self.own = [Dfa([r.pattern], anchored=True) for r in rules]
        self.check = [re.compile(r.pattern.encode()) for r in rules]
        self.walk = [(d.step.tolist(), d.mask.tolist(), self._dead(d)) for d in self.own]
        self.reset = (self.all.step == 0).all(axis=0)
        if not self.reset.any():
            raise ValueError("no byte sends all states to the start")
        self.gap = int(np.flatnonzero(self.reset)[0])
        used, self.code = np.unique(self.all.step, axis=1, return_inverse=True)
        self.code = self.code.ravel().astype(np.uint8)
        self.flat = np.ascontiguousarray(used.astype(np.int32)).ravel()  # bytes that act alike share a column
        self.width = used.shape[1]
        self.flat = self.flat * self.width
        self.accepting = int(np.flatnonzero(self.all.mask > 0).min()) * self.width

    @staticmethod
    def _dead(d: Dfa) -> int:
        gone = (d.step == np.arange(len(d.step))[:, None]).all(axis=1) & (d.mask == 0)
        return int(np.flatnonzero(gone)[0]) if gone.any() else -1

    def hits(self, buffer: np.ndarray, lanes: int = 2048) -> list[tuple[int, int]]:
        """The one pass: (first, end) of each stretch between reset bytes in which a rule matched."""
        resets = np.flatnonzero(self.reset[buffer])
        want = np.arange(1, lanes) * len(buffer) // lanes
        cuts = resets[np.minimum(np.searchsorted(resets, want), len(resets) - 1)] + 1
        edges = np.unique(np.concatenate([[0], cuts, [len(buffer)]]))
        begin, size = edges[:-1], np.diff(edges)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        codes = self.code[buffer]
        state = np.zeros(len(begin), dtype=np.int32)
        running = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # lanes longer than j
        found = []
        for j, n in enumerate(running):
            now = state[:n]
            now += codes[begin[:n] + j]
            np.take(self.flat, now, out=now)
            if now.max() >= self.accepting:
                found.append(begin[np.flatnonzero(now >= self.accepting)] + j)
        if not found:
            return []
        part = np.unique(np.searchsorted(resets, np.concatenate(found)))
        return [(int(resets[p - 1]) + 1 if p else 0, int(resets[p]) if p < len(resets) else len(buffer)) for p in part]

    def spans(self, data: bytes, offset: int = 0) -> list[tuple[int, int, int]]:
        """(start, end, rule) in one stretch: leftmost, then longest, not overlapping within a rule."""
        out = []
        for k, (rule, (step, mask, dead)) in enumerate(zip(self.rules, self.walk)):
            at = 0
            while at < len(data):
                state, end = 0, -1
                for i in range(at, len(data)):
                    state = step[state][data[i]]
                    if state == dead:
                        break
                    if mask[state]:
                        end = i + 1
                if end < 0:
                    at += 1
                    continue
                m = self.check[k].fullmatch(data, at, end)
                if m and m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out.append((offset + at, offset + end, k))
                at = end
        return out

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Spans of each text, in bytes, by start and rule."""
        out: list[list] = [[] for _ in texts]
        buffer = np.frombuffer(bytes([self.gap]).join([*texts, b""]), dtype=np.uint8)
        if not len(buffer):
            return out
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        raw = buffer.tobytes()
        for a, b in self.hits(buffer):
            i = int(np.searchsorted(begins, a, "right")) - 1
            out[i] += self.spans(raw[a:b], a - int(begins[i]))
        return [sorted(spans, key=lambda s: (s[0], s[2])) for spans in out]


@functools.cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans:
        return spans
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    return [(int(lead[a]), int(lead[b]), k) for a, b, k in spans]


SPANS = "array<struct<start: int, end: int, rule: int>>"


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, batch_bytes: int = 8_000_000) -> DataFrame:
    """All columns of ``docs`` and ``spans``: array of (start, end, rule number), by start. A
    column of that name gives way."""
    docs = docs.drop("spans")
    column = docs.columns.index("text")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rule", pa.int32())]))

    def run(batches):
        scan = scanner(rules).scan
        for batch in batches:
            for part in slices(batch, batch_bytes, column):
                texts = [(t or "").encode() for t in part.column(column).to_pylist()]
                spans = [[dict(zip(("start", "end", "rule"), s)) for s in in_code_points(t, found)] for t, found in zip(texts, scan(texts))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind)], [*part.schema.names, "spans"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, spans {SPANS}")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = find(docs.select("doc_id", "text")).drop("text")
    kinds = F.array(*(F.lit(r.kind) for r in RULES))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.rule), s.start, s.end)), ",")

    def count(k: int):
        return F.size(F.filter("spans", lambda s: s.rule == k)).cast("long").alias(f"n_{BASE[k].kind}")

    base = F.filter("spans", lambda s: s.rule < len(BASE))
    return found.select("doc_id", *(count(k) for k in range(len(BASE))), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]", batch_bytes: int = 8_000_000) -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by a mark; n_chars follows."""
    text, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        scan = scanner(rules).scan
        for batch in batches:
            for part in slices(batch, batch_bytes, text):
                texts = part.column(text).to_pylist()
                raw = [(t or "").encode() for t in texts]
                clean = [redacted(t, in_code_points(r, found), mark) if found else t for t, r, found in zip(texts, raw, scan(raw))]
                columns = list(part.columns)
                columns[text] = pa.array(clean, pa.string())
                if chars is not None:
                    columns[chars] = pa.array([n if new is old else len(new) for n, new, old in zip(columns[chars].to_pylist(), clean, texts)], columns[chars].type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)
