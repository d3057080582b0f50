"""Secret scan with one combined automaton.

The detecting regexes of all rules become one deterministic automaton: parse, Thompson construction,
subset construction over byte classes, minimisation by partition refinement; the result is one transition
array. A batch of documents is one byte string cut into equal columns that advance in step, so each byte is read
once for all rules. Columns start in the initial state; where the column before ends in another
state the column is read again from there, until all agree: the states are those of one sequential pass.

Where the automaton accepts for a rule, an automaton of the reversed detecting regex walks back to the leftmost start, and one of the rule's whole
regex walks on from there to the last accepting place. Both are built like the combined one and stop in their dead state, so only
bytes around a hit are read again. Python's regexes are not used. Spans are in code points.

Defined results: null or empty text has no spans; rows that repeat keep a row each; an empty table gives no rows; other
columns are carried only where asked for.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

COLUMNS = 8192
_KEYS = r"(password|passwd|secret|token|api_?key)"


@dataclass(frozen=True)
class Rule:
    """detect: the least that every span begins with (any case if folded); full: the spans. need: least length, counted from the last character of detect if from_last, else from the start."""

    name: str
    detect: str
    full: str
    need: int = 1
    folded: bool = False
    from_last: bool = False


#: Formats of secrets. The first three are base kinds.
RULES = (
    Rule("assign", _KEYS + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""", _KEYS + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 12, True, True),
    Rule("access", r"AKIA[A-Z0-9]{4}", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16}", r"[0-9a-f]+", 16),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x0A\x0D]*(-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("live_key", r"[rs]k_live_[A-Za-z0-9]", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]", r"AIza[A-Za-z0-9_-]{35}"),
)
BASE = ("assign", "access", "hex")


class _Parser:
    """A regex of literals, escapes, classes, groups, |, ?, *, + and {m}, {m,}, {m,n} to an epsilon automaton over bytes, or to that of its reversed texts."""

    def __init__(self, reverse: bool = False) -> None:
        self.reverse = reverse
        self.eps: list[list[int]] = []
        self.arcs: list[list[tuple[frozenset[int], int]]] = []

    def node(self) -> int:
        self.eps.append([])
        self.arcs.append([])
        return len(self.eps) - 1

    def add(self, regex: str, folded: bool) -> tuple[int, int]:
        self.text, self.at, self.folded = regex, 0, folded
        tree = self._either()
        if self.at < len(regex):
            raise ValueError(f"cannot read {regex!r} at {self.at}")
        return self._build(tree)

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def _either(self) -> tuple:
        parts = [self._row()]
        while self._peek() == "|":
            self._take()
            parts.append(self._row())
        return ("or", parts)

    def _row(self) -> tuple:
        parts = []
        while self._peek() not in ("", "|", ")"):
            atom = self._atom()
            while self._peek() and self._peek() in "?*+{":
                atom = ("rep", atom, *self._times())
            parts.append(atom)
        return ("and", parts)

    def _times(self) -> tuple[int, int | None]:
        c = self._take()
        if c != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        body, self.at = self.text[self.at : self.text.index("}", self.at)], self.text.index("}", self.at) + 1
        low, comma, high = body.partition(",")
        return int(low), int(high) if high else (None if comma else int(low))

    def _escape(self) -> int:
        c = self._take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def _atom(self) -> tuple:
        c = self._take()
        if c == "(":
            inner = self._either()
            self._take()
            return inner
        if c == "[":
            return ("set", self._fold(self._class()))
        return ("set", self._fold({self._escape() if c == "\\" else ord(c)}))

    def _class(self) -> set[int]:
        out: set[int] = set()
        while self._peek() != "]":
            c = self._take()
            low = self._escape() if c == "\\" else ord(c)
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self._take()
                c = self._take()
                out.update(range(low, (self._escape() if c == "\\" else ord(c)) + 1))
            else:
                out.add(low)
        self._take()
        return out

    def _fold(self, found: set[int]) -> frozenset[int]:
        if self.folded:
            found = found | {ord(chr(x).swapcase()) for x in found if chr(x).isascii() and chr(x).isalpha()}
        return frozenset(found)

    def _build(self, tree: tuple) -> tuple[int, int]:
        kind = tree[0]
        first, last = self.node(), self.node()
        if kind == "set":
            self.arcs[first].append((tree[1], last))
        elif kind == "or":
            for part in tree[1]:
                a, b = self._build(part)
                self.eps[first].append(a)
                self.eps[b].append(last)
        elif kind == "and":
            at = first
            for part in tree[1][::-1] if self.reverse else tree[1]:
                a, b = self._build(part)
                self.eps[at].append(a)
                at = b
            self.eps[at].append(last)
        else:
            _, part, low, high = tree
            at = first
            for _ in range(low):
                a, b = self._build(part)
                self.eps[at].append(a)
                at = b
            if high is None:
                a, b = self._build(part)
                self.eps[at] += [a, last]
                self.eps[b] += [a, last]
            else:
                for _ in range(high - low):
                    a, b = self._build(part)
                    self.eps[at] += [a, last]
                    at = b
                self.eps[at].append(last)
        return first, last


@dataclass(frozen=True)
class Automaton:
    """step[state * n_classes + class] is the next state times n_classes; states from `accepting` on accept the rules in `accepts`."""

    classes: np.ndarray
    n_classes: int
    step: np.ndarray
    start: int
    accepting: int
    accepts: np.ndarray


def _minimal(step: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coarsest partition of the states that keeps labels and steps: block of each state."""
    block = np.unique(labels, return_inverse=True)[1]
    while True:
        signs = np.concatenate([block[:, None], block[step]], axis=1)
        finer = np.unique(signs, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            return block, step
        block = finer


def _automaton(nfa: _Parser, root: int, finals: dict[int, int], anchored: bool) -> Automaton:
    """Subset construction over byte classes and minimisation. anchored: matches begin at the first byte only; else at any."""
    marks = np.zeros(256, dtype=np.int64)
    sets = sorted({s for arcs in nfa.arcs for s, _ in arcs}, key=sorted)
    for s in sets:
        marks = np.unique(marks * 2 + np.isin(np.arange(256), sorted(s)), return_inverse=True)[1]
    classes, n = marks.astype(np.int32), int(marks.max()) + 1
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(n)]
    closed: dict[int, frozenset[int]] = {}

    def closure(node: int) -> frozenset[int]:
        if node not in closed:
            seen, todo = {node}, [node]
            while todo:
                for m in nfa.eps[todo.pop()]:
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            closed[node] = frozenset(x for x in seen if nfa.arcs[x] or x in finals)
        return closed[node]

    targets = {x: [[closure(t) for s, t in arcs if b in s] for b in sample] for x, arcs in enumerate(nfa.arcs) if arcs}
    begin = closure(root)
    always = frozenset() if anchored else begin
    states, table, todo = {begin: 0}, [], [begin]
    for state in todo:
        row = []
        for c in range(n):
            to = frozenset(always.union(*(t for x in state if x in targets for t in targets[x][c])))
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            row.append(states[to])
        table.append(row)
    step = np.array(table)
    labels = np.array([sum(finals.get(x, 0) for x in s) for s in todo])
    block, _ = _minimal(step, labels)
    n_blocks = int(block.max()) + 1
    first = np.array([int(np.flatnonzero(block == b)[0]) for b in range(n_blocks)])
    order = np.argsort(labels[first] > 0, kind="stable")  # accepting states last
    rank = np.empty(n_blocks, dtype=np.int64)
    rank[order] = np.arange(n_blocks)
    small = rank[block[step[first[order]]]]
    plain = int((labels[first] == 0).sum())
    return Automaton(classes.astype(np.int32), n, (small * n).astype(np.int32).ravel(), int(rank[block[0]]) * n, plain * n, labels[first[order]])


@functools.lru_cache(maxsize=4)
def compile_rules(rules: tuple[Rule, ...] = RULES) -> Automaton:
    """The detecting regexes of all rules, from any byte on."""
    nfa = _Parser()
    root = nfa.node()
    finals: dict[int, int] = {}
    for i, r in enumerate(rules):
        a, b = nfa.add(r.detect, r.folded)
        nfa.eps[root].append(a)
        finals[b] = 1 << i
    return _automaton(nfa, root, finals, False)


class Walk:
    """One regex from a fixed place: byte -> next state as plain lists, for the few bytes around a hit. State -1 is dead."""

    def __init__(self, regex: str, folded: bool, reverse: bool) -> None:
        nfa = _Parser(reverse)
        root, last = nfa.add(regex, folded)
        auto = _automaton(nfa, root, {last: 1}, True)
        n = auto.n_classes
        count = len(auto.step) // n
        dead = [s * n < auto.accepting and bool((auto.step[s * n : s * n + n] == s * n).all()) for s in range(count)]
        self.next = [[-1 if dead[t := int(auto.step[s * n + int(auto.classes[b])]) // n] else t for b in range(256)] for s in range(count)]
        self.start, self.accepting = auto.start // n, auto.accepting // n

    def last(self, data: bytes, begin: int, end: int, by: int) -> int:
        """How many bytes from begin on (towards end, by 1 or -1) the longest match takes; -1 without one."""
        state, taken, best = self.start, 0, -1
        for at in range(begin, end, by):
            state = self.next[state][data[at]]
            if state < 0:
                break
            taken += 1
            if state >= self.accepting:
                best = taken
        return best


@functools.lru_cache(maxsize=4)
def _walks(rules: tuple[Rule, ...]) -> tuple[tuple[Walk, Walk], ...]:
    """(backwards over detect, onwards over full) of each rule."""
    return tuple((Walk(r.detect, r.folded, True), Walk(r.full, r.folded, False)) for r in rules)


def _advance(auto: Automaton, grid: np.ndarray, state: np.ndarray, columns: np.ndarray, hits: list) -> np.ndarray:
    """Runs the columns of grid (byte classes, one row for each step) from their states; notes (column, row, rules) where rules come up."""
    rows = grid[:, columns] if len(columns) < grid.shape[1] else grid
    state = state.astype(np.int32)
    at = np.empty_like(state)
    for t in range(rows.shape[0]):
        np.add(state, rows[t], out=at)
        np.take(auto.step, at, out=state, mode="clip")
        if state.max(initial=0) >= auto.accepting:
            found = np.flatnonzero(state >= auto.accepting)
            hits.append((columns[found], np.full(len(found), t), auto.accepts[state[found] // auto.n_classes]))
    return state


def scan_bytes(data: bytes, auto: Automaton, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """(ends, rules): offsets of bytes after which rules (bits) are accepted, as one sequential pass would find them."""
    if not data:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    size = max(256, -(-len(data) // columns))
    n = -(-len(data) // size)
    buffer = np.zeros(n * size, dtype=np.uint8)
    buffer[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    grid = np.ascontiguousarray(auto.classes[buffer].reshape(n, size).T)
    begun = np.full(n, auto.start, dtype=np.int32)
    every = np.arange(n)
    hits: list = []
    ended = _advance(auto, grid, begun, every, hits)
    while True:
        true = np.concatenate([[auto.start], ended[:-1]]).astype(np.int32)
        wrong = np.flatnonzero(true != begun)
        if not len(wrong):
            break
        bad = np.zeros(n, dtype=bool)
        bad[wrong] = True
        hits = [(c[k], r[k], m[k]) for c, r, m in hits if (k := ~bad[c]).any()]
        ended[wrong] = _advance(auto, grid, true[wrong], wrong, hits)
        begun = true
    if not hits:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ends = np.concatenate([c * size + r for c, r, _ in hits])
    rules = np.concatenate([m for _, _, m in hits])
    inside = ends < len(data)
    return ends[inside], rules[inside]


def _located(data: bytes, hits: list[tuple[int, int]], rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """Spans in one text's bytes from its hits (last byte of detect, rules): leftmost, not overlapping within a rule; by start, then the rules' order."""
    found: list[tuple[int, int, int]] = []
    walks, free = _walks(rules), [0] * len(rules)
    for end, bits in hits:
        for i in range(len(rules)):
            if bits >> i & 1 and end >= free[i]:
                back, on = walks[i]
                size = back.last(data, end, free[i] - 1, -1)
                if size < 0:
                    continue  # it would have to begin inside the match before
                start = end + 1 - size
                whole = on.last(data, start, len(data), 1)
                if whole < 0:
                    continue
                free[i] = start + whole
                if start + whole - (end if rules[i].from_last else start) >= rules[i].need:
                    found.append((start, i, start + whole))
    if not found:
        return []
    found.sort()
    points = np.concatenate([[0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)])
    return [(rules[i].name, int(points[s]), int(points[e])) for s, i, e in found]


def scan_texts(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """The spans of each text. A line feed lies between texts; no detecting regex goes across it, and the walks end with the text."""
    coded = [(t or "").encode("utf-8", "replace") for t in texts]
    starts = np.cumsum([0] + [len(c) + 1 for c in coded])
    ends, bits = scan_bytes(b"\n".join(coded), compile_rules(rules))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if len(ends):
        order = np.argsort(ends, kind="stable")
        ends, bits = ends[order], bits[order]
        owner = np.searchsorted(starts, ends, side="right") - 1
        cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            i = int(owner[a])
            out[i] = _located(coded[i], list(zip((ends[a:b] - starts[i]).tolist(), bits[a:b].tolist(), strict=True)), rules)
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns in keep and spans array<struct<kind, start, end>> for each row of docs."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("spans", SPAN)])
    text_at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                spans = scan_texts(part.column(text_at).to_pylist(), rules)
                column = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], type=_ARROW_SPAN)
                yield pa.RecordBatch.from_arrays([*part.columns[:text_at], column], names=[*keep, "spans"])

    return docs.select(*keep, docs["text"].alias("_scanned")).mapInArrow(run, schema)


def redact(docs: DataFrame, mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every span replaced by mask (overlapping spans by one); n_chars follows where there is one."""
    names = docs.columns
    text_at, size_at = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def cut(text: str, spans: list[tuple[str, int, int]]) -> str:
        out, at = [], 0
        for _, start, end in spans:
            if start >= at:
                out += [text[at:start], mask]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(text_at).to_pylist()
                found = scan_texts(texts, rules)
                columns = list(part.columns)
                if any(found):
                    new = [cut(t, s) if s else t for t, s in zip(texts, found, strict=True)]
                    columns[text_at] = pa.array(new, type=columns[text_at].type)
                    if size_at >= 0:
                        old = columns[size_at].to_pylist()
                        columns[size_at] = pa.array([len(t) if s else n for t, s, n in zip(new, found, old, strict=True)], type=columns[size_at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
