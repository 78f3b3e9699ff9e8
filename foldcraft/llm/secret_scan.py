"""Secret scan with one deterministic automaton for all rules.

Rules are regular expressions over bytes.  They are compiled together: a
position automaton (Glushkov) of each rule, a common subset construction that
also restarts the rules at every byte, and minimisation by partition
refinement give one transition array of 256 entries per state, and a scan
reads every byte of a text once for all rules.

Leftmost, non-overlapping matches.  A rule here ends in an open run (a
repeated class, "its tail"): once a match of the rule has reached its tail it
only can go on there, and threads of the same rule that started later are cut
off until the run ends.  So in the scan a rule's match begins to be accepted at
the first byte of the tail and ends where acceptance ends, and matches of one
rule never overlap.  The start is found from the first accepted byte by a
second automaton, of the reversed head of the rule, run backwards.  Minimum
lengths are checked on the finished match; it is dropped if too short, but has
consumed its text, as with a regular expression engine.

Spans are reported in code points.  Base kinds are assign, access and hex; the
automaton adds github, slack and pem.

Distribution.  A scan touches its row alone: no shuffle, and the compiled
arrays (about two thousand states, 1 MB) travel with the task.

Defined results: null and empty texts have no spans; a text may be of any
length, a scan holds its bytes and spans; rules that match at one place give
a span each, ordered by start and then by rule; repeated rows get equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, text_of


@dataclass(frozen=True)
class Rule:
    """head is the expression up to the tail, a class; the match goes on while
    bytes are in it.  At least min_tail bytes of tail are asked for.  Where a
    match too short cannot hide another, the least length is better written
    into the head: the automaton then counts."""

    kind: str
    head: str
    tail: str
    min_tail: int = 1


#: fixed values: the rules of the base kinds, then the added ones
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
                   r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?""",
         "[A-Za-z0-9+/_.=-]", min_tail=12),
    Rule("access", "AKIA" + 13 * "[A-Z0-9]", "[A-Z0-9]"),  # 18 and more
    Rule("hex", 15 * "[0-9a-f]", "[0-9a-f]"),              # 16 and more
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", min_tail=36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", min_tail=10),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY----", "[-]"),
)
BASE = ("assign", "access", "hex")


# expressions ---------------------------------------------------------------

class _Positions:
    """Position automaton of an expression: literals, [classes], groups,
    |, ?, * and +."""

    def __init__(self, expression: str):
        self.text, self.i = expression, 0
        self.sets: list[frozenset[int]] = []
        self.follow: list[set[int]] = []
        self.nullable, self.first, self.last = self._either()

    def _peek(self) -> str:
        return self.text[self.i:self.i + 1]

    def _take(self) -> str:
        self.i += 1
        return self.text[self.i - 1]

    def _either(self):
        null, first, last = self._sequence()
        while self._peek() == "|":
            self._take()
            n, f, z = self._sequence()
            null, first, last = null or n, first | f, last | z
        return null, first, last

    def _sequence(self):
        null, first, last = True, set(), set()
        while self._peek() not in ("", "|", ")"):
            n, f, z = self._repeated()
            for p in last:
                self.follow[p] |= f
            first = first | f if null else first
            last = last | z if n else z
            null = null and n
        return null, first, last

    def _repeated(self):
        null, first, last = self._atom()
        while self._peek() in ("?", "*", "+") and self._peek():
            op = self._take()
            if op in "*+":
                for p in last:
                    self.follow[p] |= first
            null = null or op in "?*"
        return null, first, last

    def _atom(self):
        c = self._take()
        if c == "(":
            out = self._either()
            self._take()
            return out
        chars = self._class() if c == "[" else frozenset((ord(c),))
        self.sets.append(chars)
        self.follow.append(set())
        at = {len(self.sets) - 1}
        return False, at, set(at)

    def _class(self) -> frozenset[int]:
        body = self.text[self.i:self.text.index("]", self.i)]
        self.i += len(body) + 1
        out, k = set(), 0
        while k < len(body):
            if body[k + 1:k + 2] == "-" and k + 2 < len(body):
                out |= set(range(ord(body[k]), ord(body[k + 2]) + 1))
                k += 3
            else:
                out.add(ord(body[k]))
                k += 1
        return frozenset(out)


@dataclass(frozen=True)
class Automaton:
    """State 0 is the start; step[state, byte] is the next state, marks[state]
    has bit r set if rule r accepts there."""

    step: np.ndarray
    marks: list[int]


def _minimise(table: np.ndarray, marks: list[int]) -> tuple[np.ndarray, list[int]]:
    """Merges states that no input tells apart, by refining the partition."""
    weights = np.random.default_rng(1).integers(1, 1 << 63, table.shape[1] + 1, dtype=np.uint64)
    block = np.unique(marks, return_inverse=True)[1].ravel()
    while True:  # states stay together while their blocks and successors' blocks agree (by hash)
        signature = (block[table].astype(np.uint64) * weights[1:]).sum(1) + block.astype(np.uint64) * weights[0]
        first, fresh = np.unique(signature, return_index=True, return_inverse=True)[1:]
        if len(first) == block.max() + 1:
            break
        block = fresh.ravel()
    # the start state's block first, the others as they were found
    pick = [0] + sorted(int(f) for f in first if block[f] != block[0])
    order = np.empty(len(first), np.int64)
    order[block[pick]] = np.arange(len(pick))
    return order[block[table[pick]]], [marks[p] for p in pick]


def _determinise(start, next_of, mark_of, sets: list[frozenset[int]]) -> Automaton:
    """Subset construction from a start set; next_of(set, byte) -> set.  Bytes
    that are in the same of the expressions' sets behave alike."""
    alike: dict[tuple, int] = {}
    column = [alike.setdefault(tuple(b in s for s in set(sets)), len(alike)) for b in range(256)]
    bytes_of = [column.index(c) for c in range(len(alike))]
    number, todo, table = {start: 0}, [start], []
    while len(table) < len(todo):
        row = []
        for byte in bytes_of:
            to = next_of(todo[len(table)], byte)
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            row.append(number[to])
        table.append(row)
    table, marks = _minimise(np.array(table), [mark_of(x) for x in todo])
    return Automaton(table[:, column].astype(np.int16 if len(marks) < 1 << 15 else np.int32), marks)


def compile_rules(rules: tuple[Rule, ...]) -> Automaton:
    """One automaton for all rules, restarted at every byte."""
    parts = []
    for rule in rules:
        p = _Positions(f"{rule.head}{rule.tail}")
        parts.append((p, len(p.sets) - 1))  # the last position is the tail

    @lru_cache(None)
    def one(r: int, mine: frozenset[int], byte: int) -> frozenset[int]:
        """Where rule r's threads go."""
        p, tail = parts[r]
        # in the tail of a match a rule does not start anew
        threads = {tail} if tail in mine else p.first.union(*(p.follow[q] for q in mine))
        to = {q for q in threads if byte in p.sets[q]}
        if tail in mine and not to:  # the match has ended before this byte
            to = {q for q in p.first if byte in p.sets[q]}
        return frozenset({tail} if tail in to else to)

    def next_of(state, byte):
        return tuple(one(r, mine, byte) for r, mine in enumerate(state))

    def mark_of(state):
        return sum(1 << r for r, (_, tail) in enumerate(parts) if tail in state[r])

    start = tuple(frozenset() for _ in parts)
    return _determinise(start, next_of, mark_of, [x for p, _ in parts for x in p.sets])


def _reversed(expression: str) -> Automaton:
    """Automaton of the reversed expression, started once; mark 1 accepts."""
    p = _Positions(expression)
    before: list[set[int]] = [{a for a in range(len(p.sets)) if b in p.follow[a]} for b in range(len(p.sets))]

    def next_of(state, byte):
        _, at = state
        ahead = p.last if at is None else set().union(*(before[q] for q in at))
        return False, frozenset(q for q in ahead if byte in p.sets[q])

    def mark_of(state):
        begun, at = state
        return int(p.nullable) if at is None else int(bool(at & p.first)) if at else -1

    return _determinise((True, None), next_of, mark_of, p.sets)


class Scanner:
    """The compiled rules; plain arrays, so that it can be shipped."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.both = compile_rules(rules)
        self.heads = [_reversed(r.head) for r in rules]
        self._rows = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None}

    @property
    def rows(self) -> list:
        """A list per state: the next state's list for each byte, then the
        state's marks."""
        if self._rows is None:
            self._rows = [[] for _ in self.both.marks]
            for row, to, mark in zip(self._rows, self.both.step.tolist(), self.both.marks):
                row.extend([self._rows[t] for t in to])
                row.append(mark)
        return self._rows

    def _start(self, rule: int, data: bytes, at: int, floor: int) -> int:
        """The leftmost start, at or after floor, of a head that ends at at."""
        head = self.heads[rule]
        state, start, i = 0, at, at
        while (mark := head.marks[state]) >= 0:
            if mark:
                start = i
            if i == floor:
                break
            i -= 1
            state = head.step[state, data[i]]
        return start

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of every match, in bytes, ordered."""
        out: list[tuple[int, int, int]] = []
        begun: dict[int, int] = {}  # of rules in their tail: its first byte
        floor = [0] * len(self.rules)

        def change(mark: int, i: int) -> None:
            for r, rule in enumerate(self.rules):
                if r in begun and not mark >> r & 1:
                    at = begun.pop(r)
                    start, floor[r] = self._start(r, data, at, floor[r]), i
                    if i - at >= rule.min_tail:
                        out.append((start, r, i))
                elif r not in begun and mark >> r & 1:
                    begun[r] = i

        row, live = self.rows[0], 0
        for i, byte in enumerate(data):
            row = row[byte]
            if row[256] != live:
                live = row[256]
                change(live, i)
        change(0, len(data))
        return sorted(out)

    def spans(self, text: str) -> list[dict]:
        """Spans of a text, in code points."""
        data = text.encode()
        found = self.scan(data)
        if found and not data.isascii():
            place = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))).tolist()
            found = [(place[a], r, place[b]) for a, r, b in found]
        return [{"kind": self.rules[r].kind, "start": a, "end": b} for a, r, b in found]


@lru_cache(4)
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of rows (doc_id, text); spans is an array of (kind,
    start, end), ordered by start and then as the rules are."""
    shipped = docs.sparkSession.sparkContext.broadcast(compiled(rules))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(F.col("text")).alias("text"))

    def run(batches):
        scanner = shipped.value
        for b in batches:
            spans = [scanner.spans(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, SPANS)], names=["doc_id", "spans"])

    return d.mapInArrow(run, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>")


def op4_secret_scan(spark, sf_dir):
    """op4: counts of the base kinds, digest of their spans, all spans."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    d = find_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return d.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
