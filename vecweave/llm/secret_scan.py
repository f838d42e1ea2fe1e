"""Secret scans: all rules as one deterministic automaton, run once over the bytes of a text.

Each rule is a regular expression over ASCII. It is parsed, compiled to an automaton by subset
construction over *ordered* sets (an earlier start goes before a later one, a longer loop before
its exit, and what comes after a finished match is cut), which gives leftmost, non-overlapping
matches, and minimised. The product of the rules' automata, minimised again, is one transition
array over classes of bytes; its state after a byte tells which rules have a match that ends
there. A match's start is found from its end by the rule's reversed automaton.

Texts are cut into lanes that advance side by side, a byte a step. A lane inside a text first
assumes that nothing is pending where it begins; where the lane before ends in another state, it
is run again from there until both runs agree, so the outcome is that of one pass from the start,
for lanes of any content. Memory follows a slice of texts (or the longest text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecweave.llm.arrays import LEAD, text_slices

LANE = 512
# Matches longer than this are followed a run at a time instead of a byte at a time.
LONG_MATCH = 2048
RUN_BYTES = 1 << 16
# States of the product before it is minimised; a set of rules beyond that belongs in two scans.
MAX_STATES = 60_000


@dataclass(frozen=True)
class Rule:
    """``head`` then ``tail``, as patterns; matches whose tail is under ``least`` characters are dropped.

    They are dropped after matching: the text they cover is not searched again.
    """

    kind: str
    head: str
    tail: str = ""
    least: int = 0

    @property
    def pattern(self) -> str:
        return self.head + self.tail


def either(word: str) -> str:
    """The letters of a word in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + f"|{either('api')}_?{either('key')}"
# Fixed values of the contract, in its order.
BASE_RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 12),
    Rule("access", "AKIA", "[A-Z0-9]+", 14),
    Rule("hex", "", "[0-9a-f]+", 16),
)
# Forms of keys as their issuers publish them.
RULES = BASE_RULES + (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", 36),
    Rule("slack", "xox[abeprs]-", "[A-Za-z0-9-]+", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", 35),
    Rule("stripe", "[rs]k_(live|test)_", "[A-Za-z0-9]+", 16),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]+", 10),
    Rule("bearer", rf"{either('bearer')}\x20+", "[A-Za-z0-9._~+/=-]+", 20),
    Rule("private-key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
    Rule("login", "://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!-]+@", "[A-Za-z0-9.-]+", 1),
)


def parse(pattern: str):
    """A tree of ``("set", bytes)``, ``("cat", parts)``, ``("or", parts)``, ``("?"|"*"|"+", part)``."""
    at = 0

    def escaped() -> int:
        nonlocal at
        at += 1
        if pattern[at] == "x":
            at += 3
            return int(pattern[at - 2 : at], 16)
        at += 1
        return ord(pattern[at - 1])

    def one() -> int:
        nonlocal at
        if pattern[at] == "\\":
            return escaped()
        at += 1
        return ord(pattern[at - 1])

    def charset():
        nonlocal at
        at += 1
        if pattern[at] == "^":
            raise ValueError("negated sets are not supported: rules name the bytes they take")
        found = set()
        while pattern[at] != "]":
            low = one()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                found.update(range(low, one() + 1))
            else:
                found.add(low)
        at += 1
        return ("set", frozenset(found))

    def atom():
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inside = alternatives()
            if at >= len(pattern) or pattern[at] != ")":
                raise ValueError(f"no closing parenthesis in {pattern!r}")
            at += 1
            return inside
        if pattern[at] == "[":
            return charset()
        if pattern[at] in "?*+{}.^$":
            raise ValueError(f"{pattern[at]!r} is not supported at {at} in {pattern!r}")
        return ("set", frozenset([one()]))

    def sequence():
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            part = atom()
            while at < len(pattern) and pattern[at] in "?*+":
                part = (pattern[at], part)
                at += 1
            parts.append(part)
        return ("cat", parts)

    def alternatives():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    tree = alternatives()
    if at < len(pattern):
        raise ValueError(f"unexpected {pattern[at]!r} in {pattern!r}")
    return tree


def backward(tree):
    """The tree of the reversed strings."""
    kind, inside = tree
    if kind == "set":
        return tree
    if kind == "cat":
        return (kind, [backward(p) for p in reversed(inside)])
    return (kind, [backward(p) for p in inside]) if kind == "or" else (kind, backward(inside))


MATCH = -1


class Program:
    """A tree as numbered steps; ``reach`` follows the choices from a step, preferred ones first."""

    def __init__(self, tree):
        self.sets: dict[int, frozenset[int]] = {}
        self.after: dict[int, int] = {}
        self.choices: dict[int, tuple[int, ...]] = {}
        self.count = 0
        self.start = self._add(tree, MATCH)

    def _new(self) -> int:
        self.count += 1
        return self.count - 1

    def _add(self, tree, then: int) -> int:
        kind, inside = tree
        if kind == "cat":
            for part in reversed(inside):
                then = self._add(part, then)
            return then
        step = self._new()
        if kind == "set":
            self.sets[step], self.after[step] = inside, then
        elif kind == "or":
            self.choices[step] = tuple(self._add(p, then) for p in inside)
        elif kind == "?":
            self.choices[step] = (self._add(inside, then), then)
        else:
            body = self._add(inside, step)
            self.choices[step] = (body, then)
            return body if kind == "+" else step
        return step

    def reach(self, steps: Sequence[int]) -> tuple[int, ...]:
        """The sets (and the match) that are next, in order of preference."""
        found: dict[int, None] = {}
        seen, todo = set(), list(reversed(steps))
        while todo:
            step = todo.pop()
            if step in seen:
                continue
            seen.add(step)
            if step == MATCH or step in self.sets:
                found[step] = None
            else:
                todo.extend(reversed(self.choices[step]))
        return tuple(found)


@dataclass
class Automaton:
    """``table[state, class of byte]`` is the next state, ``accepts[state]`` a bit per rule."""

    table: np.ndarray
    accepts: np.ndarray

    def minimised(self) -> Automaton:
        """States that no continuation tells apart become one; the first state stays the first."""
        group = np.unique(self.accepts, return_inverse=True)[1].ravel()
        count = int(group.max()) + 1
        while True:
            rows = np.column_stack([group, group[self.table]])
            _, finer = np.unique(rows, axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() + 1 == count:
                break
            group, count = finer, int(finer.max()) + 1
        # Number groups by their first state.
        _, first = np.unique(group, return_index=True)
        order = np.argsort(first)
        rank = np.empty(count, np.int64)
        rank[order] = np.arange(count)
        chosen = first[order]
        return Automaton(rank[group[self.table[chosen]]].astype(np.int32), self.accepts[chosen])


def byte_classes(rules: Sequence[Rule]) -> tuple[np.ndarray, list[int]]:
    """The class of each byte, and one byte of each class: bytes in a class are in the same sets."""
    sets = sorted({s for r in rules for s in Program(parse(r.pattern)).sets.values()}, key=sorted)
    names = [tuple(b in s for s in sets) for b in range(256)]
    distinct = {n: i for i, n in enumerate(dict.fromkeys(names))}
    examples = [names.index(n) for n in distinct]
    return np.array([distinct[n] for n in names], np.uint8), examples


def _subsets(first, following, examples: list[int]) -> tuple[np.ndarray, list]:
    """All states that are reached from ``first``, and their transitions."""
    number, states, rows = {first: 0}, [first], []
    for state in states:
        row = []
        for byte in examples:
            then = following(state, byte)
            if then not in number:
                number[then] = len(states)
                states.append(then)
            row.append(number[then])
        rows.append(row)
    return np.array(rows, np.int32), states


def searching(rule: Rule, examples: list[int]) -> Automaton:
    """Leftmost non-overlapping matches anywhere: accepts where a match ends, or could yet grow.

    Raises for rules of which a match, once complete, could go on and fail, or could be of one
    byte right behind another: their matches could not be told from the states alone.
    """
    program = Program(parse(rule.pattern))
    fresh = program.reach([program.start])
    if MATCH in fresh:
        raise ValueError(f"{rule.kind}: matches the empty text")

    def step(state: tuple[int, ...], byte: int) -> tuple[int, ...]:
        found = program.reach([program.after[s] for s in state if s != MATCH and byte in program.sets[s]])
        # What starts later than a complete match is cut.
        return found[: found.index(MATCH) + 1] if MATCH in found else found

    def following(state: tuple[int, ...], byte: int) -> tuple[int, ...]:
        found = step(state, byte)
        if MATCH in state:
            if found and MATCH not in found:
                raise ValueError(f"{rule.kind}: a complete match may go on and fail")
            if not found:
                found = step(fresh, byte)
                if MATCH in found:
                    raise ValueError(f"{rule.kind}: two matches may touch within one byte")
        return found if MATCH in found else tuple(dict.fromkeys(found + fresh))

    table, states = _subsets(fresh, following, examples)
    return Automaton(table, np.array([MATCH in s for s in states], np.int64)).minimised()


def anchored(tree, examples: list[int]) -> Automaton:
    """All strings of the tree from one place on; the state without continuation is the last."""
    program = Program(tree)

    def following(state: tuple[int, ...], byte: int) -> tuple[int, ...]:
        return tuple(sorted(program.reach([program.after[s] for s in state if s != MATCH and byte in program.sets[s]])))

    table, states = _subsets(tuple(sorted(program.reach([program.start]))), following, examples)
    small = Automaton(table, np.array([MATCH in s for s in states], np.int64)).minimised()
    n = len(small.table)
    dead = np.flatnonzero((small.table == np.arange(n)[:, None]).all(axis=1) & (small.accepts == 0))
    to = np.where(np.isin(np.arange(n), dead), -1, np.arange(n))
    return Automaton(to[small.table].astype(np.int32), small.accepts)


def product(parts: Sequence[Automaton]) -> Automaton:
    """All automata at once: a state is a state of each, an accept has the bit of each that accepts."""
    sizes = [len(p.table) for p in parts]
    if np.prod([float(s) for s in sizes]) >= 2.0**62:
        raise ValueError("too many rules for one automaton")
    known, frontier, rows = {0: 0}, np.zeros(1, np.int64), []
    codes = [0]
    while len(frontier):
        rest, following, scale = frontier, 0, 1
        for part, size in zip(parts, sizes):
            following = following + part.table[rest % size].astype(np.int64) * scale
            rest, scale = rest // size, scale * size
        new = []
        for row in following.tolist():
            for code in row:
                if code not in known:
                    known[code] = len(codes)
                    codes.append(code)
                    new.append(code)
            rows.append([known[c] for c in row])
        if len(codes) > MAX_STATES:
            raise ValueError(f"the rules need over {MAX_STATES} states together")
        frontier = np.array(new, np.int64)
    rest, accepts = np.array(codes, np.int64), np.zeros(len(codes), np.int64)
    for i, (part, size) in enumerate(zip(parts, sizes)):
        accepts |= part.accepts[rest % size] << i
        rest = rest // size
    return Automaton(np.array(rows, np.int32), accepts).minimised()


class Scanner:
    """Rules compiled to arrays; ``matches`` finds all spans in a slice of texts."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = tuple(rules)
        self.classes, examples = byte_classes(rules)
        self.width = len(examples)
        found = [searching(r, examples) for r in rules]
        self.automaton = product(found)
        self.flat = self.automaton.table.ravel()
        self.back = [anchored(backward(parse(r.pattern)), examples) for r in rules]
        self.heads = [anchored(parse(r.head), examples) if r.tail else None for r in rules]

    def states(self, symbols: np.ndarray, offsets: np.ndarray, lane: int = LANE) -> np.ndarray:
        """The state after each byte."""
        out = np.zeros(len(symbols), np.int32)
        sizes = np.diff(offsets)
        lanes = -(-sizes // lane)
        text = np.repeat(np.arange(len(sizes)), lanes)
        place = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        starts = offsets[text] + place * lane
        ends = np.minimum(starts + lane, offsets[text + 1])
        begun = np.zeros(len(starts), np.int32)
        self._advance(symbols, starts, ends, begun, out, None)
        later = np.flatnonzero(place > 0)
        while len(later):
            due = out[starts[later] - 1]
            wrong = due != begun[later]
            if not wrong.any():
                break
            again = later[wrong]
            begun[again] = due[wrong]
            self._advance(symbols, starts[again], ends[again], begun[again], out, out)
        return out

    def _advance(self, symbols, starts, ends, first, out, before) -> None:
        """Runs lanes side by side; with ``before``, each until it is in the state it was in there."""
        order = np.argsort(starts - ends, kind="stable")
        at, end, state = starts[order], ends[order], first[order]
        while True:
            # Lanes are in order of their length, so those that are done are the last.
            going = int(np.searchsorted(at - end, 0, "left"))
            at, end, state = at[:going], end[:going], state[:going]
            if not going:
                return
            state = self.flat[state * self.width + symbols[at]]
            if before is None:
                out[at] = state
                at = at + 1
                continue
            differ = before[at] != state
            at, end, state = at[differ], end[differ], state[differ]
            out[at] = state
            at = at + 1

    def furthest(self, automaton: Automaton, symbols: np.ndarray, places: np.ndarray, stops: np.ndarray, step: int) -> np.ndarray:
        """How many bytes the longest accepted string has, from each place towards its stop."""
        best = np.where(automaton.accepts[0] == 1, 0, -1) + np.zeros(len(places), np.int64)
        lane, state, gone = np.arange(len(places)), np.zeros(len(places), np.int32), 0
        flat, accepts = automaton.table.ravel(), automaton.accepts
        while len(lane):
            if gone == LONG_MATCH:
                for one, now in zip(lane.tolist(), state.tolist()):
                    best[one] = max(best[one], self._long(automaton, symbols, int(places[one]), int(stops[one]), step, now))
                break
            at = places[lane] + gone if step > 0 else places[lane] - gone - 1
            inside = at < stops[lane] if step > 0 else at >= stops[lane]
            lane, at, state = lane[inside], at[inside], state[inside]
            state = flat[state * self.width + symbols[at]]
            alive = state >= 0
            lane, state, gone = lane[alive], state[alive], gone + 1
            best[lane[accepts[state] == 1]] = gone
        return best

    def _long(self, automaton: Automaton, symbols: np.ndarray, place: int, stop: int, step: int, state: int) -> int:
        """The rest of one long match: bytes that leave its state as it is are passed over at once."""
        best, gone, size = -1, LONG_MATCH, abs(stop - place)
        while gone < size:
            count = min(RUN_BYTES, size - gone)
            run = symbols[place + gone : place + gone + count] if step > 0 else symbols[place - gone - count : place - gone][::-1]
            leaves = automaton.table[state][run] != state
            same = int(leaves.argmax()) if leaves.any() else count
            if same == 0:
                state = int(automaton.table[state, run[0]])
                if state < 0:
                    break
            gone += max(same, 1)
            if automaton.accepts[state] == 1:
                best = gone
        return best

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, rule, start and end (in bytes of the slice) of all spans, by text, start and rule."""
        symbols = self.classes[data]
        ending = self.automaton.accepts[self.states(symbols, offsets)]
        last = np.zeros(len(data), bool)
        last[offsets[1:][offsets[1:] > 0] - 1] = True
        found = []
        for i, rule in enumerate(self.rules):
            here = (ending >> i) & 1 == 1
            goes_on = np.zeros(len(data), bool)
            goes_on[:-1] = here[1:]
            ends = np.flatnonzero(here & (last | ~goes_on)) + 1
            text = np.searchsorted(offsets, ends, "left") - 1
            before = offsets[text]
            before[1:] = np.maximum(before[1:], ends[:-1])
            # Spans of a rule do not overlap, so a short way to the span before leaves no room.
            room = ends - before >= max(rule.least, 1)
            ends, text, before = ends[room], text[room], before[room]
            starts = ends - self.furthest(self.back[i], symbols, ends, before, -1)
            if self.heads[i] is not None:
                enough = ends - starts - self.furthest(self.heads[i], symbols, starts, ends, 1) >= rule.least
                ends, text, starts = ends[enough], text[enough], starts[enough]
            found.append((text, np.full(len(ends), i), starts, ends))
        text, rule, starts, ends = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((rule, starts, text))
        return text[order], rule[order], starts[order], ends[order]


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once in each Python worker."""
    return Scanner(rules)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``doc_id, spans``: the kind, start and end (code points, end exclusive) of all matches, by start, then kind.

    One pass over the whole texts without a shuffle. A null text counts as empty and has no
    spans; repeated rows each get their own row; a null id stays null; other columns are not
    read. Ties of a start are in the order of the rules.
    """
    if len({r.kind for r in rules}) < len(rules):
        raise ValueError("two rules of one kind")
    chosen = docs.select(F.col("`doc_id`").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
    kinds = [r.kind for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = scanner(rules)
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(1)):
                of, rule, starts, ends = compiled.matches(data, offsets)
                points = np.zeros(len(data) + 1, np.int64)
                np.cumsum(LEAD[data], out=points[1:])
                begins = points[offsets[of]]
                bounds = np.searchsorted(of, np.arange(end - first + 1))
                spans = pa.StructArray.from_arrays(
                    [
                        pa.array(kinds, pa.string()).take(pa.array(rule)),
                        pa.array(points[starts] - begins),
                        pa.array(points[ends] - begins),
                    ],
                    names=["kind", "start", "end"],
                )
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), lists], names=["doc_id", "spans"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def spelled(spans: Column | str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    found = find_secrets(docs, rules)

    def of_kinds(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of_kinds(r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in BASE_RULES]
    base = of_kinds(*[r.kind for r in BASE_RULES])
    return found.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled("spans").alias("spans"))
