"""Byte automata for sets of rules: a small pattern form, subset construction, minimization, lane-parallel runs.

A rule is a head pattern followed by one or more bytes of a tail class. All heads and tails compile
into one unanchored automaton whose states carry a bit per rule: the bit is set while the last byte
belongs to the tail of a match of that rule. Reversed heads compile to one small automaton per rule,
which finds where a match began.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BREAK = 0xFF  # never part of UTF-8; separates texts and returns every automaton to its start


@dataclass(frozen=True)
class Rule:
    """``head`` then a run of ``tail`` bytes of at least ``least``; letters of the head in any case if ``fold``."""

    kind: str
    head: str
    tail: str
    least: int
    fold: bool = False


class _Pattern:
    """Parses alternation, groups, classes, ``?``, ``*``, ``+`` and ``\\`` escapes into a Thompson graph."""

    def __init__(self, graph: list, text: str, fold: bool, reverse: bool):
        self.graph, self.text, self.at, self.fold, self.reverse = graph, text, 0, fold, reverse

    def _node(self) -> int:
        self.graph.append(([], []))  # silent edges; edges by byte set
        return len(self.graph) - 1

    def choice(self) -> tuple[int, int]:
        start, end = self._node(), self._node()
        while True:
            first, last = self._chain()
            self.graph[start][0].append(first)
            self.graph[last][0].append(end)
            if self.at >= len(self.text) or self.text[self.at] != "|":
                return start, end
            self.at += 1

    def _chain(self) -> tuple[int, int]:
        parts = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            parts.append(self._repeat())
        node = self._node()
        first = last = node
        for start, end in reversed(parts) if self.reverse else parts:
            self.graph[last][0].append(start)
            last = end
        return first, last

    def _repeat(self) -> tuple[int, int]:
        start, end = self._atom()
        while self.at < len(self.text) and self.text[self.at] in "?*+":
            mark = self.text[self.at]
            self.at += 1
            outer, exit_ = self._node(), self._node()
            self.graph[outer][0].append(start)
            self.graph[end][0].append(exit_)
            if mark != "+":
                self.graph[outer][0].append(exit_)
            if mark != "?":
                self.graph[end][0].append(start)
            start, end = outer, exit_
        return start, end

    def _atom(self) -> tuple[int, int]:
        if self.text[self.at] == "(":
            self.at += 1
            out = self.choice()
            self.at += 1
            return out
        members = self._class() if self.text[self.at] == "[" else {self._byte()}
        if self.fold:
            members |= {ord(c) for m in members for c in (chr(m).lower(), chr(m).upper()) if chr(m).isascii() and chr(m).isalpha()}
        start, end = self._node(), self._node()
        self.graph[start][1].append((frozenset(members), end))
        return start, end

    def _byte(self) -> int:
        char = self.text[self.at]
        self.at += 1
        if char != "\\":
            return ord(char)
        char = self.text[self.at]
        self.at += 1
        if char == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "r": 13, "t": 9}.get(char, ord(char))

    def _class(self) -> set[int]:
        self.at += 1
        members: set[int] = set()
        while self.text[self.at] != "]":
            low = self._byte()
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                members |= set(range(low, self._byte() + 1))
            else:
                members.add(low)
        self.at += 1
        return members


def byte_class(text: str) -> np.ndarray:
    """Membership of every byte in a class such as ``[A-Z0-9]``."""
    members = _Pattern([], text, False, False)._class()
    return np.isin(np.arange(256), list(members))


def _closure(graph: list, nodes) -> frozenset[int]:
    seen, todo = set(nodes), list(nodes)
    while todo:
        for node in graph[todo.pop()][0]:
            if node not in seen:
                seen.add(node)
                todo.append(node)
    return frozenset(seen)


def _determine(graph: list, start: int, finals: dict[int, int], unanchored: bool) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction: next state per (state, byte), and the rule bits per state. State 0 is the start."""
    origin = _closure(graph, [start])
    index, todo, rows = {origin: 0}, [origin], []
    used = {members for node in graph for members, _ in node[1]}
    alike: dict[tuple, list[int]] = {}  # bytes that every edge treats the same
    for byte in range(256):
        alike.setdefault(tuple(byte in members for members in used), []).append(byte)
    while todo:
        current = todo.pop(0)
        row = np.zeros(256, np.int32)
        edges = [edge for node in current for edge in graph[node][1]]
        known: dict[frozenset, int] = {}
        for same in alike.values():
            targets = frozenset(end for members, end in edges if same[0] in members)
            if targets not in known:
                state = _closure(graph, targets | ({start} if unanchored else set()))
                if state not in index:
                    index[state] = len(index)
                    todo.append(state)
                known[targets] = index[state]
            row[same] = known[targets]
        rows.append(row)
    table = np.stack(rows)
    bits = np.array([sum(1 << bit for node, bit in finals.items() if node in state) for state in index], np.uint16)
    if unanchored:
        table[:, BREAK] = 0
    return table, bits


def _minimize(table: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no byte sequence can tell apart; the start stays state 0."""
    group = np.unique(bits, return_inverse=True)[1]
    while True:
        mark = np.concatenate([group[:, None], group[table]], axis=1)
        finer = np.unique(mark, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    first = np.unique(group, return_index=True)[1]
    order = np.argsort(first)  # the start's group comes first
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    keep = first[order]
    return rank[group[table[keep]]].astype(np.int32), bits[keep]


class Scanner:
    """All rules in one automaton, plus a reversed head automaton for each."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        graph: list = [([], [])]
        finals = {}
        for bit, rule in enumerate(rules):
            start, end = _Pattern(graph, rule.head, rule.fold, False).choice()
            last = len(graph)
            graph.append(([], []))
            tail = frozenset(np.flatnonzero(byte_class(rule.tail)).tolist())
            graph[end][1].append((tail, last))
            graph[last][1].append((tail, last))
            graph[0][0].append(start)
            finals[last] = bit
        self.table, self.bits = _minimize(*_determine(graph, 0, finals, True))
        columns, self.column = np.unique(self.table, axis=1, return_inverse=True)  # bytes with equal transitions share a column
        self.column = self.column.reshape(-1).astype(np.int32)
        self.width = columns.shape[1]
        self.flat = (columns * self.width).astype(np.int32).reshape(-1)
        self.heads = []
        self.short_matter = []  # a match below the least length still uses up text that a later head could need
        for rule in rules:
            graph = []
            start, end = _Pattern(graph, rule.head, rule.fold, True).choice()
            table, final = _minimize(*_determine(graph, start, {end: 0}, False))
            dead = (table == np.arange(len(table))[:, None]).all(axis=1) & (final == 0)
            self.heads.append((table, final, dead))
            used = {b for node in graph for members, _ in node[1] for b in members}
            self.short_matter.append(not used <= set(np.flatnonzero(byte_class(rule.tail)).tolist()))

    def bits_of(self, data: np.ndarray, lanes: int = 2048) -> np.ndarray:
        """Rule bits after every byte, in one pass.

        The bytes are cut into lanes that run side by side from the start state; a lane whose
        predecessor ended elsewhere is run again from there until it meets its first run.
        """
        lanes = max(1, min(lanes, len(data) // 64))
        steps = -(-len(data) // lanes)
        padded = np.full(lanes * steps, BREAK, np.uint8)
        padded[: len(data)] = data
        grid = self.column[np.ascontiguousarray(padded.reshape(lanes, steps).T)]
        states = np.empty((steps, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for step in range(steps):
            state = self.flat[state + grid[step]]
            states[step] = state
        assumed = np.zeros(lanes, np.int32)
        while True:
            begin = np.concatenate([[0], states[-1, :-1]]).astype(np.int32)
            wrong = np.flatnonzero(begin != assumed)
            if not len(wrong):
                break
            assumed[wrong] = begin[wrong]
            state = begin[wrong]
            for step in range(steps):
                state = self.flat[state + grid[step, wrong]]
                differ = state != states[step, wrong]
                if not differ.any():
                    break
                wrong, state = wrong[differ], state[differ]
                states[step, wrong] = state
        return self.bits[states // self.width].T.reshape(-1)[: len(data)]

    def _head_start(self, bit: int, data: bytes, low: int, tail: int) -> int:
        """Earliest start at or after ``low`` of a head that ends at ``tail``; -1 if there is none."""
        table, final, dead = self.heads[bit]
        state, at, best = 0, tail, tail if final[0] else -1
        while at > low:
            at -= 1
            state = table[state, data[at]]
            if final[state]:
                best = at
            elif dead[state]:
                break
        return best

    def spans(self, bit: int, data: bytes, tails: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Leftmost matches without overlap among one text's tail runs, those below the least length left out."""
        rule, found, done = self.rules[bit], [], 0
        for tail, end in tails:
            start = self._head_start(bit, data, done, tail)
            if start < 0:  # the head lies in text that an earlier match used up: look again behind that
                state = 0
                for tail in range(done, end):
                    state = int(self.table[state, data[tail]])
                    if self.bits[state] >> bit & 1:
                        start = self._head_start(bit, data, done, tail)
                        break
                if start < 0:
                    continue
            done = end
            if end - tail >= rule.least:
                found.append((start, end))
        return found

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per text its matches as (start, rule, end) in bytes, in order."""
        sizes = np.array([len(t) + 1 for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not len(texts):
            return out
        bits = self.bits_of(np.frombuffer(bytes([BREAK]).join(texts) + bytes([BREAK]), np.uint8))
        for bit, rule in enumerate(self.rules):
            at = np.flatnonzero(bits & np.uint16(1 << bit))
            if not len(at):
                continue
            cut = np.flatnonzero(np.diff(at) > 1)
            first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1
            if not self.short_matter[bit]:
                long = last - first >= rule.least
                first, last = first[long], last[long]
            owner = np.searchsorted(starts, first, side="right") - 1
            for doc in np.unique(owner):
                mine = owner == doc if len(owner) < 64 else slice(*np.searchsorted(owner, [doc, doc + 1]))
                tails = list(zip((first[mine] - starts[doc]).tolist(), (last[mine] - starts[doc]).tolist()))
                out[doc] += [(start, bit, end) for start, end in self.spans(bit, texts[doc], tails)]
        return [sorted(found) for found in out]
