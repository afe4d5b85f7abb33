"""Rules as byte automata: subset construction, minimisation, and vectorised scans.

A rule is an expression over bytes made with ``lit``, ``cls``, ``seq``, ``alt``,
``opt`` and ``plus``. ``compile_rules`` joins all rules in one deterministic
automaton, a transition array of shape (states, 256) with a bit mask of accepting
rules per state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Node = tuple


def lit(text: bytes, any_case: bool = False) -> Node:
    return seq(*[cls(bytes({b, ord(chr(b).swapcase())})) if any_case and chr(b).isalpha() else cls(bytes([b]))
                 for b in text])


def cls(members: bytes) -> Node:
    return ("cls", frozenset(members))


def seq(*parts: Node) -> Node:
    return ("seq", parts)


def alt(*parts: Node) -> Node:
    return ("alt", parts)


def opt(part: Node) -> Node:
    return ("alt", (part, ("seq", ())))


def plus(part: Node) -> Node:
    return ("plus", part)


def star(part: Node) -> Node:
    return opt(plus(part))


def backwards(node: Node) -> Node:
    """The expression of the reversed strings."""
    kind, body = node
    if kind == "cls":
        return node
    if kind == "plus":
        return ("plus", backwards(body))
    parts = tuple(backwards(p) for p in body)
    return (kind, parts[::-1] if kind == "seq" else parts)


class _Nfa:
    """States with empty moves and one byte-class move each."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.move: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.move.append(None)
        return len(self.move) - 1

    def add(self, node: Node, begin: int) -> int:
        """Lay ``node`` from ``begin`` on and return where it ends."""
        kind, body = node
        if kind == "cls":
            end = self.state()
            if self.move[begin] is not None:  # one move a state
                fresh = self.state()
                self.empty[begin].append(fresh)
                begin = fresh
            self.move[begin] = (body, end)
            return end
        if kind == "seq":
            for part in body:
                begin = self.add(part, begin)
            return begin
        end = self.state()
        if kind == "plus":
            inner = self.state()
            self.empty[begin].append(inner)
            last = self.add(body, inner)
            self.empty[last] += [inner, end]
            return end
        for part in body:
            inner = self.state()
            self.empty[begin].append(inner)
            self.empty[self.add(part, inner)].append(end)
        return end

    def closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


@dataclass
class Dfa:
    """``table[state, byte]`` is the next state; ``accepts[state]`` a bit mask of rules; state 0 begins.

    ``resets`` marks the bytes that lead every state to the beginning: a text may be cut behind them.
    """

    table: np.ndarray
    accepts: np.ndarray
    dead: int  # the state that nothing leaves, or -1

    @property
    def resets(self) -> np.ndarray:
        return (self.table == 0).all(axis=0)


def _minimised(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no continuation tells apart (partition refinement)."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    # Number the blocks from the first state on, so that state 0 stays the beginning.
    _, first = np.unique(block, return_index=True)
    order = np.argsort(first)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    keep = first[order]
    return rank[block][table[keep]].astype(np.uint16), accepts[keep]


def compile_rules(rules: list[Node], anywhere: bool) -> Dfa:
    """One automaton for all rules; ``anywhere``: a rule may begin at every byte."""
    nfa = _Nfa()
    begin = nfa.state()
    ends = []
    for rule in rules:
        inner = nfa.state()
        nfa.empty[begin].append(inner)
        ends.append(nfa.add(rule, inner))
    start = nfa.closed([begin])
    number, todo, rows = {start: 0}, [start], []
    while todo:
        states = todo.pop(0)
        by_byte: list[set] = [set() for _ in range(256)]
        for s in states:
            if nfa.move[s]:
                members, end = nfa.move[s]
                for b in members:
                    by_byte[b].add(end)
        row, seen = [], {}
        for targets in map(frozenset, by_byte):
            if targets not in seen:
                nxt = nfa.closed(targets) | (start if anywhere else frozenset())
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                seen[targets] = number[nxt]
            row.append(seen[targets])
        rows.append(row)
    masks = np.array([sum(1 << i for i, e in enumerate(ends) if e in states) for states in number], dtype=np.int64)
    table, accepts = _minimised(np.array(rows), masks)
    stuck = np.flatnonzero((table == np.arange(len(table))[:, None]).all(axis=1) & (accepts == 0))
    return Dfa(table, accepts, int(stuck[0]) if len(stuck) and not anywhere else -1)


def accepting_ends(dfa: Dfa, data: np.ndarray, cuts: np.ndarray, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(position, mask) behind each byte where rules stop accepting: the ends of longest candidates.

    ``data`` is cut at ``cuts`` (sorted, from 0 to its length; each cut follows a
    reset byte) into pieces; pieces are joined to lanes of about ``lane`` bytes
    that run side by side, one byte of all lanes per step.
    """
    starts = np.unique(cuts[np.searchsorted(cuts, np.arange(0, len(data), lane))]) if len(data) else cuts[:0]
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if starts[0]:
        starts = np.concatenate([[0], starts])
    lengths = np.diff(np.append(starts, len(data)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    flat = dfa.table.ravel()
    state = np.zeros(len(starts), dtype=np.int32)
    before = np.zeros(len(starts), dtype=np.int64)
    accepts = dfa.accepts
    any_accepts = accepts != 0
    running = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # lanes longer than the step
    at, masks = [], []
    for step in range(int(lengths[0])):
        n = running[step]
        state = flat[(state[:n] << 8) | data[starts[:n] + step]].astype(np.int32)
        was = before[:n]
        if was.any() or any_accepts[state].any():
            now = accepts[state]
            over = was & ~now
            hit = np.flatnonzero(over)
            if len(hit):
                at.append(starts[hit] + step)
                masks.append(over[hit])
            before = now
        else:
            before = was
    return (np.concatenate(at), np.concatenate(masks)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def earliest_start(reverse: Dfa, data: bytes, end: int, floor: int) -> int:
    """The smallest start >= ``floor`` of a match that ends at ``end``; -1 if there is none."""
    state, found, at = 0, -1, end
    table, accepts, dead = reverse.table, reverse.accepts, reverse.dead
    while at > floor:
        at -= 1
        state = table[state, data[at]]
        if state == dead:
            break
        if accepts[state]:
            found = at
    return found
