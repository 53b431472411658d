"""One deterministic automaton for many small grammars, scanned in lockstep.

``compile_grammars`` takes ``{name: pattern}`` in a small regular-expression
subset (literals, ``\\`` escapes, ``[...]`` classes, ``(a|b)`` groups and the
postfix operators ``* + ? {n} {m,n}``), builds a Thompson NFA of all patterns
behind an unanchored start, and determinises it by subset construction over
byte equivalence classes.  ``Automaton.scan`` runs the resulting table over
many texts at once: the texts are laid into one byte buffer, cut into
overlapping windows, and all windows advance one byte per step as a single
numpy gather.  A match that ends in the shared part of two windows is seen
twice; the absolute end positions are deduplicated.

A match must fit into ``overlap`` bytes, which the window geometry guarantees
to be seen whole by at least one window.
"""

from __future__ import annotations

import numpy as np

WINDOW, OVERLAP = 768, 192


class _Parser:
    """Recursive descent over the pattern; emits NFA fragments."""

    def __init__(self, nfa: "_Nfa", pattern: str, fold: bool):
        self.nfa, self.p, self.i, self.fold = nfa, pattern, 0, fold

    def alternatives(self):
        parts = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]

        def build(start, parts=parts):
            end = self.nfa.state()
            for part in parts:
                self.nfa.empty(part(start), end)
            return end

        return build

    def sequence(self):
        items = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            items.append(self.repeated())

        def build(start, items=items):
            for item in items:
                start = item(start)
            return start

        return build

    def repeated(self):
        atom = self.atom()
        while self.i < len(self.p) and self.p[self.i] in "*+?{":
            c = self.p[self.i]
            self.i += 1
            if c == "{":
                j = self.p.index("}", self.i)
                low, _, high = self.p[self.i : j].partition(",")
                atom, self.i = self._times(atom, int(low), int(high or low)), j + 1
            elif c == "?":
                atom = self._times(atom, 0, 1)
            else:
                atom = self._loop(atom, c == "+")
        return atom

    def _times(self, atom, low, high):
        def build(start):
            ends = [start] if low == 0 else []
            for n in range(1, high + 1):
                start = atom(start)
                if n >= low:
                    ends.append(start)
            end = self.nfa.state()
            for e in ends:
                self.nfa.empty(e, end)
            return end

        return build

    def _loop(self, atom, once):
        def build(start):
            head = self.nfa.state()
            self.nfa.empty(start, head)
            tail = atom(head)
            self.nfa.empty(tail, head)
            end = self.nfa.state()
            self.nfa.empty(tail if once else head, end)
            if not once:
                self.nfa.empty(tail, end)
            return end

        return build

    def atom(self):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            inner = self.alternatives()
            self.i += 1
            return inner
        if c == "[":
            return self._step(self._set())
        if c == "\\":
            c = {"n": "\n", "t": "\t", "s": " "}.get(self.p[self.i], self.p[self.i])
            self.i += 1
        return self._step({ord(c)})

    def _set(self):
        negate = self.p[self.i] == "^"
        self.i += negate
        found: set[int] = set()
        while self.p[self.i] != "]":
            c = self.p[self.i]
            if c == "\\":
                self.i += 1
                c = {"n": "\n", "t": "\t"}.get(self.p[self.i], self.p[self.i])
            self.i += 1
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                found |= set(range(ord(c), ord(self.p[self.i + 1]) + 1))
                self.i += 2
            else:
                found.add(ord(c))
        self.i += 1
        return set(range(256)) - found if negate else found

    def _step(self, chars: set[int]):
        if self.fold:
            both = {ord(chr(c).swapcase()) for c in chars if c < 128 and chr(c).isalpha()}
            chars = chars | both

        def build(start):
            end = self.nfa.state()
            self.nfa.edges[start].append((frozenset(chars), end))
            return end

        return build


class _Nfa:
    def __init__(self):
        self.edges: list[list] = []
        self.eps: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.eps.append([])
        return len(self.edges) - 1

    def empty(self, a: int, b: int) -> None:
        self.eps[a].append(b)

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Automaton:
    """Dense transition table; ``accept[state]`` is a bit mask over ``names``."""

    def __init__(self, names, classes, table, accept):
        self.names, self.classes, self.table, self.accept = names, classes, table, accept

    def scan(self, texts: list[str], window: int = WINDOW, overlap: int = OVERLAP):
        """Return arrays (text index, end offset in characters, name mask), one row per matching end.

        Characters above U+00FF count as one byte without meaning, so offsets are character offsets.
        """
        raw = [t.encode("latin-1", "replace") for t in texts]
        starts = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
        none = np.zeros(0, np.int64)
        if not raw:
            return none, none, none
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        classes = self.classes[data]
        step = window - overlap
        count = max(1, -(-(len(data) - overlap) // step))
        padded = np.zeros((count - 1) * step + window, self.classes.dtype)
        padded[: len(classes)] = classes
        cols = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, window)[::step].T)
        state = np.zeros(count, np.int32)
        n_classes = self.table.shape[1]
        flat = self.table.ravel() * n_classes
        hits, hit_at, hit_mask = self.accept, [], []
        first = np.arange(count, dtype=np.int64) * step
        accept_scaled = np.zeros(len(self.accept) * n_classes, self.accept.dtype)
        accept_scaled[:: n_classes] = hits
        for k in range(window):
            state = flat[state + cols[k]]
            mask = accept_scaled[state]
            if mask.any():
                where = np.flatnonzero(mask)
                hit_at.append(first[where] + k)
                hit_mask.append(mask[where])
        if not hit_at:
            return none, none, none
        at, mask = np.concatenate(hit_at), np.concatenate(hit_mask)
        order = np.argsort(at, kind="stable")
        at, mask = at[order], mask[order]
        new = np.r_[True, at[1:] != at[:-1]]
        mask = np.bitwise_or.reduceat(mask, np.flatnonzero(new))
        at = at[new]
        inside = at < len(data)
        at, mask = at[inside], mask[inside]
        row = np.searchsorted(starts, at, "right") - 1
        return row, at - starts[row] + 1, mask


def compile_grammars(grammars: dict[str, str], folded: frozenset[str] = frozenset()) -> Automaton:
    """``folded`` names the grammars that ignore letter case."""
    nfa = _Nfa()
    root = nfa.state()
    names, ends = list(grammars), {}
    for bit, (name, pattern) in enumerate(grammars.items()):
        parser = _Parser(nfa, pattern, name in folded)
        end = parser.alternatives()(root)
        ends[end] = ends.get(end, 0) | 1 << bit
        if parser.i != len(pattern):
            raise ValueError(f"pattern {name} is not well formed at {parser.i}")
    sets = list(dict.fromkeys(chars for edges in nfa.edges for chars, _ in edges))
    signature = [tuple(b in s for s in sets) for b in range(256)]
    ids = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    classes = np.array([ids[s] for s in signature], np.int32)
    sample = [signature.index(s) for s in ids]
    # Sets of NFA states are bit masks.  What the root leads to is the same in every state and is worked out once.
    closures = [sum(1 << t for t in nfa.closure([s])) for s in range(len(nfa.edges))]
    kinds = {chars: [i for i, b in enumerate(sample) if b in chars] for chars in sets}
    steps = [[(kinds[chars], closures[t]) for chars, t in edges] for edges in nfa.edges]
    final = sum(1 << s for s in ends)
    base = closures[root]

    def reached(mask: int, row: list[int]) -> list[int]:
        while mask:
            low = mask & -mask
            for found, target in steps[low.bit_length() - 1]:
                for i in found:
                    row[i] |= target
            mask ^= low
        return row

    always = reached(base, [base] * len(sample))
    states, table, accept, todo = {base: 0}, [], [], [base]
    for current in todo:
        row = []
        for target in reached(current & ~base, list(always)):
            if target not in states:
                states[target] = len(states)
                todo.append(target)
            row.append(states[target])
        table.append(row)
        hit, mask = current & final, 0
        while hit:
            low = hit & -hit
            mask |= ends[low.bit_length() - 1]
            hit ^= low
        accept.append(mask)
    return Automaton(names, classes, np.array(table, np.int32), np.array(accept, np.int64))
