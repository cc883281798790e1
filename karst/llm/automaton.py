"""A lexicon trie intersected with Levenshtein automata, determinised as words are read."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple


class Term(NamedTuple):
    """A lexicon entry: a whole word, or a stem that any ending may follow; exact: no misspelling of it counts."""

    text: str
    whole: bool
    exact: bool = False

    @property
    def edits(self) -> int:
        """Misspellings allowed, by length."""
        n = len(self.text)
        return 0 if n < 5 or self.exact else 1 if n < 9 else 2


class FuzzyLexicon:
    """look(word) -> (term number + 1, edits) or (0, 0).

    A state is the set of (trie node, edits so far) that the letters read can lead to; an edge is computed when it
    is first taken and kept. Most words leave the trie after a few letters, so states stay few. The first letter
    must stand unless `anywhere`: then edits at the root count like others.
    """

    #: States, and pairs in them, kept before the tables are emptied.
    MOST_STATES, MOST_PAIRS = 200_000, 2_000_000

    def __init__(self, terms: Iterable[Term], anywhere: bool = False):
        self.terms, self.anywhere = list(terms), anywhere
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.allowed = [0]
        for number, term in enumerate(self.terms):
            node = 0
            for c in term.text:
                if c not in self.children[node]:
                    self.children.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                    self.children[node][c] = len(self.children) - 1
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], term.edits)
            self.ends[node].append(number)
        self.allowed[0] = max(self.allowed) if anywhere else 0
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.pairs = 0
        self.states: list[frozenset] = []
        self.found: list[tuple[int, int] | None] = []  # a stem is complete: nothing later changes that
        self.at_end: list[tuple[int, int]] = []
        self.edges: list[dict[str, int]] = []
        start: dict[int, int] = {}
        self._reach(start, 0, 0)
        self.start = self._number(frozenset(start.items()))
        self.dead = self._number(frozenset())

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.pairs += len(state)
            self.edges.append({})
            stems, words = [], []
            for node, edits in state:
                for number in self.ends[node]:
                    if edits <= self.terms[number].edits:
                        (words if self.terms[number].whole else stems).append((edits, number + 1))
            stem = min(stems, default=None)
            self.found.append((stem[1], stem[0]) if stem and stem[0] == 0 else None)
            best = min(stems + words, default=None)
            self.at_end.append((best[1], best[0]) if best else (0, 0))
        return self.numbers[state]

    def _reach(self, out: dict[int, int], node: int, edits: int) -> None:
        if edits <= self.allowed[node] and edits < out.get(node, 99):
            out[node] = edits
            if node or self.anywhere:  # a letter of the term is missing
                for child in self.children[node].values():
                    self._reach(out, child, edits + 1)

    def _step(self, state: frozenset, c: str) -> frozenset:
        out: dict[int, int] = {}
        for node, edits in state:
            if edits and any(edits <= self.terms[t].edits and not self.terms[t].whole for t in self.ends[node]):
                self._reach(out, node, edits)  # a misspelt stem stays found
            for letter, child in self.children[node].items():
                if letter == c:
                    self._reach(out, child, edits)
                elif node or self.anywhere:
                    self._reach(out, child, edits + 1)
            if node or self.anywhere:  # a letter too many
                self._reach(out, node, edits + 1)
        return frozenset(out.items())

    def look(self, word: str) -> tuple[int, int]:
        state, edges = self.start, self.edges
        for c in word:
            nxt = edges[state].get(c)
            if nxt is None:
                if len(self.states) > self.MOST_STATES or (self.pairs > self.MOST_PAIRS and state != self.start):
                    self._reset()
                    return self.look(word)
                nxt = edges[state][c] = self._number(self._step(self.states[state], c))
            state = nxt
            if state == self.dead:
                return 0, 0
            if self.found[state]:
                return self.found[state]
        return self.at_end[state]
