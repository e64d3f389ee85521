"""The generalised suffix automaton that matching operators share."""

from __future__ import annotations


class SuffixAutomaton:
    """Generalised suffix automaton over integers; state 0 is the root."""

    def __init__(self) -> None:
        self.step: dict[tuple[int, int], int] = {}
        self.link, self.length = [-1], [0]
        self.letters: list[set[int]] = [set()]

    def _state(self, length: int, like: int | None = None) -> int:
        s = len(self.length)
        self.length.append(length)
        self.link.append(0 if like is None else self.link[like])
        self.letters.append(set() if like is None else set(self.letters[like]))
        if like is not None:
            for c in self.letters[like]:
                self.step[s, c] = self.step[like, c]
        return s

    def add(self, sequence: list[int]) -> int:
        """Insert a sequence; returns the state of the whole of it."""
        last = 0
        for c in sequence:
            last = self._extend(last, c)
        return last

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, like=q)
        while p >= 0 and self.step.get((p, c)) == q:
            self.step[p, c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step.get((last, c))
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and (p, c) not in self.step:
            self.step[p, c] = new
            self.letters[p].add(c)
            p = self.link[p]
        if p >= 0:
            q = self.step[p, c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new
