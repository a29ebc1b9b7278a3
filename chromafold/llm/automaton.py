"""A suffix automaton over several sequences, with occurrence counts and matching statistics."""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence


class SuffixAutomaton:
    """Recognises every run of symbols of the sequences added; each state knows how often its runs occur."""

    def __init__(self) -> None:
        self.step: list[dict[Hashable, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self._summed = False

    def _state(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, symbol: Hashable, q: int) -> int:
        """The state reached from p by symbol, cut off from q so that it holds runs one longer than p's."""
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(symbol) == q:
            self.step[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: Sequence[Hashable], weight: int = 1) -> None:
        """Add one sequence that occurs ``weight`` times."""
        step, link, length = self.step, self.link, self.length
        last = 0
        for symbol in sequence:
            q = step[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, symbol, q)
            else:
                new = self._state(length[last] + 1, {}, 0)
                p = last
                while p >= 0 and symbol not in step[p]:
                    step[p][symbol] = new
                    p = link[p]
                if p >= 0:
                    q = step[p][symbol]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, symbol, q)
                last = new
            self.count[last] += weight
        self._summed = False

    def _sum(self) -> None:
        if not self._summed:
            self.total = list(self.count)
            for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
                self.total[self.link[state]] += self.total[state]
            self._summed = True

    def matches(self, sequence: Sequence[Hashable], at_least: int = 1) -> Iterator[int]:
        """For each position, the length of the longest run ending there that occurs ``at_least`` times."""
        self._sum()
        step, link, length, total = self.step, self.link, self.length, self.total
        state = size = 0
        for symbol in sequence:
            while state and symbol not in step[state]:
                state = link[state]
                size = length[state]
            state = step[state].get(symbol, 0)
            size = size + 1 if state else 0
            s, n = state, size
            while s and total[s] < at_least:
                s = link[s]
                n = length[s]
            yield n if s else 0
