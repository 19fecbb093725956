"""A suffix automaton over words, with occurrence counts, and matching statistics against it."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    """The automaton of several word sequences: each state stands for substrings with the same end positions."""

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, words: Iterable, weight: int = 1) -> None:
        """Add a sequence that occurs ``weight`` times."""
        step, link, length, count = self.step, self.link, self.length, self.count
        last = 0
        for w in words:
            known = step[last].get(w)
            if known is not None:
                # an earlier sequence has this substring
                if length[known] == length[last] + 1:
                    last = known
                else:
                    last = self._split(last, w, known)
                count[last] += weight
                continue
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(weight)
            at = last
            while at >= 0 and w not in step[at]:
                step[at][w] = new
                at = link[at]
            if at >= 0:
                target = step[at][w]
                link[new] = target if length[target] == length[at] + 1 else self._split(at, w, target)
            last = new

    def _split(self, at: int, w, target: int) -> int:
        copy = len(self.step)
        self.step.append(dict(self.step[target]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[target])
        self.count.append(0)
        self.link[target] = copy
        while at >= 0 and self.step[at].get(w) == target:
            self.step[at][w] = copy
            at = self.link[at]
        return copy

    def close(self) -> None:
        """Sum occurrences up the suffix links; ``repeated[s]`` is the length of the longest suffix of s that occurs twice."""
        order = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        for s in reversed(order):
            self.count[self.link[s]] += self.count[s]
        self.repeated = [0] * len(self.step)
        for s in order:
            self.repeated[s] = self.length[s] if self.count[s] > 1 else self.repeated[self.link[s]]

    def statistics(self, words: Iterable) -> list[int]:
        """At each word, the length of the longest string that ends there and occurs at least twice in the sequences."""
        at, size, out = 0, 0, []
        step, link, length, repeated = self.step, self.link, self.length, self.repeated
        for w in words:
            nxt = step[at].get(w)
            while nxt is None and at:
                at = link[at]
                size = length[at]
                nxt = step[at].get(w)
            if nxt is not None:
                at, size = nxt, size + 1
            out.append(size if size < repeated[at] else repeated[at])
        return out
