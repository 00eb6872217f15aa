"""Suffix automaton over sequences of whole numbers, and matching statistics against it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class SuffixAutomaton:
    """Every run of the added sequences is a path from the start; linear in their length."""

    def __init__(self) -> None:
        self.steps: list[dict[int, int]] = [{}]
        self.links = [-1]
        self.lengths = [0]
        self.last = 0
        self.separator = -1

    def add(self, sequence: Iterable[int]) -> None:
        """Add a sequence of numbers from 0 up; runs never cross into the one before."""
        for symbol in sequence:
            self._extend(symbol)
        self._extend(self.separator)
        self.separator -= 1

    def _extend(self, symbol: int) -> None:
        steps, links, lengths = self.steps, self.links, self.lengths
        state, new = self.last, len(steps)
        steps.append({})
        lengths.append(lengths[state] + 1)
        links.append(0)
        while state >= 0 and symbol not in steps[state]:
            steps[state][symbol] = new
            state = links[state]
        if state >= 0:
            target = steps[state][symbol]
            if lengths[state] + 1 == lengths[target]:
                links[new] = target
            else:
                copy = len(steps)
                steps.append(dict(steps[target]))
                lengths.append(lengths[state] + 1)
                links.append(links[target])
                while state >= 0 and steps[state].get(symbol) == target:
                    steps[state][symbol] = copy
                    state = links[state]
                links[target] = links[new] = copy
        self.last = new

    def statistics(self, sequence: Iterable[int]) -> Iterator[int]:
        """At each place, the length of the longest run ending there that was added."""
        steps, links, lengths = self.steps, self.links, self.lengths
        state = size = 0
        for symbol in sequence:
            while state and symbol not in steps[state]:
                state = links[state]
                size = lengths[state]
            following = steps[state].get(symbol)
            if following is None:
                state = size = 0
            else:
                state, size = following, size + 1
            yield size

    def spans(self, sequence: Iterable[int], least: int) -> list[tuple[int, int]]:
        """Maximal stretches covered by matches of at least that length, ends exclusive."""
        out: list[list[int]] = []
        for place, size in enumerate(self.statistics(sequence)):
            if size >= least:
                begin = place + 1 - size
                while out and out[-1][1] >= begin:
                    begin = min(begin, out.pop()[0])
                out.append([begin, place + 1])
        return [(a, b) for a, b in out]
