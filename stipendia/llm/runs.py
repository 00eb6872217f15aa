"""Squares of a sequence as it grows: a suffix automaton whose link tree has link-cut access.

The states on the path from a new prefix's state to the root are all runs that end at the appended
word. The tree of suffix links is kept as preferred paths, one splay tree each (ordered by length of
the state), and a path has one colour: where its runs ended last. Access to the new state walks the path
by colours, not by states, and recolours it. On a segment of lengths low < x <= high that ended last
at place c, the distance d between the previous end c and the new end i is a square's half if low < d <= high: the
last d words then equal the d words before them, and nothing nearer does, so d is their
smallest period. The number of segments over n words is in the order of n log n.
"""

from __future__ import annotations

from collections.abc import Sequence

#: Stands for no state; the first state is ROOT.
NONE, ROOT = 0, 1


class Squares:
    """Fed word by word; tells the periods of the squares that end at each word."""

    def __init__(self) -> None:
        self.steps: list[dict[int, int]] = [{}, {}]
        self.links, self.lengths = [NONE, NONE], [0, 0]
        self.last, self.size = ROOT, 0
        # Splay trees over preferred paths; `up` of a tree's root is the state above the path.
        self.left, self.right, self.up = [NONE] * 2, [NONE] * 2, [NONE] * 2
        self.colour = [-1, -1]

    def append(self, symbol: int) -> list[int]:
        """The smallest periods of all squares of primitive halves that end at this word."""
        return self._access(self._extend(symbol))

    def _state(self, steps: dict[int, int], length: int, link: int) -> int:
        self.steps.append(steps)
        self.lengths.append(length)
        self.links.append(link)
        self.left.append(NONE)
        self.right.append(NONE)
        self.up.append(NONE)
        self.colour.append(-1)
        return len(self.links) - 1

    def _extend(self, symbol: int) -> int:
        steps, links, lengths = self.steps, self.links, self.lengths
        state = self.last
        new = self._state({}, lengths[state] + 1, ROOT)
        while state and symbol not in steps[state]:
            steps[state][symbol] = new
            state = links[state]
        if state:
            target = steps[state][symbol]
            if lengths[state] + 1 == lengths[target]:
                links[new] = target
            else:
                copy = self._state(dict(steps[target]), lengths[state] + 1, links[target])
                while state and steps[state].get(symbol) == target:
                    steps[state][symbol] = copy
                    state = links[state]
                links[target] = links[new] = copy
                self._above(target, copy)
        self.last = new
        return new

    def _above(self, state: int, copy: int) -> None:
        """Put a copied state on the path of the state, next above it: it ended last where that did."""
        self._splay(state)
        shorter = self.left[state]
        self.left[copy] = shorter
        if shorter:
            self.up[shorter] = copy
        self.left[state] = copy
        self.up[copy] = state

    def _access(self, new: int) -> list[int]:
        right, up, lengths, colour, splay = self.right, self.up, self.lengths, self.colour, self._splay
        place = self.size
        self.size += 1
        found = []
        below, state = new, self.links[new]
        up[new] = state
        while state:
            splay(state)
            ended, above, longer = colour[state], up[state], right[state]
            if longer:
                colour[longer] = ended
            right[state] = below
            distance = place - ended
            if lengths[above] < distance <= lengths[state]:
                found.append(distance)
            below, state = state, above
        colour[below] = place
        return found

    def _splay(self, x: int) -> None:
        """Make x the root of its tree; the colour of a tree is held at its root."""
        left, right, up, colour = self.left, self.right, self.up, self.colour
        while True:
            p = up[x]
            if left[p] == x:
                x_left = True
            elif right[p] == x:
                x_left = False
            else:
                return
            g = up[p]
            p_left = left[g] == p
            if not p_left and right[g] != p:
                colour[x] = colour[p]
                self._rotate(x, p, g, x_left)
                return
            top = up[g]
            if x_left == p_left:
                self._rotate(p, g, top, p_left)
                self._rotate(x, p, top, x_left)
            else:
                self._rotate(x, p, g, x_left)
                self._rotate(x, g, top, p_left)
            if left[top] == g:
                left[top] = x
            elif right[top] == g:
                right[top] = x
            else:
                colour[x] = colour[g]
                return

    def _rotate(self, x: int, p: int, top: int, x_left: bool) -> None:
        """x takes the place of p, its parent."""
        left, right, up = self.left, self.right, self.up
        if x_left:
            inner = right[x]
            left[p] = inner
            right[x] = p
        else:
            inner = left[x]
            right[p] = inner
            left[x] = p
        if inner:
            up[inner] = p
        up[p] = x
        up[x] = top


def runs(sequence: Sequence[int], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """start, length and smallest period of all runs of at least `least` words and `exponent` periods.

    A run of period q is a longest stretch of places at which squares of period q end.
    """
    squares, out = Squares(), []
    going: dict[int, list[int]] = {}

    def close(period: int, first: int, last: int) -> None:
        length = last - first + 2 * period
        if length >= max(least, exponent * period):
            out.append((first - 2 * period + 1, length, period))

    for place, symbol in enumerate(sequence):
        for period in squares.append(symbol):
            span = going.get(period)
            if span and span[1] == place - 1:
                span[1] = place
            else:
                if span:
                    close(period, *span)
                going[period] = [place, place]
    for period, span in going.items():
        close(period, *span)
    return sorted(out, key=lambda r: (r[0], r[2]))
