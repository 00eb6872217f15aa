"""Bounded-space online best-fit: pieces go to the fullest open bin that has room."""

from __future__ import annotations


class OpenBins:
    """At most `most` open bins, found by free space in a bitset; a placed piece stays where it is."""

    def __init__(self, size: int, most: int) -> None:
        if size < 1 or most < 1:
            raise ValueError("bins need a size and there must be one")
        self.size, self.most = size, most
        #: Bit f is set when an open bin has f places free; `held` has these bins.
        self.free = 0
        self.held: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece of 1 to `size` places, and where in it the piece begins."""
        if length == self.size:
            return self._new(), 0
        fitting = self.free >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = self._take(room)
        else:
            if self.open == self.most:
                # The fullest bin, the one with the least room, is closed.
                self._take((self.free & -self.free).bit_length() - 1)
            room, number = self.size, self._new()
        left = room - length
        if left:
            self.held[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.size - room

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def _take(self, room: int) -> int:
        bins = self.held[room]
        number = bins.pop()
        if not bins:
            self.free ^= 1 << room
        self.open -= 1
        return number
