"""Directories of ZIP files, read by ranges: members are located, never extracted.

Knows the end record, the ZIP64 end record behind its locator, and ZIP64 fields of members.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

END, LOCATOR, END64, ENTRY, LOCAL = (
    b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04")
END_SIZE, LOCATOR_SIZE, END64_SIZE, ENTRY_SIZE, LOCAL_SIZE = 22, 20, 56, 46, 30
LONGEST_COMMENT = 0xFFFF
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
Read = Callable[[int, int], bytes]


class DamagedZip(ValueError):
    pass


@dataclass
class Member:
    """A member of an archive; a stored one has its bytes at `begin` of the file."""

    name: str
    stored: bool
    size: int
    header: int
    crc: int

    def begin(self, read: Read) -> int:
        """Where its data begin: after its own header, whose length only the header has."""
        head = read(self.header, LOCAL_SIZE)
        if head[:4] != LOCAL or len(head) < LOCAL_SIZE:
            raise DamagedZip(f"no member at {self.header}")
        name, extra = struct.unpack_from("<HH", head, 26)
        return self.header + LOCAL_SIZE + name + extra


def directory_place(read: Read, size: int) -> tuple[int, int, int]:
    """Begin and length of the central directory, and its number of members."""
    tail_size = min(size, END_SIZE + LONGEST_COMMENT + LOCATOR_SIZE)
    tail = read(size - tail_size, tail_size)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) - at < END_SIZE or
                       at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise DamagedZip("no end of a central directory")
    count, length, begin = struct.unpack_from("<HII", tail, at + 10)
    locator = at - LOCATOR_SIZE
    if locator >= 0 and tail[locator:locator + 4] == LOCATOR:
        end64 = read(struct.unpack_from("<Q", tail, locator + 8)[0], END64_SIZE)
        if end64[:4] != END64:
            raise DamagedZip("no ZIP64 end record where its locator points")
        count, length, begin = struct.unpack_from("<QQQ", end64, 32)
    elif FULL16 == count or FULL32 in (length, begin):
        raise DamagedZip("a ZIP64 directory without its locator")
    return begin, length, count


def wide(extra: bytes, values: list[int]) -> list[int]:
    """Put the 64-bit values of the ZIP64 field where the 32-bit ones are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            field = at + 4
            out = []
            for value in values:
                if value == FULL32:
                    value = struct.unpack_from("<Q", extra, field)[0]
                    field += 8
                out.append(value)
            return out
        at += 4 + size
    return values


def members(read: Read, size: int) -> list[Member]:
    """All members in the order of the central directory."""
    begin, length, count = directory_place(read, size)
    data = read(begin, length)
    out, at = [], 0
    for _ in range(count):
        if data[at:at + 4] != ENTRY:
            raise DamagedZip("the central directory ends too early")
        method, = struct.unpack_from("<H", data, at + 10)
        crc, packed, plain, name_size, extra_size, comment = struct.unpack_from("<IIIHHH", data, at + 16)
        header, = struct.unpack_from("<I", data, at + 42)
        name_at = at + ENTRY_SIZE
        extra = data[name_at + name_size:name_at + name_size + extra_size]
        plain, packed, header = wide(extra, [plain, packed, header])
        name = data[name_at:name_at + name_size].decode("utf-8", "replace")
        out.append(Member(name, method == 0, packed, header, crc))
        at = name_at + name_size + extra_size + comment
    return out
