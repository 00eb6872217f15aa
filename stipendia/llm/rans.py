"""Static range asymmetric numeral system over whole numbers, many lanes at a time in numpy.

Symbol i of a block belongs to lane i % LANES. A lane's state is 64 bits wide, stays at LOW or
above, and moves 32 bits to or from the stream at a time; lanes take turns in order, so one stream serves
all. A checkpoint holds all states and the place in the stream before a step: decoding can start there.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

LANES = 1024
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
CHECKPOINT_STEPS = 128
HEADER = struct.Struct("<4sQIIIII")
MAGIC = b"RANB"


@dataclass
class Tables:
    """Frequencies of all symbols in units of 2**-SCALE_BITS, shared by all blocks."""

    frequencies: np.ndarray

    def __post_init__(self) -> None:
        self.begins = np.concatenate([[0], np.cumsum(self.frequencies)[:-1]]).astype(np.uint64)
        self.wide = self.frequencies.astype(np.uint64)
        self._symbols: np.ndarray | None = None

    @property
    def symbols(self) -> np.ndarray:
        """The symbol of each unit."""
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.frequencies), dtype=np.uint32),
                                      self.frequencies)
        return self._symbols

    def packed(self) -> bytes:
        body = zlib.compress(self.frequencies.astype("<u4").tobytes())
        return struct.pack("<4sII", b"RANT", zlib.crc32(body), len(body)) + body

    @staticmethod
    def unpacked(data: bytes) -> Tables:
        magic, check, size = struct.unpack_from("<4sII", data)
        body = data[12:12 + size]
        if magic != b"RANT" or zlib.crc32(body) != check:
            raise ValueError("damaged frequency table")
        return Tables(np.frombuffer(zlib.decompress(body), "<u4").astype(np.int64))


def tables(counts: np.ndarray) -> Tables:
    """Frequencies that add up to 2**SCALE_BITS, at least 1 for every symbol that occurs.

    Each symbol gets one unit; the others are dealt by count, what rounding leaves to the most
    frequent symbol.
    """
    total = int(counts.sum())
    if not total:
        return Tables(np.zeros(len(counts), np.int64))
    present = counts > 0
    spare = (1 << SCALE_BITS) - int(present.sum())
    if spare < 0:
        raise ValueError(f"more than 2**{SCALE_BITS} different symbols")
    shares = np.array([int(c) * spare // total for c in counts], np.int64) + present
    shares[int(np.argmax(counts))] += (1 << SCALE_BITS) - int(shares.sum())
    return Tables(shares)


def encode(symbols: np.ndarray, table: Tables) -> bytes:
    """A block: header, checkpoints, first states, stream; all little-endian."""
    n = len(symbols)
    steps = -(-n // LANES)
    state = np.full(LANES, LOW, np.uint64)
    parts: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    behind = 0
    shift = np.uint64(63 - SCALE_BITS)
    for step in range(steps - 1, -1, -1):
        now = symbols[step * LANES:(step + 1) * LANES]
        live = len(now)
        f, x = table.wide[now], state[:live]
        full = x >= (f << shift)
        out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
        parts.append(out)
        behind += len(out)
        x = np.where(full, x >> WORD, x)
        whole, rest = np.divmod(x, f)
        state[:live] = (whole << np.uint64(SCALE_BITS)) + rest + table.begins[now]
        if step and step % CHECKPOINT_STEPS == 0:
            marks.append((behind, state.copy()))
    stream = np.concatenate(parts[::-1]) if parts else np.zeros(0, "<u4")
    marks.reverse()
    body = b"".join([
        *(struct.pack("<I", len(stream) - left) + kept.astype("<u8").tobytes() for left, kept in marks),
        state.astype("<u8").tobytes(), stream.tobytes()])
    head = HEADER.pack(MAGIC, n, len(marks), len(stream),
                       zlib.crc32(symbols.astype("<u4").tobytes()), zlib.crc32(body), LANES)
    return head + body


@dataclass
class Block:
    """An encoded block: its length, checkpoints and stream."""

    n: int
    check: int
    states: list[np.ndarray]
    places: list[int]
    stream: np.ndarray


def parse(data: bytes) -> Block:
    """Read a block's header and check its bytes."""
    magic, n, marks, words, check, body_check, lanes = HEADER.unpack_from(data)
    body = memoryview(data)[HEADER.size:]
    if magic != MAGIC or lanes != LANES or zlib.crc32(body) != body_check:
        raise ValueError("damaged block")
    states, places, at = [], [0], 0
    kept = []
    for _ in range(marks):
        places.append(struct.unpack_from("<I", body, at)[0])
        kept.append(np.frombuffer(body, "<u8", LANES, at + 4).astype(np.uint64))
        at += 4 + LANES * 8
    states = [np.frombuffer(body, "<u8", LANES, at).astype(np.uint64), *kept]
    return Block(n, check, states, places, np.frombuffer(body, "<u4", words, at + LANES * 8))


def decode_piece(block: Block, piece: int, table: Tables) -> np.ndarray:
    """The symbols from one checkpoint to the next."""
    first = piece * CHECKPOINT_STEPS * LANES
    n = min(block.n - first, CHECKPOINT_STEPS * LANES)
    state, at = block.states[piece].copy(), block.places[piece]
    out = np.empty(n, np.uint32)
    mask = np.uint64((1 << SCALE_BITS) - 1)
    for begin in range(0, n, LANES):
        live = min(LANES, n - begin)
        x = state[:live]
        unit = x & mask
        now = table.symbols[unit]
        out[begin:begin + live] = now
        x = table.wide[now] * (x >> np.uint64(SCALE_BITS)) + unit - table.begins[now]
        low = x < LOW
        used = int(low.sum())
        x[low] = (x[low] << WORD) | block.stream[at:at + used]
        at += used
        state[:live] = x
    return out


def decode(data: bytes, table: Tables) -> np.ndarray:
    """All symbols of a block, after both checksums."""
    block = parse(data)
    parts = [decode_piece(block, i, table) for i in range(len(block.states))]
    out = np.concatenate(parts) if block.n else np.zeros(0, np.uint32)
    if zlib.crc32(out.astype("<u4").tobytes()) != block.check:
        raise ValueError("decoded symbols do not match their checksum")
    return out
