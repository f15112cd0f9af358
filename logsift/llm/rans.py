"""Range asymmetric numeral systems with a static table and many interleaved lanes, in numpy.

Symbol ``i`` of a block belongs to lane ``i % LANES``; all lanes take a step at once and share one
stream of 32-bit words, which they read in lane order. The state of a lane stays in [2^31, 2^63).
Checkpoints hold the lane states and the place in the stream before some steps, so that decoding can
start there.
"""

from __future__ import annotations

import numpy as np

SCALE_BITS = 18
LANES = 2048
CHECKPOINT_STEPS = 64
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
SCALE = np.uint64(SCALE_BITS)
MASK = np.uint64((1 << SCALE_BITS) - 1)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to the sum 2^18, every one at least 1."""
    total = 1 << SCALE_BITS
    if len(counts) > total:
        raise ValueError(f"more than {total} different symbols")
    scaled = np.maximum(1, counts * total // max(1, int(counts.sum()))).astype(np.int64)
    over = int(scaled.sum()) - total
    if over < 0:
        scaled[scaled.argmax()] -= over
    for i in np.argsort(-scaled, kind="stable"):
        if over <= 0:
            break
        take = min(over, int(scaled[i]) - 1)
        scaled[i] -= take
        over -= take
    return scaled


class Table:
    """Symbols with their scaled frequencies."""

    def __init__(self, symbols: np.ndarray, scaled: np.ndarray):
        self.symbols = symbols.astype(np.uint32)
        self.freq = scaled.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(scaled)[:-1])).astype(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        """Of non-negative ids, small enough to be counted by place."""
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        return cls(symbols, frequencies(counts[symbols]))

    def places(self) -> np.ndarray:
        """The place of every symbol among the symbols, by symbol."""
        found = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 0, dtype=np.int32)
        found[self.symbols] = np.arange(len(self.symbols), dtype=np.int32)
        return found

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freq.astype(np.int64))


def encode(ids: np.ndarray, table: Table, places: np.ndarray) -> tuple[bytes, bytes, list[tuple[int, int, bytes]]]:
    """Stream, first lane states and checkpoints (step, words before it, lane states)."""
    place = places[ids]
    freq, start = table.freq[place], table.start[place]
    lanes = min(LANES, len(ids))
    state = np.full(lanes, LOW, dtype=np.uint64)
    steps = -(-len(ids) // lanes) if lanes else 0
    limit = freq << np.uint64(63 - SCALE_BITS)
    streams, marks = [None] * steps, []
    for step in range(steps - 1, -1, -1):
        part = slice(step * lanes, min(len(ids), (step + 1) * lanes))
        f = freq[part]
        x = state[: len(f)]
        full = x >= limit[part]
        streams[step] = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
        x = np.where(full, x >> WORD, x)
        q = x // f
        state[: len(f)] = (q << SCALE) + (x - q * f) + start[part]
        if step and step % CHECKPOINT_STEPS == 0:
            marks.append((step, state.astype("<u8").tobytes()))
    sizes = np.cumsum([0, *map(len, streams)])
    stream = np.concatenate(streams).tobytes() if steps else b""
    points = [(step, int(sizes[step]), states) for step, states in reversed(marks)]
    return stream, state.astype("<u8").tobytes(), points


def decode(
    n: int, stream: bytes, states: bytes, table: Table, slots: np.ndarray, step: int = 0, at: int = 0
) -> np.ndarray:
    """The ids of a block of ``n``, from ``step`` on if states and stream place of a checkpoint are given."""
    lanes = min(LANES, n)
    words = np.frombuffer(stream, dtype="<u4").astype(np.uint64)
    state = np.frombuffer(states, dtype="<u8").astype(np.uint64)
    out = np.empty(max(0, n - step * lanes), dtype=np.int32)
    done = 0
    while done < len(out):
        size = min(lanes, len(out) - done)
        x = state[:size]
        slot = x & MASK
        symbol = slots[slot.astype(np.int64)]
        out[done : done + size] = symbol
        x = table.freq[symbol] * (x >> SCALE) + slot - table.start[symbol]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << WORD) | words[at : at + len(low)]
        at += len(low)
        state[:size] = x
        done += size
    return table.symbols[out]
