"""Vectorised UTF-8 word handling over Arrow string columns.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, which are ASCII, so
byte work is exact on UTF-8.  Word hashes are 64-bit polynomial hashes over a
random byte table, taken from one prefix sum per block and finished with a
mixer; no loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

BLOCK_BYTES = 2 << 20
U64 = np.uint64
_Q = 0x9E3779B97F4A7C15 | 1
_QINV = pow(_Q, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(_Q))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("q", ())) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for name, base in (("q", _Q), ("inv", _QINV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=U64)
    return _POWERS["q"], _POWERS["inv"]


def blocks(column: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about ``most`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def pieces(data: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """A long text in runs of about ``most`` bytes that end at white space, so no word is cut."""
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data):
            gap = np.flatnonzero(SPACE[data[end : end + most]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + most, len(data))
        yield data[at:end]
        at = end


@dataclass
class Words:
    """Words of the documents of a block; ``first[d]:first[d + 1]`` are those of document d."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    _sums: dict = field(default_factory=dict)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans."""
        if "s" not in self._sums:
            q, _ = _powers(len(self.data) + 1)
            s = np.empty(len(self.data) + 1, U64)
            s[0] = 0
            np.cumsum(_TABLE[self.data] * q[: len(self.data)], out=s[1:])
            self._sums["s"] = s
        s, inv = self._sums["s"], _powers(len(self.data) + 1)[1]
        return mix((s[ends] - s[starts]) * inv[starts])

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        cuts = offsets[1:-1]
        before[cuts[cuts < len(data)]] = False
        after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return Words(data, offsets, starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets))


def per_doc(counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``counts`` between consecutive offsets; empty spans give 0."""
    total = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


_C = zstandard.ZstdCompressor(level=1)
_D = zstandard.ZstdDecompressor()


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """An integer array as compressed byte planes; ``delta`` suits sorted values."""
    if delta and len(values):
        values = np.concatenate([values[:1], values[1:] - values[:-1]])
    values = np.ascontiguousarray(values)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return values.dtype.char.encode() + _C.compress(planes.tobytes())


def unpack(packed: bytes, delta: bool = False) -> np.ndarray:
    kind = np.dtype(packed[:1].decode())
    raw = np.frombuffer(_D.decompress(packed[1:]), np.uint8)
    values = np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if delta and len(values) else values
