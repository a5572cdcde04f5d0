"""Words of whole batches of texts as NumPy arrays: byte spans and 64-bit hashes.

Words are runs of bytes other than space and \\x09-\\x0D. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text is handled alone.
BYTES = 500_000
#: Bytes, or words, that are hashed in one go.
PART = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i for i < n."""
    inverse = pow(base, -1, 2**64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= PART:
        return _powers(base, PART)
    return _powers.__wrapped__(base, n)  # for once


class Words:
    """The words of some texts: starts and ends in ``data``; text i has words[first[i]:first[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = ~_SPACE[data]
        begin, last = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        full = offsets[:-1] < offsets[1:]
        at = offsets[:-1][full]
        begin[at] = solid[at]
        at = offsets[1:][full] - 1
        last[at] = solid[at]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``lower``: of the word with A-Z in lower case."""
        return self.run_hashes(self.starts, self.ends, lower)

    def run_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each run of bytes, which follow one another. It doesn't depend on the place, so long data are done in parts."""
        values, out, i = _BYTE_VALUES[LOWER] if lower else _BYTE_VALUES, np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + PART, "right")))
            own = self.data[starts[i] : ends[j - 1]]
            up, down = powers(_BASE, len(own))
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(values[own] * up[: len(own)], out=sums[1:])
            a, b = starts[i:j] - starts[i], ends[i:j] - starts[i]
            out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
            i = j
        return out


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive values, at the place of the first (also across texts)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    values = words if not seed else mix(words + np.uint64(seed))
    step = max(PART - n + 1, n)
    parts = []
    for i in range(0, len(words) - n + 1, step):
        own = values[i : i + step + n - 1]
        up, down = powers(_WORD_BASE, len(own))
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * up[: len(own)], out=sums[1:])
        parts.append(mix((sums[n:] - sums[:-n]) * down[: len(own) - n + 1]))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def gram_counts(first: np.ndarray, n: int) -> np.ndarray:
    """Grams of n words that each text has."""
    return np.maximum(0, np.diff(first) - n + 1)


def text_blocks(column: pa.Array, most: int = BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, data, offsets) of consecutive texts of a string column, at most ``rows`` at a time; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1), i + rows)
        yield i, j, data[bounds[i] : bounds[j]], (bounds[i : j + 1] - bounds[i])
        i = j
