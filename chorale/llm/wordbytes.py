"""Words and byte n-grams of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A stable 64-bit number for each byte, and the odd base of the rolling hash (fixed values: any odd base serves).
_BYTE = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (shift, xor, multiply)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def slices(texts: pa.Array, size: int = 1 << 21):
    """Runs of consecutive texts, (first, last), of about ``size`` bytes each; a longer text is a run of its own."""
    first, total = 0, 0
    lengths = pc.binary_length(texts).to_pylist() if len(texts) else []
    for i, n in enumerate(lengths):
        if total and total + (n or 0) > size:
            yield first, i
            first, total = i, 0
        total += n or 0
    if first < len(lengths):
        yield first, len(lengths)


def joined(texts: list[str | None], lead: bytes, tail: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) bytes of ``lead + text + tail`` one after another, and where each text starts and ends."""
    raw = [(t or "").encode() for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    step = lengths + len(lead) + len(tail)
    starts = np.cumsum(step) - step + len(lead)
    data = np.frombuffer(b"".join(x for r in raw for x in (lead, r, tail)), np.uint8)
    return _LOWER[data], starts, starts + lengths


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in the bytes, and the positions where the words start."""
    space = np.concatenate(([True], _SPACE[data], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(len(data), _BASE), dtype=np.uint64)))
    value = (total[ends] - total[starts]) * _powers(len(data) + 1, _INVERSE)[starts]
    return mix64(value + (ends - starts).astype(np.uint64)), starts


def per_text(positions: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of the text that holds each position."""
    return np.searchsorted(starts, positions, side="right") - 1
