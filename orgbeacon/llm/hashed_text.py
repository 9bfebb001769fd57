"""Hashed character sequences of whole texts, as bounded vectors; the features of language identification."""

from __future__ import annotations

import numpy as np

from orgbeacon.llm.shared import byte_table

#: All bytes count; A-Z are read as a-z.
CHARS = byte_table(b"", fold=True)
_ROUNDS = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def hashed_grams(data: np.ndarray, offsets: np.ndarray, order: int, bins: int, table: np.ndarray = CHARS) -> np.ndarray:
    """Counts of the hashed byte sequences of 1 .. ``order`` bytes of every text: (texts, bins), bins a power of two."""
    out = np.zeros((len(offsets) - 1, bins), np.float32)
    values = table[data]
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        for at in range(a, b, 1 << 20):  # a very long text goes by pieces that overlap
            piece = values[at : min(b, at + (1 << 20) + order - 1)]
            rolling = np.zeros(len(piece), np.uint64)
            for k in range(order):
                rolling = rolling[: len(piece) - k] + piece[k:] * _ROUNDS[k]
                n = min(len(rolling), 1 << 20)
                if n > 0:
                    cell = (rolling[:n] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) >> np.uint64(64 - bins.bit_length() + 1)
                    out[i] += np.bincount(cell.astype(np.int64), minlength=bins)
    return out


def damped(counts: np.ndarray) -> np.ndarray:
    """Square roots, to unit length."""
    out = np.sqrt(counts)
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(size, 1e-9)
