"""Byte n-grams of many texts at once, as numbers."""

from __future__ import annotations

import numpy as np

#: Letters lower-cased; other ASCII characters separate words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def fold(text: str) -> bytes:
    """Words in lower case between single spaces, a space at both ends; empty without words."""
    words = text.lower().encode().translate(_FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b""


def join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (with the end as last)."""
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def grams(flat: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the n-grams (n up to 7) that lie in one text, and each text's first place among them."""
    size = np.maximum(np.diff(bounds) - (n - 1), 0)
    starts = np.cumsum([0, *size])
    if not starts[-1]:
        return np.zeros(0, np.uint64), starts
    code = np.full(len(flat) - n + 1, n, np.uint64)
    for k in range(n):
        code <<= np.uint64(8)
        code |= flat[k : len(flat) - n + 1 + k]
    inside = np.ones(len(code), bool)
    for k in range(1, n):
        ends = bounds[1:-1] - k
        inside[ends[(ends >= 0) & (ends < len(code))]] = False
    return code[inside], starts


def mixed(code: np.ndarray, turn: int) -> np.ndarray:
    """A hash of the codes, another one for each turn."""
    x = (code + np.uint64(turn)) * _ODD
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over each text's values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)])
    return total[starts[1:]] - total[starts[:-1]]
