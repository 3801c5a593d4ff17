"""Hashed features of whole texts, computed on their bytes with numpy: no language, source or id goes in."""

from __future__ import annotations

import numpy as np

#: Buckets of byte trigrams, of runs of character classes, and of repeated words, side by side.
TRIGRAMS, CLASSES, REPEATS = 512, 1024, 8
WIDTH = TRIGRAMS + CLASSES + REPEATS

_CLASS = np.full(256, 7, dtype=np.int64)  # other visible bytes
_CLASS[list(b" \t\x0b\x0c\r")] = 0
_CLASS[ord("\n")] = 1
_CLASS[list(range(97, 123))] = 2
_CLASS[list(range(65, 91))] = 3
_CLASS[list(range(48, 58))] = 4
_CLASS[list(b".,;:'\"-()")] = 5
_CLASS[list(b"!?")] = 6
_CLASS[128:] = 8
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32


def counts(text: str) -> np.ndarray:
    """Feature counts of one text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out = np.zeros(WIDTH, dtype=np.float32)
    if len(raw) < 4:
        out[: len(raw)] = 1
        return out
    low = _LOWER[raw]
    tri = low[:-2] * 65_599 + low[1:-1] * 263 + low[2:]
    out[:TRIGRAMS] = np.bincount(tri * 2_654_435_761 % 4_294_967_291 % TRIGRAMS, minlength=TRIGRAMS)
    kind = _CLASS[raw]
    change = np.flatnonzero(np.diff(kind)) + 1  # runs of one class, their length damped to three steps
    start = np.concatenate([[0], change])
    length = np.diff(np.append(start, len(raw)))
    run = kind[start] * 3 + np.minimum(length - 1, 2)
    if len(run) >= 3:
        three = (run[:-2] * 27 + run[1:-1]) * 27 + run[2:]
        out[TRIGRAMS : TRIGRAMS + CLASSES] = np.bincount(three * 40_503 % 65_521 % CLASSES, minlength=CLASSES)
    words = text.split()
    n = len(words)
    if n > 1:
        out[-REPEATS] = n - len(set(words))
        out[-REPEATS + 1] = sum(a == b for a, b in zip(words, words[1:], strict=False))
        out[-REPEATS + 2] = n
        pairs = list(zip(words, words[1:], words[2:], strict=False))
        out[-REPEATS + 3] = len(pairs) - len(set(pairs))
    return out


def vectors(texts: list[str]) -> np.ndarray:
    """Damped counts: each block of unit length; repeats as shares of the words, weighted to matter beside the blocks."""
    v = np.stack([counts(t) for t in texts]) if len(texts) else np.zeros((0, WIDTH), dtype=np.float32)
    for block in (slice(0, TRIGRAMS), slice(TRIGRAMS, TRIGRAMS + CLASSES)):
        part = np.sqrt(v[:, block])
        v[:, block] = part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    n = np.maximum(v[:, -REPEATS + 2], 1)
    for k in (0, 1, 3):
        v[:, -REPEATS + k] /= n
    v[:, -REPEATS + 2] = 0
    return v
