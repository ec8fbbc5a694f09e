"""Hashed word shingles of whole texts, vectorised over many documents."""

from __future__ import annotations

import numpy as np

#: Bytes of text hashed together.
BLOCK = 1 << 20
_rng = np.random.default_rng(20240)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, _BASE))])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all white-space words, and the words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    per_text = np.diff(np.append(np.searchsorted(starts, begin), len(starts)))
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    values = _BYTE[data[starts[0] :]] * _power(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(values, starts - starts[0])), per_text


def shingle_sets(texts: list[str], words: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its `words`-word shingles; with
    fewer words the whole sequence is one, without words the set is empty.
    A-Z count as lower case."""
    out: list[np.ndarray] = []
    block: list[bytes] = []
    held = 0
    for t in texts:
        block.append(t.encode("utf-8", "replace").lower())
        held += len(block[-1])
        if held >= BLOCK:
            out += _sets(block, words)
            block, held = [], 0
    return out + (_sets(block, words) if block else [])


def _sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    h, n = word_hashes(texts)
    joined = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        joined = joined * _STEP + h[k : len(h) - words + 1 + k]
    joined = mix(joined)
    out, at = [], 0
    for k in n.tolist():
        if k >= words:
            out.append(np.unique(joined[at : at + k - words + 1]))
        elif k:
            x = np.uint64(k)
            with np.errstate(over="ignore"):
                for w in h[at : at + k]:
                    x = x * _STEP + w
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out
