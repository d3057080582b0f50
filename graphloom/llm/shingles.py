"""Word shingles as 64-bit fingerprints and their MinHash signatures, in numpy.

A text's words (runs of other than ASCII white space, A-Z lower-cased) are joined by single spaces; a running sum of
table[byte] * P^place (modulo 2^64) gives every shingle's fingerprint as one difference, times P^-first, mixed.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
COORDINATES = 64
_P = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_TABLE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_SEEDS = _mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_MULTIPLY, _ADD = _SEEDS[:COORDINATES] | np.uint64(1), _SEEDS[COORDINATES:]
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_P, -1, 1 << 64)
        _powers[:] = []
        for base in (_P, inverse):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' fingerprints, sorted; a text of fewer words is one shingle; without words empty."""
    own = (text or "").encode("utf-8", "replace").lower().split()
    if not own:
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(b" ".join(own), dtype=np.uint8)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    gaps = np.flatnonzero(data == 32)
    first, last = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    n = min(words, len(own))
    first, last = first[: len(first) - n + 1], last[n - 1 :]
    return np.unique(_mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))


def signature(found: np.ndarray) -> np.ndarray:
    """The least of each coordinate's hash over the set, as 32-bit values; found is not empty."""
    out = np.empty(COORDINATES, dtype=np.uint64)
    for k in range(COORDINATES):
        out[k] = (found * _MULTIPLY[k] + _ADD[k] >> np.uint64(16)).min()
    return (_mix(out) >> np.uint64(32)).astype(np.uint32).view(np.int32)
