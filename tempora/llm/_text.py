"""Vectorised text primitives: one pass of NumPy over a buffer that holds many documents.

Documents are laid end to end in one byte buffer with a space between neighbours, so word runs never join two documents.

Hashes of runs are 64 bits: the length, then one round of a bijective mixer for every 8 bytes, so no structure of the bytes (such as a
Thue-Morse word, which fools polynomials modulo 2**64) leads to equal hashes.  Two different keys collide with probability about
2**-64; where that is not enough, equal_runs() compares the bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np

_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: The base of a second hash of the same grams.
STEP_TAG = np.uint64(0xC2B2AE3D27D4EB4F)
_CHUNK = 1 << 20
_SEED = 0x243F6A8885A308D3
#: Bytes of a run that are mixed piece by piece.
LONG = 2048
_POWERS: dict[str, np.ndarray] = {}

#: Words separated by ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, _CHUNK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[buf]


def runs(buf: np.ndarray, wordly: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes for which wordly holds."""
    flags = np.zeros(len(buf) + 2, np.int8)
    flags[1:-1] = wordly[buf]
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    return edges[0::2], edges[1::2]


def _pieces(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place of buf as a number (zeros past the end); an unaligned view of a copy."""
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), np.uint64, pad, 0, (1,))


def _first_bytes(pieces: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Pieces at these places, of which only the first `left` bytes count."""
    cut = ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)
    return (pieces[at] << cut) >> cut


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run, wherever it lies.  Runs over LONG bytes go through BLAKE2."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(_SEED))
    pieces = _pieces(buf)
    todo = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[todo], size[todo]
    while len(todo):
        out[todo] = mix(out[todo] ^ _first_bytes(pieces, at, left))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def equal_runs(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes of a from at_a equal those of b from at_b, for each entry."""
    out, pa, pb = np.ones(len(size), bool), _pieces(a), _pieces(b)
    todo = np.flatnonzero((size > 0) & (size <= LONG))
    i, j, left = at_a[todo], at_b[todo], size[todo]
    while len(todo):
        same = _first_bytes(pa, i, left) == _first_bytes(pb, j, left)
        out[todo[~same]] = False
        more = same & (left > 8)
        todo, i, j, left = todo[more], i[more] + 8, j[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = np.array_equal(a[at_a[k] : at_a[k] + size[k]], b[at_b[k] : at_b[k] + size[k]])
    return out


def gram_hashes(words: np.ndarray, k: int, step: np.uint64 = _STEP) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive word hashes (by position, across document borders as well)."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= step
        h += words[j : n + j]
    return mix(h)


def spans(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of each document's first word, and the number of words at the end."""
    return np.append(np.searchsorted(starts, offsets[:-1]), len(starts))
