"""Word shingles of texts as sets of 64-bit hashes, and their MinHash sketches, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240607)
#: A random number for each byte; capitals A to Z hash as their small letters.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BYTE[65:91] = _BYTE[97:123]
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = U(0x9E3779B97F4A7C15)
_UNBASE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LAG = [U(x | 1) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_MAX = U(0xFFFFFFFFFFFFFFFF)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_hashes(texts: list[memoryview]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words (lower-cased A to Z), and how many words each text has."""
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths + 1) - lengths  # where each text starts in raw
    gap = _GAP[raw]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    up, down = powers(len(raw))
    sums = np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)
    hashes = mix((sums[ends - 1] - sums[starts - 1]) * down[starts])
    first = np.searchsorted(starts, begins)
    return hashes, np.diff(np.append(first, len(starts)))


def shingle_sets(texts: list[memoryview], size: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted: runs of size words; with fewer words all of them, without any none."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    n = max(0, len(words) - size + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(size):
        runs += words[k : k + n] * _LAG[k]
    runs = mix(runs + U(size))
    for c in counts.tolist():
        if c >= size:
            out.append(np.unique(runs[at : at + c - size + 1]))
        elif c:
            out.append(mix(np.sum(words[at : at + c] * np.array(_LAG[:c]), dtype=np.uint64, keepdims=True) + U(c)))
        else:
            out.append(runs[:0])
        at += c
    return out


#: Rounds in which a shingle falls into a random bin; bins then still empty take the least of all shingles.
ROUNDS = 12


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of bins 16-bit values for each set; two sets agree in a bin with probability equal to their similarity.

    Fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017): in each round every shingle
    falls into one bin, and earlier rounds win, so that large sets need one or two rounds and
    small ones are still as even as with independent permutations. Empty sets give zeros.
    """
    out = np.full(len(sets) * bins, _MAX, np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    for r in range(ROUNDS):
        if not len(items):
            break
        g = mix(items ^ mix(np.array([r + 1], np.uint64)))
        np.minimum.at(out, row * bins + (g % U(bins)).astype(np.int64), (g >> U(8)) | (U(r) << U(56)))
        short = (out.reshape(-1, bins) == _MAX).any(axis=1)[row]
        items, row = items[short], row[short]
    if len(items):
        for d in np.unique(row).tolist():
            own, cells = sets[d], out[d * bins : (d + 1) * bins]
            empty = np.flatnonzero(cells == _MAX)
            seeds = mix((empty + ROUNDS + 1).astype(np.uint64))
            for part in range(0, len(empty), 64):
                cells[empty[part : part + 64]] = (mix(own[None, :] ^ seeds[part : part + 64, None]) >> U(8)).min(axis=1)
    out = (mix(out) >> U(48)).astype(np.uint16).reshape(-1, bins)
    out[sizes == 0] = 0
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the shared shingles reach percent times those of either set."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return bool(common) and 100 * common >= percent * (len(a) + len(b) - common)
