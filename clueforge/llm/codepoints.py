"""Whole batches of texts as one code point array, and rolling hashes of all their windows."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts in a row, start of each text and the end of the last)."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), starts


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=8)
def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def window_hashes(chars: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Rabin-Karp hash (modulo 2**64, mixed code points) of each window of `width`; one value for each start.

    Windows are put together from those of half the width, so the cost is a few array operations a doubling. The
    result has len(chars) - width + 1 values; windows across two texts are the caller's to ignore.
    """
    n = len(chars) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power = mix(chars.astype(np.uint64) + np.uint64((seed * 0x632BE59BD9B4E019 + 0x1234567) % (1 << 64)))
        span, done, out = 1, 0, None
        while True:
            if width & span:
                if out is None:
                    out = power[:n].copy() if span == width else power
                else:
                    m = len(chars) - (done + span) + 1
                    out = out[:m] * _power(span) + power[done : done + m]
                done += span
            if done == width:
                return out[:n]
            power = power[:-span] * _power(span) + power[span:]
            span *= 2


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each window of `width` values, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def inside(starts: np.ndarray, total: int, width: int) -> np.ndarray:
    """For each window start, whether the window stays within one text."""
    ok = np.ones(max(total - width + 1, 0), bool)
    for s in starts[1:-1]:
        ok[max(s - width + 1, 0) : s] = False
    return ok


@functools.lru_cache(maxsize=1)
def plain_table() -> np.ndarray:
    """Code point to its lower-case, half-width form if it is a letter or digit, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.east_asian_width(ch) in "FH":
            ch = unicodedata.normalize("NFKC", ch)[:1]
        if unicodedata.category(ch)[0] == "L" or unicodedata.category(ch) == "Nd":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else ord(ch)
    return out


def plain(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters and digits in their plain form, index of each in chars)."""
    mapped = plain_table()[chars]
    at = np.flatnonzero(mapped)
    return mapped[at], at
