"""Words of whole texts as 64-bit hashes, a block of texts at a time in numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.  A
word's hash is a polynomial over a table of random 64-bit numbers, finished by
a bijective mixer; two of n different words share one with a probability of
about n * n / 2**59.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are taken together, and those that are hashed at once: parts of them, cut between words.
BLOCK, PART = 2 << 20, 256 << 10

_RNG = np.random.Generator(np.random.PCG64(7))
_TABLE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_TABLE[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = _powers(_BASE, n), _powers(_INVERSE, n)
    return _UP, _DOWN


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    raw = np.frombuffer(data, np.uint8)
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = _GAP[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[: len(raw)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def _parts(data: bytes) -> Iterator[bytes]:
    """A text in parts of about `PART` bytes, cut at gaps."""
    at = 0
    while len(data) - at > PART:
        end = at + PART
        while end < len(data) and not _GAP[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    hashes, starts, at = [], [], 0
    for part in _parts(b"\n".join(texts)):
        found, places = _hashed(part)
        hashes.append(found)
        starts.append(places + at)
        at += len(part)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), begins))


def blocks(texts: Iterable[pa.Scalar]) -> Iterator[list[bytes]]:
    """Texts as UTF-8, nulls as empty, in lists of about `BLOCK` bytes; each longer one alone."""
    block: list[bytes] = []
    size = 0
    for value in texts:
        text = value.as_py()
        data = text.encode() if isinstance(text, str) else (text or b"")
        if block and size + len(data) > BLOCK:
            yield block
            block, size = [], 0
        block.append(data)
        size += len(data) + 1
    if block:
        yield block
