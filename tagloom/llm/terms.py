"""Terms of texts: maximal runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII.

Every byte of a character beyond ASCII belongs to a term, so terms are found on UTF-8
bytes. A term is known by a 64-bit hash of its lower-cased bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import _BYTE, _LOWER, CHUNK_BYTES, _powers, buffers, mix64

_TERM = np.zeros(256, bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_VALUE = np.where(_TERM, _BYTE[_LOWER], np.uint64(0))
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass
class Terms:
    """Terms of consecutive texts: hashes, places in data, and where each text's terms begin (one more at the end)."""

    first: int
    data: np.ndarray
    hashes: np.ndarray
    at: np.ndarray
    end: np.ndarray
    bounds: np.ndarray


def _found(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, beginnings and ends of the terms of consecutive texts that begin at starts."""
    n = len(data)
    inside = _TERM[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cut = starts[(starts > 0) & (starts < n)]
    opens[cut] = inside[cut]
    closes[cut - 1] = inside[cut - 1]
    at = np.flatnonzero(opens)
    if not len(at):
        return np.zeros(0, np.uint64), at, at
    powers, inverses = _powers(n)
    value = _VALUE[data]
    value *= powers[:n]
    hashes = np.add.reduceat(value, at)
    hashes *= inverses[at]
    return mix64(hashes), at, np.flatnonzero(closes) + 1


def terms(texts: pa.Array) -> Iterator[Terms]:
    """Terms of runs of consecutive texts of CHUNK_BYTES at most; a longer text is a run of its own, hashed piece by piece."""
    data, off = buffers(texts)
    i, n = 0, len(off) - 1
    with np.errstate(over="ignore"):
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
            own = data[off[i] : off[j]]
            if len(own) <= CHUNK_BYTES:
                starts = off[i : j + 1] - off[i]
                hashes, at, end = _found(own, starts[:-1])
            else:
                parts, a = [], 0
                while a < len(own):
                    b = min(len(own), a + CHUNK_BYTES)
                    while b < len(own) and _TERM[own[b]] and _TERM[own[b - 1]]:
                        gap = np.flatnonzero(~_TERM[own[b : b + CHUNK_BYTES]])
                        b = b + int(gap[0]) if len(gap) else min(len(own), b + CHUNK_BYTES)
                    h, s, e = _found(own[a:b], np.zeros(0, np.int64))
                    parts.append((h, s + a, e + a))
                    a = b
                hashes, at, end = (np.concatenate(x) for x in zip(*parts, strict=True))
                starts = np.array([0, len(own)])
            yield Terms(i, own, hashes, at, end, np.append(np.searchsorted(at, starts[:-1]), len(at)))
            i = j
