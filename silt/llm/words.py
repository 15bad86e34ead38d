"""Vectorised word splitting and hashing over Arrow string columns.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D).
UTF-8 never uses those bytes inside a longer character, so bytes give the same words
as code points. Hashes depend on the bytes of a word alone: every executor gives a
word the same name, which is what makes names global without a dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (a longer single text is handled alone).
SLICE_BYTES = 1 << 19

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x + _U((salt * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=_U), 7)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, SLICE_BYTES + 1), base & (2**64 - 1), _U)
        p[0] = 1
        have = _powers[base] = np.multiply.accumulate(p)
    return have[:n]


class Words(NamedTuple):
    """The words of a run of texts, in order."""

    data: np.ndarray  # uint8, all texts' bytes
    start: np.ndarray  # per word: first byte in data
    end: np.ndarray  # per word: byte after it
    first: np.ndarray  # per text: its first word; one more at the end
    doc: np.ndarray  # per word: the text's index


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one longer row."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, len(texts))
        a = min(b, len(texts))


def as_utf8(column: pa.Array) -> pa.Array:
    """A plain string array with nulls made empty."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes unchanged."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def split(texts: pa.Array, a: int = 0, b: int | None = None, lower: bool = False, breaks: np.ndarray = _SPACE) -> Words:
    """Words of rows a..b, parted by the bytes that ``breaks`` marks; empty texts have none."""
    b = len(texts) if b is None else b
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset + a : texts.offset + b + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    if lower:
        data = lower_ascii(data)
    offsets = offsets - offsets[0]
    solid = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, first, np.repeat(np.arange(b - a), np.diff(first)))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    n = len(w.data)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[w.data] * powers(_ODD, n), out=sums[1:])
    h = (sums[w.end] - sums[w.start]) * powers(_INV, n + 1)[w.start]
    return mix(h, 3) ^ (w.end - w.start).astype(_U)


def window_hashes(h: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive values of ``h``."""
    n = len(h)
    if n < width:
        return np.zeros(0, _U)
    sums = np.zeros(n + 1, _U)
    odd = (_ODD * (2 * salt + 1)) & (2**64 - 1)
    np.cumsum(mix(h, salt) * powers(odd, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(pow(odd, -1, 1 << 64), n)[: n - width + 1], salt)
