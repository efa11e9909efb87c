"""Words of whole Arrow text columns, and their hashes, without a Python loop over words.

A column is read as its UTF-8 bytes. A word is a run of bytes other than space and 0x09-0x0D; no
word crosses from one text into the next. Hashes of spans come from prefix sums: with weights
p^i modulo 2^64 (p odd, so it has an inverse) the sum over a span, times p^-start, does not depend
on where the span stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))
_weights: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(prime: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _weights.get(prime)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(prime, -1, 1 << 64)
        have = tuple(
            np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, p, U), dtype=U)]) for p in (prime, inverse)
        )
        if size <= 1 << 21:
            _weights[prime] = have
    return have


def forget() -> None:
    """The weights that this process has worked out."""
    _weights.clear()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, prime: int = _PRIME) -> np.ndarray:
    """A 64-bit hash of every span values[start:end], its length included."""
    n = len(values)
    up, down = _powers(prime, n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(values * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


class Words:
    """The words of some texts: byte spans, the text each belongs to, and the first word of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.data, self.bounds = (_LOWER[data] if lower else data), bounds
        n = len(data)
        inside = ~_SEPARATOR[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        full = bounds[1:] > bounds[:-1]
        first, last = bounds[:-1][full], bounds[1:][full] - 1
        begins[first] = inside[first]
        stops[last] = inside[last]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.text = np.searchsorted(bounds, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, bounds)
        self.first[-1] = len(self.starts)
        assert n == 0 or len(self.starts) == len(self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(_BYTE_VALUE[self.data], self.starts, self.ends)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of every run of k words; a text of fewer words is one run."""
        n = len(self)
        counts = np.diff(self.first)
        runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        text = np.repeat(np.arange(len(counts)), runs)
        place = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
        starts = self.first[:-1][text] + place
        ends = np.minimum(starts + k, self.first[1:][text])
        return span_hashes(self.hashes(), starts, ends) if n else np.zeros(0, U), text


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text bounds of a string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about `most` bytes; a longer text makes a run of its own."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, j
        i = j


def distinct_per_text(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value), by text and value."""
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], text[new]
