"""Words and word hashes of whole texts, computed on the bytes of Arrow columns.

A word is a run of ASCII letters, digits and bytes above 127 (any other character); A-Z count
as a-z. Texts are never split into Python strings: word limits come from a byte table and
word hashes from running sums over the bytes, so the cost is a few array operations a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
U64 = np.uint64

_table = np.random.default_rng(2026)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[65:91] = IN_WORD[128:] = True
BYTE_VALUE = _table.integers(1, 2**63, 256, dtype=U64)[LOWER]
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
STEPS = (_table.integers(1, 2**63, 64, dtype=U64) << U64(1)) | U64(1)
MIN_XOR = _table.integers(0, 2**32, 1024, dtype=np.uint32)
MIN_TIMES = _table.integers(0, 2**31, 1024, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_up = _down = np.ones(1, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        _up, _down = _powers(BASE, n), _powers(BASE_INVERSE, n)
    return _up, _down


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """Words of some texts, one after the other. Text i has words first[i] to first[i + 1]."""

    start: np.ndarray  # byte offsets into ``data``
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray  # text i has bytes offsets[i] to offsets[i + 1]

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and where each text starts; missing texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = IN_WORD[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    opens[edges] = inside[edges]
    edges = offsets[1:][offsets[1:] > 0] - 1
    closes[edges] = inside[edges]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span; spans are sorted. Works through the bytes piece by piece."""
    out = np.empty(len(start), dtype=U64)
    done = 0
    while done < len(start):
        low = start[done]
        stop = max(int(np.searchsorted(end, low + 2 * PIECE_BYTES, "right")), done + 1)
        high = end[stop - 1]
        up, down = powers(int(high - low) + 1)
        sums = np.empty(high - low + 1, dtype=U64)
        sums[0] = 0
        np.cumsum(BYTE_VALUE[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = start[done:stop] - low, end[done:stop] - low
        out[done:stop] = (sums[e] - sums[s]) * down[s]
        done = stop
    return mixed(out)


def words_of(column: pa.Array) -> Words:
    data, offsets = text_bytes(column)
    start, end = word_spans(data, offsets)
    first = np.searchsorted(start, offsets)
    return Words(start, end, span_hashes(data, start, end), first, data, offsets)


def pieces(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each come to a megabyte, or to one long text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            stop = max(int(np.searchsorted(total, before + PIECE_BYTES, "right")), at + 1)
            yield batch.slice(at, stop - at)
            at = stop
    # Workers are used again: what one stage held must not add to what the next one needs.
    pa.default_memory_pool().release_unused()


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and where each text's runs start.

    A text with fewer words, but not none, has one run of all its words.
    """
    h, counts = words.hash, words.counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - words.first[:-1], n)
    out = np.zeros(len(at), dtype=U64)
    short = counts < size
    if not short.any():
        for j in range(size):
            out += h[at + j] * STEPS[j]
    else:
        length = np.repeat(np.minimum(counts, size), n)
        for j in range(size):
            has = length > j
            out[has] += h[at[has] + j] * STEPS[j]
    return mixed(out), first


def min_hashes(values: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHash values (the low 16 bits of each minimum) for every group of values.

    Groups without values get zeros.
    """
    out = np.zeros((len(first) - 1, count), dtype=np.uint16)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        low = (values >> U64(32)).astype(np.uint32)
        starts = first[full]
        for k in range(count):
            least = np.minimum.reduceat((low ^ MIN_XOR[k]) * MIN_TIMES[k], starts)
            out[full, k] = least.astype(np.uint16)
    return out


def group_hash(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash for the sequence of values of each group; empty groups get 0."""
    up, down = powers(len(values) + 1)
    sums = np.concatenate([[U64(0)], np.cumsum(mixed(values) * up[: len(values)])])
    return mixed((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]])


def least_in_run(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbouring values, by doubling."""
    out, reach = values, 1
    while reach < size:
        by = min(reach, size - reach)
        out = np.minimum(out[: len(out) - by], out[by:])
        reach += by
    return out
