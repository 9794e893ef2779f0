"""Word shingles of many texts at once, as sorted sets of 64-bit hashes.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. All
arrays cover a slice of an Arrow column, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
SLICE_BYTES = 500_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PLACE = mix(np.arange(WORDS, dtype=np.uint64) + np.uint64(1_000)) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, 2 * SLICE_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        held = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of a string column of
    about ``SLICE_BYTES``; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = _SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    first, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, n), out=sums[1:])
    value = (sums[end] - sums[first]) * _power(_INVERSE, n)[first]
    return np.searchsorted(offsets, first, side="right") - 1, mix(value ^ mix((end - first).astype(np.uint64)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, sizes): the distinct shingles of every text, by
    document and hash, and their number per text. A text of fewer than
    ``WORDS`` words has one shingle, all of it; one without words has none."""
    m = len(offsets) - 1
    doc, word = _words(data, offsets)
    count = np.bincount(doc, minlength=m)
    docs, hashes = [], []
    if len(doc) >= WORDS:
        whole = np.flatnonzero(doc[:len(doc) - WORDS + 1] == doc[WORDS - 1:])
        docs.append(doc[whole])
        hashes.append(sum(word[whole + k] * _PLACE[k] for k in range(WORDS)))
    first = np.cumsum(count) - count
    for c in range(1, WORDS):
        short = np.flatnonzero(count == c)
        docs.append(short)
        hashes.append(sum(word[first[short] + k] * _PLACE[k] for k in range(c)) + np.uint64(c))
    doc, value = np.concatenate(docs), mix(np.concatenate(hashes))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return doc, value, np.bincount(doc, minlength=m)


def signatures(doc: np.ndarray, value: np.ndarray, m: int) -> np.ndarray:
    """A 64-bit signature per text: equal for equal sets."""
    out = np.zeros(m, np.uint64)
    if len(doc):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[first]] = np.add.reduceat(mix(value ^ np.uint64(_BASE)), first)
    return mix(out)
