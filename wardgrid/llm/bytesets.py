"""Word shingles of UTF-8 texts as numpy arrays of 64-bit hashes, read straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: Random odd 64-bit value of each byte; A-Z share those of a-z.
BYTE_VALUE = _RNG.integers(0, 2 ** 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
BASE = U64(0x5851F42D4C957F2D)
BASE_INVERSE = U64(pow(0x5851F42D4C957F2D, -1, 2 ** 64))
WORD_FACTORS = _RNG.integers(0, 2 ** 63, 16, dtype=np.uint64) * U64(2) + U64(1)
BREAK = np.zeros(256, bool)
BREAK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes handled at once; longer texts are handled whole.
SLICE_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads each bit over all others."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slices of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_large_string(column.type):
        ends_type = np.int64
    else:
        ends_type = np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, ends_type)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + SLICE_BYTES, "right")) - 1)
        yield row, raw[ends[row]: ends[stop]], ends[row: stop + 1] - ends[row]
        row = stop


_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers below n; grown by doubling and kept."""
    global _POWERS, _INVERSES
    while len(_POWERS) < n:
        for name, base in (("_POWERS", BASE), ("_INVERSES", BASE_INVERSE)):
            have = globals()[name]
            with np.errstate(over="ignore"):
                globals()[name] = np.concatenate([have, have * (have[-1] * base)])
    return _POWERS, _INVERSES


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its k-word shingles; of fewer words, of all as one; without words, none."""
    for _, raw, ends in texts(column):
        n = len(raw)
        words_of = np.zeros(len(ends) - 1, np.int64)
        hashes = np.zeros(0, np.uint64)
        if n:
            word = ~BREAK[raw]
            first = np.empty(n, bool)
            first[0] = True
            first[1:] = ~word[:-1]
            first[ends[:-1][ends[:-1] < n]] = True
            last = np.empty(n, bool)
            last[-1] = True
            last[:-1] = ~word[1:]
            last[ends[1:][ends[1:] > 0] - 1] = True
            starts, stops = np.flatnonzero(word & first), np.flatnonzero(word & last) + 1
            powers, inverses = _powers(n + 1)
            with np.errstate(over="ignore"):
                total = np.zeros(n + 1, np.uint64)
                np.cumsum(BYTE_VALUE[raw] * powers[:n], out=total[1:])
                hashes = mixed((total[stops] - total[starts]) * inverses[starts] + (stops - starts).astype(np.uint64))
            bounds = np.searchsorted(starts, ends)
            words_of = np.diff(bounds)
        else:
            bounds = np.zeros(len(ends), np.int64)
        with np.errstate(over="ignore"):
            m = len(hashes) - k + 1
            grams = sum((hashes[j: j + m] * WORD_FACTORS[j] for j in range(k)), np.zeros(max(m, 0), np.uint64)) if m > 0 else hashes[:0]
            grams = mixed(grams)
            for i, count in enumerate(words_of):
                at = bounds[i]
                if count >= k:
                    yield np.unique(grams[at: at + count - k + 1])
                elif count:
                    yield mixed(np.array([(hashes[at: at + count] * WORD_FACTORS[:count]).sum(dtype=np.uint64)], np.uint64) + U64(count))
                else:
                    yield hashes[:0]
