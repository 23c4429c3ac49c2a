"""Words of many texts at once: numpy over the value buffer of an Arrow string column.

A word hash is a polynomial over its bytes modulo 2**64 with a random table for bytes, mixed at the end.
All functions take whole texts; chunks end between texts, never inside one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

R = 0x9E3779B97F4A7C15 | 5
R_INV = pow(R, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}


def splitmix(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values of a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    got = _POW.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 21)
        got = np.empty(size, np.uint64)
        got[0] = 1
        done, step = 1, base
        with np.errstate(over="ignore"):
            while done < size:  # by doubling
                k = min(done, size - done)
                got[done : done + k] = got[:k] * np.uint64(pow(base, done, 1 << 64))
                done += k
        _POW[base] = got
    return got[:n]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]: every byte but blank, tab, line feed, vertical tab, form feed and return.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z: digits, letters and all above ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True
BYTE_VALUES = splitmix(77, 256)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def trim() -> None:
    """Gives what earlier batches freed back to the system, as workers live on for further tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def chunks(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about limit bytes: first row, row after the last, bytes, offsets."""
    data, offs = buffer_of(column)
    row, n = 0, len(offs) - 1
    if n:
        trim()
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offs: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the count of words up to each row (one more than rows)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    mask = alphabet[data]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))]
    first[inner] = mask[inner]  # a text's first byte begins a word
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    last[inner - 1] = mask[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_sums(data: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """Running polynomial sums, one more than bytes; fold maps bytes first."""
    table = BYTE_VALUES if fold is None else BYTE_VALUES[fold]
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(table[data] * powers(R, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair."""
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * powers(R_INV, len(sums))[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offs: np.ndarray, alphabet: np.ndarray, fold: np.ndarray | None = LOWER):
    """Hash of every word (folded), starts, ends, and words up to each row."""
    starts, ends, upto = words(data, offs, alphabet)
    return span_hashes(prefix_sums(data, fold), starts, ends), starts, ends, upto


#: Weights of the positions in a run of words.
_RUN = splitmix(1234, 64) | np.uint64(1)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i .. i+k-1 for each i, also across rows; the caller leaves those out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n] * _RUN[0]
        for j in range(1, k):
            out += h[j : j + n] * _RUN[j]
    return mix(out)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each row, the sorted distinct hashes of its k-word shingles: lower-cased words of SPACED. A row of
    fewer words has one shingle of them all; without words none."""
    h, _, _, upto = word_hashes(data, offs, SPACED)
    runs = run_hashes(h, k)
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix(np.array([(h[a:b] * _RUN[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
