"""UTF-8 text columns of Arrow batches as numpy bytes, in blocks of bounded size."""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

#: Whitespace is 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: ASCII letters and digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def whole_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its row offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes, or one longer row: first row, end row, bytes, offsets from 0."""
    data, offsets = whole_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, BASE, np.uint64)
    up[0] = 1
    down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling-hash base and of its inverse, modulo 2**64."""
    if size <= BLOCK_BYTES + 2:
        return _powers(BLOCK_BYTES + 2)
    return _powers.__wrapped__(size)


#: A scrambled value for each byte, so that sums of neighbouring byte values do not cancel out.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hashes`` reads the hash of any span."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes give equal hashes wherever they stand.

    Made for features and for spans of a few hundred bytes: texts of 1,024 bytes or more can be written so that they collide.
    Where that would matter, ``keyed_spans`` is used.
    """
    _, down = powers(len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: The modulus of keyed hashes, a prime: two texts collide for at most as many bases as they have letters.
PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30, _LOW32 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64((1 << 32) - 1)


def random_base() -> int:
    """A base for keyed hashes that nobody knows beforehand; hashes of one base can be compared wherever they were made."""
    return secrets.randbelow(PRIME - (1 << 32)) + (1 << 32)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b) -> np.ndarray:
    """Products modulo ``PRIME`` of numbers below it."""
    b = np.asarray(b, np.uint64)
    au, al, bu, bl = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    mid = au * bl + al * bu
    return _reduced((au * bu << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & _LOW30) << np.uint64(31)) + al * bl)


def _raised(base: int, size: int) -> np.ndarray:
    out = np.ones(max(1, size), np.uint64)
    n = 1
    while n < size:
        more = min(n, size - n)
        out[n : n + more] = times(out[:more], pow(base, n, PRIME))
        n += more
    return out


@lru_cache(maxsize=8)
def _kept_powers(base: int, size: int) -> np.ndarray:
    return _raised(base, size)


def _powers_of(base: int, size: int) -> np.ndarray:
    return _kept_powers(base, BLOCK_BYTES + 2)[:size] if size <= BLOCK_BYTES + 2 else _raised(base, size)


def keyed_prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums modulo ``PRIME`` of whole numbers from 1 below it, times the powers of a base."""
    terms = times(values, _powers_of(base, len(values))[: len(values)]) if len(values) else np.zeros(0, np.uint64)
    out = np.zeros(len(values) + 1, np.uint64)
    high, low = np.cumsum(terms >> np.uint64(32)), np.cumsum(terms & _LOW32)
    out[1:] = _reduced(times(_reduced(high), 1 << 32) + _reduced(low))
    return out


def keyed_spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes below 2**61 of the spans: equal values give equal hashes wherever they stand, others hardly ever, whoever wrote them."""
    return times(_reduced(prefix[ends] + (_P - prefix[starts])), _powers_of(pow(base, -1, PRIME), len(prefix))[starts])


#: Bytes as numbers from 1, so that no letter is nothing.
LETTERS = np.arange(1, 257, dtype=np.uint64)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes for which ``inside`` holds; runs end at row ends."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    within = inside[data]
    before = np.zeros(len(data), bool)
    before[1:] = within[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = within[1:]
    starts = np.flatnonzero(within & (~before | edge[:-1]))
    ends = np.flatnonzero(within & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
