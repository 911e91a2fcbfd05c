"""Vectorised text primitives shared by the corpus operators.

Everything works on whole Arrow buffers: the UTF-8 bytes of many rows lie behind each other, rows and words are
(start, end) offsets into them, so no Python loop runs per word or per byte. There are three hashes. `content_hashes`
tells pieces of text apart (words, short byte strings), `fingerprints` sequences of such hashes. `piece_hash`, from one
wrapping prefix sum modulo 2**64, is the quick one: it chooses anchors and finds candidates, and never decides alone.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
BASE_INV = pow(BASE, -1, 1 << 64)
CACHED = 1 << 22
#: Text bytes handled at once; bounds the temporary arrays of a Python worker.
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A fixed random-looking 64-bit value per byte.
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_POWERS = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64 (or those of its inverse), grown by doubling and cached up to CACHED."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        base = BASE_INV if inverse else BASE
        have, size = np.ones(1, np.uint64), 1
        while size < n:
            have = np.concatenate([have, have * np.uint64(pow(base, size, 1 << 64))])
            size *= 2
        if size <= CACHED:
            _POWERS[inverse] = have
    return have[:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of codes[t] * BASE**t for i <= t < j."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes)), out=out[1:])
    return out


def piece_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of codes[start:end] for each piece; equal pieces hash alike wherever they stand."""
    inv = powers(len(prefix), inverse=True)
    raw = (prefix[ends] - prefix[starts]) * inv[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def gram_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """piece_hash of the `size` codes from each place on."""
    inv = powers(len(prefix), inverse=True)
    raw = (prefix[size:] - prefix[:-size]) * inv[: len(prefix) - size]
    return mix(raw + np.uint64(size * 0xD6E8FEB86659FD93 & _MASK))


Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(scan: Scan) -> Scan:
    """The scan, with the memory it leaves unused given back at its end: workers stay alive between tasks."""

    @functools.wraps(scan)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library: its own policy holds

    return run


def mapped(frame: DataFrame, scan: Scan, schema: str) -> DataFrame:
    return frame.mapInArrow(lean(scan), schema)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null rows are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def row_slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `most` bytes (a longer row stands alone)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


#: Word characters by byte. SPACE: all but space and \t\n\v\f\r. ALNUM: [0-9a-z] and bytes of non-ASCII characters.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[32, 9, 10, 11, 12, 13]] = False
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends (into raw) of rows lying back to back, and the index of each row's first word (n+1 long).

    Words never cross a row's end.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    is_word = table[raw[base:end]]
    n = end - base
    starts = np.zeros(n, bool)
    ends = np.zeros(n + 1, bool)
    if n:
        starts[0] = is_word[0]
        starts[1:] = is_word[1:] & ~is_word[:-1]
        ends[1:n] = is_word[:-1] & ~is_word[1:]
        ends[n] = is_word[-1]
        cut = offsets[1:-1] - base
        cut = cut[(cut > 0) & (cut < n)]
        inside = cut[is_word[cut] & is_word[cut - 1]]
        starts[inside] = True
        ends[inside] = True
    s, e = np.flatnonzero(starts) + base, np.flatnonzero(ends) + base
    return s, e, np.searchsorted(s, offsets)


#: Pieces beyond so many bytes are hashed one by one.
LONG_PIECE = 128
_HEADS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def content_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of raw[start:end] for each piece. Eight bytes at a time go through a mixer that is not linear, so
    texts built to cancel out in a polynomial do not meet; pieces of one length up to eight bytes never do."""
    length = (ends - starts).astype(np.int64)
    out = mix(length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
    who = np.flatnonzero((length > 0) & (length <= LONG_PIECE))
    at, left = starts[who], length[who]
    while len(who):
        out[who] = mix(out[who] ^ (eight[at] & _HEADS[np.minimum(left, 8)])) * np.uint64(BASE)
        more = np.flatnonzero(left > 8)
        who, at, left = who[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > LONG_PIECE).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def word_hashes(raw: np.ndarray, base: int, end: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; long texts are taken in parts that begin and end with words."""
    if end - base <= 4 * SLICE_BYTES:
        return content_hashes(raw[base:end], starts - base, ends - base)
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE_BYTES)))
        low, high = int(starts[i]), int(ends[j - 1])
        out[i:j] = content_hashes(raw[low:high], starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words that begin at each position (the last size-1 positions have none), mixed word by word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n]
    for k in range(1, size):
        out = mix(out) + words[k : k + n]
    return mix(out + np.uint64(size))


#: A prime, and two places at which sequences are evaluated as polynomials modulo it.
PRIME = (1 << 31) - 1
PLACES = (1_205_712_277, 735_632_791)
_PRIME_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, or that plus a little: below 2**32 for x below 2**63."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = _folded(_folded(x))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def prime_powers(place: int, n: int, inverse: bool = False) -> np.ndarray:
    """place**0 .. place**(n-1) modulo PRIME, or those of its inverse."""
    have = _PRIME_POWERS.get((place, inverse))
    if have is None or len(have) < n:
        base = pow(place, -1, PRIME) if inverse else place
        have, size = np.ones(1, np.uint64), 1
        while size < n:
            have = np.concatenate([have, _reduced(have * np.uint64(pow(base, size, PRIME)))])
            size *= 2
        if size <= CACHED:
            _PRIME_POWERS[place, inverse] = have
    return have[:n]


def fingerprint_prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums (2, n+1) for `fingerprints`, one row per place; the places look at different bits of the codes."""
    out = np.zeros((2, len(codes) + 1), np.uint64)
    for row, place, shift in zip(out, PLACES, (33, 2), strict=True):
        np.cumsum(_folded(((codes >> np.uint64(shift)) & np.uint64(PRIME)) * prime_powers(place, len(codes))), out=row[1:])
    return out


def fingerprints(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62-bit Karp-Rabin fingerprint of codes[start:end] modulo a prime at two places: different sequences of L codes agree
    at one place with a probability of L / 2**31, whatever their structure, and at both with its square."""
    parts = []
    for row, place in zip(prefix, PLACES, strict=True):
        parts.append(_reduced(_reduced(row[ends] - row[starts]) * prime_powers(place, prefix.shape[1], inverse=True)[starts]))
    return mix(((parts[0] << np.uint64(31)) | parts[1]) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in values[s:s+width], for each s."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, low, have = np.arange(len(values)), values, 1
    while have < width:
        step = min(have, width - have)
        first = low[:-step] <= low[step:]
        at = np.where(first, at[:-step], at[step:])
        low = np.where(first, low[:-step], low[step:])
        have += step
    return at
