"""Vectorised byte kernels shared by the text operators.

All of them work on a whole Arrow batch of texts at once: one flat UTF-8 byte array plus
document offsets, so the cost is a few NumPy passes per byte and no Python loop over words.
Batches are cut to ``MAX_BYTES`` first (one longer document makes a batch of its own), which
bounds the memory of a worker by that size or by its longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAX_BYTES = 1_000_000
U64 = np.uint64

_rng = np.random.default_rng(20240229)
#: One random 64-bit value for each byte; the fingerprint of a gram is a polynomial in these.
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64)
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INV = U64(pow(int(BASE), -1, 2**64))
#: A random value for each byte at each of a word's first places; a word's hash is the sum of its bytes' values.
PLACES = 32
PLACE_CODE = _rng.integers(0, 2**64, (PLACES, 256), dtype=U64)
#: A prime modulus for hashes of runs that begin anywhere, with their bases.
PRIME = (1 << 61) - 1
RUN_BASES = tuple(int(x) for x in _rng.integers(2**32, PRIME - 1, 2))
#: Multipliers of the words of a shingle.
WORD_CODE = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U64) | U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * MAX_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the offset of each (one more than texts). Null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = MAX_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most `limit` bytes of text each."""
    if not batch.num_rows:
        return
    _, o = flat(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(o, o[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def prefix_hash(b: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """P with P[j] - P[i] == base**i * (hash of b[i:j])."""
    p = np.zeros(len(b) + 1, U64)
    np.cumsum(BYTE_CODE[b] * powers(base, len(b)), out=p[1:])
    return p


def _word_edges(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a document's edge ends a word."""
    word = ~IS_SPACE[b]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = o[1:-1][o[1:-1] < len(b)]
    first[edges] |= word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = edges[edges > 0] - 1
    last[inner] |= word[inner]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_starts(b: np.ndarray, o: np.ndarray) -> np.ndarray:
    return _word_edges(b, o)[0]


def word_hashes(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word in order, and for each document the offset of its first word (one more than documents).

    A word's hash sums a value of (place, byte) for each byte, drawn at random for the first PLACES and mixed beyond; no
    algebra between places lets chosen words cancel, as it does in a polynomial modulo 2**64.
    """
    starts, ends = _word_edges(b, o)
    low, n = LOWER[b], ends - starts
    h = n.astype(U64)
    live, at = np.arange(len(starts)), starts
    for place in range(PLACES):
        h[live] += PLACE_CODE[place][low[at]]
        more = n[live] > place + 1
        live, at = live[more], at[more] + 1
        if not len(live):
            break
    if len(live):
        rest = n[live] - PLACES
        place = ranges(np.full(len(live), PLACES), rest).astype(U64)
        value = mix(mix(place * BASE) ^ BYTE_CODE[low[ranges(at, rest)]])
        h[live] += np.add.reduceat(value, ragged(rest)[:-1])
    return mix(h), np.searchsorted(starts, o)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y modulo PRIME, for values below it."""
    low, half = U64((1 << 32) - 1), U64(32)
    x1, x0, y1, y0 = x >> half, x & low, y >> half, y & low
    mid = x1 * y0 + x0 * y1
    out = (x1 * y1 << U64(3)) + (mid >> U64(29)) + ((mid & U64((1 << 29) - 1)) << half)
    small = x0 * y0
    out = (out & U64(PRIME)) + (out >> U64(61)) + (small & U64(PRIME)) + (small >> U64(61))
    out = (out & U64(PRIME)) + (out >> U64(61))
    return np.where(out >= U64(PRIME), out - U64(PRIME), out)


_prime_powers: dict[int, np.ndarray] = {}


def prime_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo PRIME."""
    have = _prime_powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate([have, times(have, np.full(len(have), pow(base, len(have), PRIME), U64))])
        if n <= 2 * MAX_BYTES:
            _prime_powers[base] = have
    return have[:n]


def run_hashes(x: np.ndarray, i: np.ndarray, j: np.ndarray, base: int) -> np.ndarray:
    """Hash modulo PRIME of x[i:j] for each pair, whatever i: a polynomial in a random base."""
    x = x & U64((1 << 60) - 1)
    term = times(x, prime_powers(base, len(x)))
    high, low = np.zeros(len(x) + 1, U64), np.zeros(len(x) + 1, U64)
    np.cumsum(term >> U64(32), out=high[1:])
    np.cumsum(term & U64((1 << 32) - 1), out=low[1:])
    high, low = (high[j] - high[i]) % U64(PRIME), (low[j] - low[i]) % U64(PRIME)
    total = (times(high, np.full(len(i), 1 << 32, U64)) + low) % U64(PRIME)
    return times(total, prime_powers(pow(base, -1, PRIME), len(x) + 1)[i])


def shingle_sets(b: np.ndarray, o: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each document the ascending distinct hashes of its shingles of `width` words; a shorter word sequence counts as one shingle."""
    h, at = word_hashes(b, o)
    s = np.zeros(max(0, len(h) - width + 1), U64)
    for j in range(width):
        s += h[j : j + len(s)] * WORD_CODE[j]
    s = mix(s)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i >= width:
            yield np.unique(s[i : j - width + 1])
        elif j > i:
            yield mix(np.array([(h[i:j] * WORD_CODE[: j - i]).sum() + U64(j - i)], U64))
        else:
            yield np.zeros(0, U64)


def ragged(lengths: np.ndarray) -> np.ndarray:
    """Offsets from lengths."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, .., for each of the runs, in a row."""
    total = ragged(lengths)
    return np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
