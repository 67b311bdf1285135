"""Array helpers that the operators of this package share inside tasks.

Everything works on UTF-8 bytes. A *word* is a run of bytes outside ``[\\x20\\x09-\\x0D]``;
those six bytes never occur inside a multi-byte character, so byte words are character words.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Bytes hashed at once; bounds the eight-byte-per-byte temporaries whatever the length of a text.
BLOCK = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
#: Two independent byte tables and odd bases: two 64-bit hashes of the same bytes.
_BYTE = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * U64(2) + U64(1)
_BASE = [int(x) | 1 for x in _rng.integers(2**40, 2**63, size=2, dtype=np.uint64)]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2^64 (of the inverse if asked); grown on demand, kept per process."""
    got = _POWERS.get((base, inverse))
    if got is None or len(got) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        size = 1 << max(10, (n - 1).bit_length())
        got = np.ones(size, np.uint64)
        k = 1
        while k < size:
            got[k:2 * k] = got[:k] * U64(pow(step, k, 1 << 64))
            k *= 2
        _POWERS[(base, inverse)] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply): every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; null texts count as empty."""
    import pyarrow as pa

    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    off = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def row_groups(off: np.ndarray, limit: int = 8 * BLOCK):
    """Consecutive row ranges of about ``limit`` bytes (a longer row stands alone)."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


#: Letters, digits and every byte of a character beyond ASCII.
IS_TOKEN = np.zeros(256, bool)
IS_TOKEN[128:] = True
IS_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def word_bounds(data: np.ndarray, off: np.ndarray, inner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of the rows ``data[off[i]:off[i+1]]``, and each row's first word index (n+1 entries).

    ``inner`` tells the bytes that words are made of (default: all but white space).
    """
    inside = ~IS_SPACE[data] if inner is None else inner[data]
    n = len(data)
    first = inside.copy()
    last = inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


#: Code points of scripts written without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, Tai scripts, CJK, kana, Yi.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x1AAF), (0x2E80, 0xA4CF), (0xA9E0, 0xA9FF),
            (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


def cut_unspaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans with every character of ``UNSPACED`` as a span of its own (such characters lie inside spans)."""
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return starts, ends
    byte = lambda k: (data[lead + k] & 63).astype(np.int32)
    size = np.where(data[lead] >= 0xF0, 4, 3)
    code = ((data[lead] & 15).astype(np.int32) << 12) | byte(1) << 6 | byte(2)
    long = size == 4
    code[long] = code[long] << 6 | (data[lead[long] + 3] & 63)
    own = np.zeros(len(lead), bool)
    for a, b in UNSPACED:
        own |= (code >= a) & (code <= b)
    lead, after = lead[own], (lead + size)[own]
    begins, stops = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    begins[starts] = stops[ends] = True
    more_begins, more_stops = after[~stops[after]], lead[~begins[lead]]
    begins[lead] = stops[after] = True
    begins[more_begins] = stops[more_stops] = True
    return np.flatnonzero(begins), np.flatnonzero(stops)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each byte span (ascending, not overlapping), in blocks of bytes."""
    base, table = _BASE[which], _BYTE[which]
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        if hi - lo > 2 * BLOCK:  # one huge word: carry the hash over its blocks
            value, at = 0, 0
            for s in range(lo, hi, BLOCK):
                piece = table[data[s:min(s + BLOCK, hi)]] * powers(base, min(BLOCK, hi - s))
                value = (value + int(piece.sum(dtype=np.uint64)) * pow(base, at, 1 << 64)) % (1 << 64)
                at += BLOCK
            out[a] = value
        else:
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(table[data[lo:hi]] * powers(base, hi - lo), out=total[1:])
            s, e = starts[a:b] - lo, ends[a:b] - lo
            out[a:b] = (total[e] - total[s]) * powers(base, hi - lo, True)[s]
        a = b
    return mix(out ^ (ends - starts).astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def rolling(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values (``len - k + 1`` entries), by prefix sums in blocks."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _BASE[1 - which]
    out = np.empty(n, np.uint64)
    step = max(BLOCK // 8, k)
    for a in range(0, n, step):
        b = min(a + step, n)
        part = values[a:b + k - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(base, len(part)), out=total[1:])
        out[a:b] = (total[k:] - total[:-k]) * powers(base, b - a, True)
    return mix(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by doubling."""
    out, size = values, 1
    while size < w:
        step = min(size, w - size)
        out = np.minimum(out[:-step], out[step:]) if step < len(out) else out[:0]
        size += step
    return out
