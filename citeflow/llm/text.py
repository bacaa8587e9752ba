"""Vectorised words and rolling hashes over Arrow string columns.

Words are maximal runs of bytes outside U+0020 and U+0009..U+000D.  All
hashes are 64-bit polynomials modulo 2**64 with an avalanche finaliser, so a
batch of documents is tokenised and hashed without a Python loop over words.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_P, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche a uint64 array (two xor-shift-multiply rounds)."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, cached by doubling."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, U(b))
            a[0] = U(1)
            out.append(np.cumprod(a))
        have = _powers[base] = (out[0], out[1])
    return have


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def chunks(off: np.ndarray, size: int = CHUNK):
    """Runs (first, last) of documents of about ``size`` bytes."""
    first, n = 0, len(off) - 1
    while first < n:
        last = int(np.searchsorted(off, off[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def trim() -> None:
    """Gives what Arrow and the C library hold free back to the system: idle
    Python workers stay for a minute beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def pieces(batches, size: int = 1 << 20):
    """Record batches cut into runs of rows with about ``size`` bytes of
    text, so that what a worker holds does not grow with its batches; a
    longer text is a run of its own."""
    for batch in batches:
        for a, b in chunks(text_bytes(batch["text"])[1], size):
            yield batch.slice(a, b - a)
    trim()


#: Separators for plain words: every ASCII byte but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(column, lower: bool = False, spans: bool = False, space: np.ndarray = _SPACE, stems: tuple[int, ...] = ()):
    """(hashes, bounds[, starts, ends]): word hashes of all documents in
    order; document i owns hashes[bounds[i]:bounds[i+1]]; starts and ends are
    byte positions in ``text_bytes(column)[0]``.  With ``stems``, also an
    array of hashes of each word's first so many bytes, by stem length."""
    raw, off = text_bytes(column)
    hashes, starts_all, ends_all, heads = [], [], [], [[] for _ in stems]
    bounds, at = np.zeros(len(off), np.int64), 0
    for a, b in chunks(off):
        lo, hi = int(off[a]), int(off[b])
        x = raw[lo:hi]
        if lower:
            x = _LOWER[x]
        token = ~space[x]
        local = off[a : b + 1] - lo
        first = token.copy()
        first[1:] &= ~token[:-1]
        inner = local[:-1][local[:-1] < len(x)]
        first[inner] |= token[inner]
        final = token.copy()
        final[:-1] &= ~token[1:]
        ends_at = local[1:][local[1:] > 0] - 1
        final[ends_at] |= token[ends_at]
        s, e = np.flatnonzero(first), np.flatnonzero(final) + 1
        up, down = powers(_P, len(x) + 1)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTE[x] * up[: len(x)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        for own, size in zip(heads, stems, strict=True):
            own.append(mix((total[np.minimum(e, s + size)] - total[s]) * down[s] + U(size)))
        bounds[a + 1 : b + 1] = at + np.searchsorted(s, local[1:])
        at += len(s)
        if spans:
            starts_all.append(s + lo)
            ends_all.append(e + lo)
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    out = (cat(hashes, np.uint64), bounds)
    if stems:
        out = (*out, [cat(x, np.uint64) for x in heads])
    return (*out, cat(starts_all, np.int64), cat(ends_all, np.int64)) if spans else out


def windows(h: np.ndarray, bounds: np.ndarray, k: int, base: int = _Q) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of every run of k consecutive words of one document
    (Rabin-Karp over word hashes)."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(base, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    counts = np.diff(bounds)
    room = np.repeat(bounds[1:], counts) - np.arange(len(h)) >= k
    at = np.flatnonzero(room)
    return at, mix((total[at + k] - total[at]) * down[at])


def shingle_sets(column, k: int = 5) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its k-word shingles over
    A-Z-lowered words; with fewer than k words, the whole sequence as one."""
    out = []
    for first, last in chunks(text_bytes(column)[1], 1 << 20):
        h, bounds = words(column.slice(first, last - first), lower=True)
        at, w = windows(h, bounds, k)
        cuts = np.searchsorted(at, bounds)
        for i in range(len(bounds) - 1):
            part = w[cuts[i] : cuts[i + 1]]
            if len(part):
                out.append(np.unique(part))
            elif bounds[i + 1] > bounds[i]:
                own = h[bounds[i] : bounds[i + 1]]
                up = powers(_Q, k)[0]
                out.append(mix(np.array([(own * up[: len(own)]).sum() ^ U(len(own))], np.uint64)))
            else:
                out.append(part)
    return out
