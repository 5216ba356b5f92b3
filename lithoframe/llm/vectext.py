"""Vectorised work on whole texts inside Arrow tasks.

Spark deals out the rows; these helpers turn the string column of one Arrow
batch into numpy arrays (no Python string per row) and give word boundaries and
word hashes for all rows of a slice at once. Slices hold a few megabytes
of text, so memory does not follow the batch size; one very long text is a
slice of its own and its words are hashed in chunks.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 1 << 20
#: Bytes of text whose sums are held at a time when spans are hashed or compared.
HASH_BYTES = 1 << 18

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_BASE = 0x9E3779B97F4A7C15 | 3
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; equal inputs stay equal, bits are spread."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def mix_int(x: int) -> int:
    return int(mix64(np.array([x & (1 << 64) - 1], dtype=np.uint64))[0])


#: The values of bytes in span hashes; FOLDED takes A-Z as a-z.
PLAIN = np.arange(1, 257, dtype=np.uint64)
FOLDED = PLAIN.copy()
FOLDED[65:91] = PLAIN[97:123]
#: Bytes with A-Z as a-z.
LOWER = (FOLDED - np.uint64(1)).astype(np.uint8)
PRIME = np.uint64((1 << 61) - 1)
#: The point at which span hashes are taken, drawn at random.
_SEED = 0x0B5D2C9E71F3A846
_S1, _S29, _S30, _S31, _S32, _S61 = (np.uint64(k) for k in (1, 29, 30, 31, 32, 61))
_LOW29, _LOW30, _LOW31, _LOW32 = (np.uint64((1 << k) - 1) for k in (29, 30, 31, 32))
#: The values of bytes in the rolling sums of ``POWERS``.
ROLLING = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand.

    Sums of these are cheap but differ too little on structured texts (Thue-Morse
    words), so they only choose places (triggers) and candidates whose bytes are
    compared; what counts as equal is never read off them.
    """

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES + 4096)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, _BASE_INV))


POWERS = Powers()


def byte_class(pattern: bytes) -> np.ndarray:
    """A table that is true for the bytes in ``pattern``."""
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(pattern, dtype=np.uint8)] = True
    return out


#: Words of everything but white space: [^\x20\x09-\x0D]+
NON_SPACE = ~byte_class(b" \t\n\x0b\x0c\r")
#: Words of letters, digits and all beyond ASCII, once A-Z are lower-cased.
ALNUM = byte_class(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts and ends; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows with about ``size`` bytes."""
    raw, at = text_buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = min(rows, max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1))
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end
    _give_back()


def _give_back() -> None:
    """Return freed memory to the system once a batch is done: workers wait for their next task with little in hand."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # C libraries without it
        ctypes.CDLL(None).malloc_trim(0)


def spans(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row where its words begin; words never cross rows."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    mask = inside[raw]
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    edges = at[(at > 0) & (at < len(raw))]
    before[edges] = False
    after = np.empty_like(mask)
    after[-1] = False
    after[:-1] = mask[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, at)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers below PRIME."""
    a1, a0, b1, b0 = a >> _S31, a & _LOW31, b >> _S31, b & _LOW31
    mid = a1 * b0 + a0 * b1
    return reduced((a1 * b1 << _S1) + (mid >> _S30) + ((mid & _LOW30) << _S31) + a0 * b0)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME = 2**61 - 1."""
    x = (x & PRIME) + (x >> _S61)
    return np.where(x >= PRIME, x - PRIME, x)


class PrimePowers:
    """Powers of a base modulo PRIME, cut into 32-bit halves, and of its inverse; grown on demand."""

    def __init__(self) -> None:
        self.low = self.high = self.down = np.zeros(0, dtype=np.uint64)

    def need(self, n: int) -> None:
        if len(self.low) < n:
            up, self.down = (_powers(b, max(n, HASH_BYTES + 4096)) for b in (_SEED, pow(_SEED, -1, int(PRIME))))
            self.low, self.high = up & _LOW32, up >> _S32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, times(out, np.uint64(pow(base, len(out), int(PRIME))))])
    return out[:n]


PRIME_POWERS = PrimePowers()


def _polynomials(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The value modulo PRIME of each span within ``raw`` of at most 2 * SLICE_BYTES."""
    if len(raw) > 2 * SLICE_BYTES:
        raise ValueError("the sums of longer stretches don't fit")
    PRIME_POWERS.need(len(raw) + 1)
    value = table[raw]
    low, high = np.zeros(len(raw) + 1, dtype=np.uint64), np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(value * PRIME_POWERS.low[: len(raw)], out=low[1:])  # sums stay below 2**62: 9 bits of value, 32 of power, 21 of length
    np.cumsum(value * PRIME_POWERS.high[: len(raw)], out=high[1:])
    high = high[ends] - high[starts]
    total = (low[ends] - low[starts]) + ((high & _LOW29) << _S32) + (high >> _S29)
    return times(reduced(total), PRIME_POWERS.down[starts])


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = FOLDED) -> np.ndarray:
    """A 61-bit hash of each span, spread over 64 bits; spans are sorted by start and don't overlap.

    It is a polynomial of the bytes at a point drawn at random, modulo a prime: two
    spans of at most n bytes are alike with a chance below n / 2**61, whatever their
    structure. Longer stretches are hashed piece by piece, so memory is bounded.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        lo = starts[k]
        e = max(k + 1, int(np.searchsorted(ends, lo + HASH_BYTES, side="right")))
        if ends[e - 1] - lo <= HASH_BYTES:
            out[k:e] = _polynomials(raw[lo : ends[e - 1]], starts[k:e] - lo, ends[k:e] - lo, table)
        else:  # one very long span
            total = np.zeros(1, dtype=np.uint64)
            for c, p in enumerate(range(int(lo), int(ends[k]), HASH_BYTES)):
                part = raw[p : min(p + HASH_BYTES, int(ends[k]))]
                one = _polynomials(part, np.zeros(1, np.int64), np.array([len(part)]), table)
                total = reduced(total + times(one, np.array([pow(_SEED, c * HASH_BYTES, int(PRIME))], dtype=np.uint64)))
            out[k:e] = total
        k = e
    return mix64(out ^ (ends - starts).astype(np.uint64) * _M1)


def stretch_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes, of the same kind, of any stretches of at most SLICE_BYTES bytes of text; they may overlap."""
    return mix64(_polynomials(raw, starts, ends, PLAIN) ^ (ends - starts).astype(np.uint64) * _M1)


def same_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> bool:
    """Whether each span has the bytes of the equally long span that starts at ``others``; compared in bounded steps."""
    size = ends - starts
    k = 0
    upto = np.cumsum(size)
    while k < len(starts):
        e = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + HASH_BYTES, side="right")))
        if e == k + 1:
            if not np.array_equal(raw[starts[k] : ends[k]], raw[others[k] : others[k] + size[k]]):
                return False
        else:
            step = np.arange(int(size[k:e].sum())) - np.repeat(np.cumsum(size[k:e]) - size[k:e], size[k:e])
            if not np.array_equal(raw[np.repeat(starts[k:e], size[k:e]) + step], raw[np.repeat(others[k:e], size[k:e]) + step]):
                return False
        k = e
    return True


def words(raw: np.ndarray, at: np.ndarray, inside: np.ndarray, table: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows (A-Z lower-cased), and for each row where its words begin."""
    starts, ends, rows = spans(raw, at, inside)
    return span_hashes(raw, starts, ends, table), rows


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` neighbouring hashes, across row ends too: callers keep runs inside rows."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix64(out) + hashes[k : len(hashes) - n + 1 + k] * np.uint64(2 * k + 1)
    return mix64(out)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def with_columns(batch: pa.RecordBatch, carry: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + list(new.values()), names=[*carry, *new])
