"""Vectorised byte-level text helpers shared by the corpus operators.

Everything here works on one Arrow slice of texts at a time: the UTF-8 bytes of
all texts of the slice lie in one buffer, and numpy computes word bounds and
position-independent hashes for the whole slice.  A word is a run of bytes
other than space, tab, line feed, vertical tab, form feed and carriage return,
i.e. the pattern ``[^\\x20\\x09-\\x0D]+`` (UTF-8 continuation bytes never fall
in that set).  Null texts behave as empty texts.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are processed in slices of about this many bytes (one long text is one slice).
SLICE_BYTES = 1 << 20

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_TABLE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE_BYTE, BASE_WORD, BASE_WORD2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
#: Power tables have this many entries; longer texts are hashed block by block.
BLOCK = 1 << 18


@functools.lru_cache(8)
def _tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(BLOCK + 1, _U(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and the inverses of these, modulo 2**64; ``n`` is bounded by the callers' pieces."""
    if n <= BLOCK + 1:
        up, down = _tables(base)
        return up[:n], down[:n]
    out = []
    for table, b in zip(_tables(base), (base, pow(base, -1, 1 << 64)), strict=True):
        steps = [_U(pow(b, BLOCK * k, 1 << 64)) for k in range(-(-n // BLOCK))]
        out.append(np.concatenate([table[:BLOCK] * k for k in steps])[:n])
    return out[0], out[1]


def _prefix_at(codes: np.ndarray, table: np.ndarray, base: int, at: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of table[codes] at ascending places, block by block."""
    up = _tables(base)[0]
    out = np.empty(len(at), np.uint64)
    cuts = np.searchsorted(at, np.arange(0, len(codes) + BLOCK + 1, BLOCK))
    carry, scale, step = 0, 1, pow(base, BLOCK, 1 << 64)
    for k, low in enumerate(range(0, len(codes) + 1, BLOCK)):
        part = table[codes[low : low + BLOCK]]
        c = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=c[1:])
        i, j = cuts[k], cuts[k + 1]
        out[i:j] = c[at[i:j] - low] * _U(scale) + _U(carry)
        carry, scale = (carry + scale * int(c[-1])) % (1 << 64), scale * step % (1 << 64)
    return out


def _inverse_powers(base: int, at: np.ndarray) -> np.ndarray:
    down, inverse = _tables(base)[1], pow(base, -BLOCK, 1 << 64)
    high = np.array([pow(inverse, k, 1 << 64) for k in range(int(at[-1]) // BLOCK + 1)], np.uint64) if len(at) else np.zeros(1, np.uint64)
    return down[at % BLOCK] * high[at // BLOCK]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of x."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Parts of the batch whose texts hold about ``limit`` bytes; one text at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def word_bounds(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all runs of bytes not in ``space``, and for each text the index of its first word (n + 1 values)."""
    n = len(buf)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, n, BLOCK):
        high = min(n, low + BLOCK)
        solid = ~space[buf[max(0, low - 1) : high + 1]]
        edge = np.zeros(high - low + 1, bool)  # whether a text starts at low + i
        edge[offs[np.searchsorted(offs, low) : np.searchsorted(offs, high, "right")] - low] = True
        mine = solid[low > 0 :][: high - low]
        before = solid[: high - low] if low else np.append(False, solid[: high - 1])
        after = solid[1 + (low > 0) :][: high - low]
        after = after if len(after) == high - low else np.append(after, False)
        starts.append(np.flatnonzero(mine & (~before | edge[:-1])) + low)
        ends.append(np.flatnonzero(mine & (~after | edge[1:])) + low + 1)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands; starts and ends ascend."""
    table = _TABLE2 if second else _TABLE
    found = (_prefix_at(buf, table, BASE_BYTE, ends) - _prefix_at(buf, table, BASE_BYTE, starts)) * _inverse_powers(BASE_BYTE, starts)
    return mix(found + (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def gram_hashes(words: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` word hashes; grams may cross texts, the caller drops these."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    base, out = _U(BASE_WORD2 if second else BASE_WORD), words[size - 1 :].copy()
    for k in range(size - 2, -1, -1):
        out *= base
        out += words[k : k + n]
    return mix(out + _U(size))


def gather(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans one after another, and where each span starts in them (one value more)."""
    total = np.append(0, np.cumsum(lengths))
    return buf[np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])], total


def owners(first: np.ndarray, count: int) -> np.ndarray:
    """For each of ``count`` items the text it belongs to, given each text's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if count else np.zeros(0, np.int64)


def inside(first: np.ndarray, count: int, size: int) -> np.ndarray:
    """Mask over the starts of runs of ``size`` items: those that end within their own text."""
    if count < size:
        return np.zeros(0, bool)
    own = owners(first, count)
    return own[: count - size + 1] == own[size - 1 :]


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value of each window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, span = values.copy(), np.arange(len(values)), 1
    while span < width:  # doubling: windows of span, then 2 * span, at most width
        step = min(span, width - span)
        m = len(best) - step
        take = best[step:] < best[:m]
        at = np.where(take, at[step:], at[:m])
        best = np.where(take, best[step:], best[:m])
        span += step
    return at[:n]


def tidy(run):
    """A mapInArrow function that hands free memory back when its partition ends: Spark reuses its Python workers."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
